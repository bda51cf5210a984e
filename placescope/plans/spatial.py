"""Queries of distance work: radius joins, neighbours, interpolation, density, autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from placescope.functions import geo
from placescope.operators import filters, spatial
from placescope.plans import roles
from placescope.plans.catalog import Catalog
from placescope.plans.roles import ENTITY_SQL, SIGNAL_SQL, SITE_SQL

CATALOG = Catalog()

HAVERSINE_SQL = (
    "2 * 6371.0::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + "
    "cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2))))"
)
# Same point pairs by straight-line length in km.
CHORD_SQL = (
    "2 * 6371.0::DOUBLE * sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + "
    "cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2))"
)
SITE_TO_ENTITY = HAVERSINE_SQL.format(a="s", b="e")
SITE_TO_ENTITY_CHORD = CHORD_SQL.format(a="s", b="e")
ENTITY_PAIR = HAVERSINE_SQL.format(a="a", b="b")
ENTITY_PAIR_CHORD = CHORD_SQL.format(a="a", b="b")


def chord_sql(km: float) -> str:
    return f"{geo.chord(km)!r}::DOUBLE"


@CATALOG.query(
    "fn15_haversine",
    f"WITH {ENTITY_SQL}, c AS (SELECT 12.0::DOUBLE AS lat, 75.0::DOUBLE AS lng) SELECT entity, round({HAVERSINE_SQL.format(a='c', b='e')}, 6) AS km FROM entities e, c",
)
def fn15(spark, sf):
    km = geo.haversine(F.lit(12.0), F.lit(75.0), F.col("lat"), F.col("lng"))
    return roles.entities(spark, sf).select("entity", F.round(km, 6).alias("km"))


@CATALOG.query(
    "fn16_cartesian",
    f"WITH {ENTITY_SQL} SELECT entity, round(6371 * cos(radians(lat)) * cos(radians(lng)), 5) AS x, round(6371 * cos(radians(lat)) * sin(radians(lng)), 5) AS y, round(6371 * sin(radians(lat)), 5) AS z FROM entities",
)
def fn16(spark, sf):
    xyz = geo.cartesian(F.col("lat"), F.col("lng"))
    return roles.entities(spark, sf).select("entity", *[F.round(c, 5).alias(n) for n, c in zip("xyz", xyz)])


@CATALOG.query(
    "flt4_radius_filter",
    f"WITH {ENTITY_SQL}, c AS (SELECT 14.5::DOUBLE AS lat, 74.5::DOUBLE AS lng) SELECT entity FROM entities e, c WHERE {HAVERSINE_SQL.format(a='c', b='e')} <= 400",
)
def flt4(spark, sf):
    return filters.within_radius(roles.entities(spark, sf), 14.5, 74.5, 400).select("entity")


@CATALOG.query(
    "jn12_radius_join",
    f"""WITH {ENTITY_SQL}, p AS (SELECT a.entity, {ENTITY_PAIR_CHORD} AS d FROM entities a JOIN entities b ON a.entity <> b.entity)
SELECT entity, count(*) AS neighbours, round(sum(d), 4) AS total_km, round(min(d), 6) AS nearest_km FROM p WHERE d <= {chord_sql(20)} GROUP BY 1""",
)
def jn12(spark, sf):
    e = roles.entities(spark, sf).select("entity", "lat", "lng")
    pairs = spatial.pairs_within(e, e, 20).where("entity <> b_entity")
    return pairs.groupBy("entity").agg(
        F.count(F.lit(1)).alias("neighbours"),
        F.round(F.sum("chord_km"), 4).alias("total_km"),
        F.round(F.min("chord_km"), 6).alias("nearest_km"),
    )


_KNN_SQL = f"""WITH {ENTITY_SQL}, {SITE_SQL},
p AS (SELECT site, entity, balance, {SITE_TO_ENTITY} AS d FROM sites s, entities e WHERE {{where}}),
k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d, entity) AS rank FROM p)"""


@CATALOG.query(
    "jn13_knn",
    _KNN_SQL.format(where="true") + " SELECT site, entity, round(d, 6) AS dist_km, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5",
)
def jn13(spark, sf):
    near = spatial.knn(roles.sites(spark, sf), roles.entities(spark, sf), "site", "entity", 5)
    return near.withColumn("dist_km", F.round("dist_km", 6))


@CATALOG.query(
    "jn13_knn_max_radius",
    _KNN_SQL.format(where="true") + " SELECT site, entity, round(d, 6) AS dist_km, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 8 AND d <= 12",
)
def jn13_max(spark, sf):
    near = spatial.knn(roles.sites(spark, sf), roles.entities(spark, sf), "site", "entity", 8, max_km=12)
    return near.withColumn("dist_km", F.round("dist_km", 6))


@CATALOG.query(
    "jn14_pooled_knn",
    f"""WITH {ENTITY_SQL}, {SITE_SQL}, refs AS (SELECT * FROM entities),
sizes AS (SELECT coarse, count(*) AS n FROM refs GROUP BY 1),
p AS (SELECT site, entity, balance, {SITE_TO_ENTITY} AS d FROM sites s LEFT JOIN sizes z ON z.coarse = s.coarse
  JOIN refs e ON coalesce(n, 0) < 60 OR e.coarse = s.coarse),
k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d, entity) AS rank FROM p)
SELECT site, entity, round(balance, 2) AS balance, round(d, 6) AS dist_km, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""",
)
def jn14(spark, sf):
    """Neighbours inside the own nation when that has enough references, else anywhere."""
    near = spatial.pooled_knn(
        roles.sites(spark, sf), roles.entities(spark, sf), "site", "entity", "coarse", 5, ["balance"], min_pool=60
    )
    return near.withColumn("dist_km", F.round("dist_km", 6))


@CATALOG.query(
    "jn15_nearest_other",
    f"WITH {ENTITY_SQL} SELECT a.entity, round(min({ENTITY_PAIR}), 6) AS nn_km FROM entities a JOIN entities b ON a.entity <> b.entity GROUP BY 1",
)
def jn15(spark, sf):
    out = spatial.nearest_other(roles.entities(spark, sf), "entity")
    return out.withColumn("nn_km", F.round("nn_km", 6))


@CATALOG.query(
    "jn16_poi_density",
    f"""WITH {ENTITY_SQL}, {SITE_SQL}, p AS (SELECT e.entity, site_balance FROM entities e JOIN sites s ON {SITE_TO_ENTITY_CHORD} <= {chord_sql(25)}),
c AS (SELECT entity, count(*) FILTER (WHERE site_balance < 0) AS low, count(*) FILTER (WHERE site_balance BETWEEN 0 AND 5000) AS mid,
  count(*) FILTER (WHERE site_balance > 5000) AS high FROM p GROUP BY 1)
SELECT entity, coalesce(low, 0) AS low, coalesce(mid, 0) AS mid, coalesce(high, 0) AS high,
  round_even((coalesce(low, 0) + coalesce(mid, 0) + coalesce(high, 0)) / (pi() * 625), 6) AS per_km2 FROM entities LEFT JOIN c USING (entity)""",
)
def jn16(spark, sf):
    b = F.col("site_balance")
    classes = {"low": b < 0, "mid": b.between(0, 5000), "high": b > 5000}
    return spatial.density(roles.entities(spark, sf), roles.sites(spark, sf), "entity", 25, classes, 6)


@CATALOG.query(
    "sc6_idw_estimate",
    _KNN_SQL.format(where="true")
    + " SELECT site, round(sum(balance / greatest(d, 0.5)) / sum(1 / greatest(d, 0.5)), 4) AS balance FROM k WHERE rank <= 5 GROUP BY 1",
)
def sc6(spark, sf):
    near = spatial.knn(roles.sites(spark, sf), roles.entities(spark, sf), "site", "entity", 5, ["balance"])
    return spatial.idw(near, "site", ["balance"]).withColumn("balance", F.round("balance", 4))


@CATALOG.query(
    "sc6_grid_interpolation",
    f"""WITH {ENTITY_SQL}, {SITE_SQL}, p AS (SELECT entity, site, site_balance, {SITE_TO_ENTITY} AS d FROM sites s, entities e),
k AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d, site) AS rank FROM p),
v AS (SELECT entity, sum(site_balance / greatest(d, 0.5)) / sum(1 / greatest(d, 0.5)) AS v FROM k WHERE rank <= 8 AND d <= 30 GROUP BY 1)
SELECT entity, round(v, 4) AS activity FROM entities LEFT JOIN v USING (entity)""",
)
def sc6_grid(spark, sf):
    """Grid points spread over entities: eight nearest within 30 km, null where there is none."""
    e = roles.entities(spark, sf)
    near = spatial.knn(e, roles.sites(spark, sf), "entity", "site", 8, ["site_balance"], max_km=30)
    v = spatial.idw(near, "entity", ["site_balance"])
    return e.select("entity").join(v, "entity", "left").select("entity", F.round("site_balance", 4).alias("activity"))


@CATALOG.query(
    "sc6_pooled_idw",
    f"""WITH {ENTITY_SQL}, {SITE_SQL}, p AS (SELECT site, balance, {SITE_TO_ENTITY} AS d, entity FROM sites s JOIN entities e ON e.coarse = s.coarse),
k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d, entity) AS rank FROM p)
SELECT site, round(sum(balance / greatest(d, 0.5)) / sum(1 / greatest(d, 0.5)), 4) AS balance FROM k WHERE rank <= 5 GROUP BY 1""",
)
def sc6_pooled(spark, sf):
    near = spatial.pooled_knn(roles.sites(spark, sf), roles.entities(spark, sf), "site", "entity", "coarse", 5, ["balance"])
    return spatial.idw(near, "site", ["balance"]).withColumn("balance", F.round("balance", 4))


@CATALOG.query(
    "ml5_spatial_smoother",
    f"""WITH {ENTITY_SQL}, p AS (SELECT a.entity, b.balance, {ENTITY_PAIR_CHORD} AS d FROM entities a, entities b)
SELECT entity, round(sum(balance / greatest(d, 0.1)) / sum(1 / greatest(d, 0.1)), 4) AS smoothed FROM p WHERE d <= {chord_sql(20)} GROUP BY 1""",
)
def ml5(spark, sf):
    out = spatial.smooth(roles.entities(spark, sf), "entity", "balance")
    return out.withColumn("smoothed", F.round("smoothed", 4))


@CATALOG.query(
    "ml10_morans_i",
    f"""WITH {ENTITY_SQL}, z AS (SELECT entity, lat, lng, balance - avg(balance) OVER () AS z FROM entities),
p AS (SELECT a.entity, a.z AS za, b.z AS zb, {ENTITY_PAIR_CHORD} AS d FROM z a JOIN z b ON a.entity <> b.entity),
r AS (SELECT entity, za, sum(zb / pow(d + 1, 2)) AS ws, sum(1 / pow(d + 1, 2)) AS w FROM p WHERE d <= {chord_sql(25)} GROUP BY 1, 2)
SELECT round((SELECT sum(za * ws / (w + 1e-9)) FROM r) / ((SELECT sum(z * z) FROM z) + 1e-9), 8) AS morans_i""",
)
def ml10(spark, sf):
    return spatial.morans_i(roles.entities(spark, sf), "balance").withColumn("morans_i", F.round("morans_i", 8))
