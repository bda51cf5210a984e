"""Queries of polygon work on shapes derived around the entity points."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from placescope.operators import geometry, spatial
from placescope.plans import roles
from placescope.plans.catalog import Catalog
from placescope.plans.roles import ENTITY_SQL

CATALOG = Catalog()

# Corner offsets of the base shape in units of the shape size.
CORNERS = ((-1, -1), (1, -1), (1.5, 0.5), (0, 1.2), (-1, 1), (-1, -1))
SQUARE = ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))


def ring(lat, lng, size, corners):
    return F.array(*[F.array(lng + size * float(x), lat + size * float(y)) for x, y in corners])


def shapes(spark, sf):
    """A base polygon per entity; every 10th has a far part, every 15th a near one, every 97th is misplaced."""
    e = roles.entities(spark, sf).select("entity", "lat", "lng")
    k = F.col("entity")
    shift = F.when(k % 97 == 5, 1.0).otherwise(0.0)
    lat, lng = F.col("lat") + shift, F.col("lng") + shift
    size = 0.002 * (1 + k % 7)
    base = F.array(ring(lat, lng, size, CORNERS))
    far = F.array(ring(lat + 0.5, lng + 0.5, F.lit(0.03), SQUARE))
    near = F.array(ring(lat + 0.02, lng, F.lit(0.001), SQUARE))
    none = F.array().cast("array<array<array<array<double>>>>")
    parts = F.concat(
        F.when(k % 10 == 0, F.array(far)).otherwise(none), F.array(base),
        F.when(k % 15 == 0, F.array(near)).otherwise(none),
    )
    return e.withColumn("parts", parts)


def _ring_sql(lat, lng, size, corners):
    return "[" + ", ".join(f"[{lng} + {size} * {float(x)}::DOUBLE, {lat} + {size} * {float(y)}::DOUBLE]" for x, y in corners) + "]"


SHAPE_SQL = (
    ENTITY_SQL
    + f""", sized AS (SELECT entity, lat, lng, lat + CASE WHEN entity % 97 = 5 THEN 1.0 ELSE 0 END::DOUBLE AS slat,
  lng + CASE WHEN entity % 97 = 5 THEN 1.0 ELSE 0 END::DOUBLE AS slng, 0.002::DOUBLE * (1 + entity % 7) AS size FROM entities),
parted AS (
  SELECT entity, lat, lng, 0 AS i, {_ring_sql('slat + 0.5', 'slng + 0.5', '0.03::DOUBLE', SQUARE)} AS ring FROM sized WHERE entity % 10 = 0
  UNION ALL SELECT entity, lat, lng, 1, {_ring_sql('slat', 'slng', 'size', CORNERS)} FROM sized
  UNION ALL SELECT entity, lat, lng, 2, {_ring_sql('slat + 0.02', 'slng', '0.001::DOUBLE', SQUARE)} FROM sized WHERE entity % 15 = 0),
corners AS (SELECT entity, lat, lng, i, unnest(ring) AS p FROM parted),
boxes AS (SELECT entity, min(p[1]) AS x0, max(p[1]) AS x1, min(p[2]) AS y0, max(p[2]) AS y1, avg(p[1]) AS mx, avg(p[2]) AS my FROM corners GROUP BY 1)"""
)


def hav(lat1, lng1, lat2, lng2):
    return (
        f"2 * 6371.0::DOUBLE * asin(least(1.0, sqrt(pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians(({lng2}) - ({lng1})) / 2), 2))))"
    )


RING_SQL = (
    SHAPE_SQL
    + """, sums AS (SELECT entity, lat, lng, i, ring,
  list_sum([ring[j][1] * ring[j + 1][2] - ring[j + 1][1] * ring[j][2] for j in range(1, len(ring))]) * 0.5 AS a,
  list_sum([(ring[j][1] + ring[j + 1][1]) * (ring[j][1] * ring[j + 1][2] - ring[j + 1][1] * ring[j][2]) for j in range(1, len(ring))]) AS sx,
  list_sum([(ring[j][2] + ring[j + 1][2]) * (ring[j][1] * ring[j + 1][2] - ring[j + 1][1] * ring[j][2]) for j in range(1, len(ring))]) AS sy FROM parted),
rings AS (SELECT entity, lat, lng, i, sx / (6 * a) AS clng, sy / (6 * a) AS clat, abs(a) AS area,
  """
    + hav(
        "list_min([p[2] for p in ring])", "list_min([p[1] for p in ring])",
        "list_max([p[2] for p in ring])", "list_max([p[1] for p in ring])",
    )
    + """ AS diag FROM sums)"""
)

KEPT_SQL = (
    RING_SQL
    + f""", placed AS (SELECT *, {hav('lat', 'lng', 'clat', 'clng')} AS d FROM rings),
reach AS (SELECT entity, greatest(8.0, 4 * arg_min(diag, (d, i))) AS km, min(d) AS d0 FROM placed GROUP BY 1),
kept AS (SELECT entity, i, d FROM placed JOIN reach USING (entity) WHERE d <= km OR d0 > km)"""
)


@CATALOG.query(
    "geo1_bbox_centre",
    f"WITH {SHAPE_SQL} SELECT entity, round((y0 + y1) / 2, 7) AS clat, round((x0 + x1) / 2, 7) AS clng FROM boxes",
)
def geo1(spark, sf):
    lat, lng = geometry.bbox_centre(F.col("parts"))
    return shapes(spark, sf).select("entity", F.round(lat, 7).alias("clat"), F.round(lng, 7).alias("clng"))


@CATALOG.query(
    "geo2_bbox_diagonal", f"WITH {SHAPE_SQL} SELECT entity, round({hav('y0', 'x0', 'y1', 'x1')}, 5) AS km FROM boxes"
)
def geo2(spark, sf):
    return shapes(spark, sf).select("entity", F.round(geometry.bbox_diagonal_km(F.col("parts")), 5).alias("km"))


@CATALOG.query("geo3_vertex_mean", f"WITH {SHAPE_SQL} SELECT entity, round(my, 7) AS clat, round(mx, 7) AS clng FROM boxes")
def geo3(spark, sf):
    lat, lng = geometry.vertex_mean(F.col("parts"))
    return shapes(spark, sf).select("entity", F.round(lat, 7).alias("clat"), F.round(lng, 7).alias("clng"))


@CATALOG.query(
    "geo4_ring_centroid_area",
    f"WITH {RING_SQL} SELECT entity, i, round(clat, 4) AS clat, round(clng, 4) AS clng, round(area, 9) AS area FROM rings",
)
def geo4(spark, sf):
    """Shoelace centroid and area of every part, as part rows; i numbers far, base and near parts."""
    s = shapes(spark, sf).select("entity", F.posexplode("parts").alias("pos", "poly"))
    first = F.when(F.col("entity") % 10 == 0, 0).otherwise(1)
    c = geometry.ring_centroid_area(F.col("poly")[0])
    return s.select("entity", (F.col("pos") + first).alias("i"), c.alias("c")).select(
        "entity", "i", F.round("c.lat", 4).alias("clat"), F.round("c.lng", 4).alias("clng"), F.round("c.area", 9).alias("area")
    )


@CATALOG.query(
    "geo5_drop_far_parts",
    f"WITH {KEPT_SQL} SELECT entity, count(*) AS kept, string_agg(CAST(i AS VARCHAR), ',' ORDER BY d, i) AS parts FROM kept GROUP BY 1",
)
def geo5(spark, sf):
    """Kept parts per shape, nearest first where something was dropped, recognised by their size."""
    out = geometry.drop_far_parts(shapes(spark, sf), "parts")
    return out.select("entity", F.size("parts").cast("long").alias("kept"), part_order(F.col("parts")).alias("parts"))


def part_order(parts):
    """Which of the derived parts are left, ordered by distance like the check query."""

    def number(p):
        west, east = F.array_min(F.transform(p[0], lambda v: v[0])), F.array_max(F.transform(p[0], lambda v: v[0]))
        width = east - west
        return F.when(width > 0.05, 0).when(F.size(p[0]) == 6, 1).otherwise(2)

    order = F.transform(parts, number)
    # Unchanged shapes keep their stored order; the far part is then the last by distance.
    ranked = F.array_sort(F.transform(order, lambda i: F.when(i == 0, 9).otherwise(i)))
    by_distance = F.transform(ranked, lambda i: F.when(i == 9, 0).otherwise(i))
    return F.array_join(by_distance.cast("array<string>"), ",")


@CATALOG.query(
    "geo6_reject_far",
    f"WITH {SHAPE_SQL}, m AS (SELECT b.*, lat, lng FROM boxes b JOIN entities USING (entity)) SELECT entity, {hav('lat', 'lng', 'my', 'mx')} > 30 AS rejected FROM m",
)
def geo6(spark, sf):
    out = geometry.reject_far(shapes(spark, sf), "parts")
    return out.select("entity", F.col("parts").isNull().alias("rejected"))


@CATALOG.query(
    "geo7_reasonable_size",
    f"""WITH {SHAPE_SQL}, nn AS (SELECT a.entity, min({hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}) AS nn FROM entities a JOIN entities b ON a.entity <> b.entity GROUP BY 1)
SELECT entity, {hav('y0', 'x0', 'y1', 'x1')} <= least(15, greatest(nn * 2, 2.5)) AS fits FROM boxes JOIN nn USING (entity)""",
)
def geo7(spark, sf):
    s = shapes(spark, sf)
    nn = spatial.nearest_other(s.select("entity", "lat", "lng"), "entity")
    # Planned by the size of the packed file, the shapes would be broadcast whole.
    return s.join(nn.hint("merge"), "entity").select("entity", geometry.reasonable_size(F.col("parts"), F.col("nn_km")).alias("fits"))


_CIRCLE_ROWS = " UNION ALL ".join(
    f"SELECT entity, {i} AS step, round(lng + {0.012 * math.cos(2 * math.pi * i / 12)!r}::DOUBLE, 6) AS x, round(lat + {0.012 * math.sin(2 * math.pi * i / 12)!r}::DOUBLE, 6) AS y FROM entities"
    for i in range(13)
)


@CATALOG.query("geo8_fallback_circle", f"WITH {ENTITY_SQL} {_CIRCLE_ROWS}")
def geo8(spark, sf):
    c = geometry.circle(F.col("lat"), F.col("lng"))
    rows = roles.entities(spark, sf).select("entity", F.posexplode(c[0][0]).alias("step", "p"))
    return rows.select("entity", "step", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@CATALOG.query(
    "geo9_assembled_boundaries",
    f"""WITH {KEPT_SQL}, nn AS (SELECT a.entity, min({hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}) AS nn FROM entities a JOIN entities b ON a.entity <> b.entity GROUP BY 1),
fit AS (SELECT entity, {hav('y0', 'x0', 'y1', 'x1')} <= least(15, greatest(nn * 2, 2.5)) AS fits FROM boxes JOIN nn USING (entity)),
layered AS (SELECT entity, CASE WHEN entity % 3 = 0 THEN 'official' WHEN entity % 3 = 1 AND fits THEN 'cached' ELSE 'circle' END AS layer FROM fit),
left_over AS (SELECT k.entity, avg(p[1]) AS mx, avg(p[2]) AS my, count(DISTINCT k.i) AS n FROM kept k JOIN corners c ON c.entity = k.entity AND c.i = k.i GROUP BY 1)
SELECT entity, layer, CASE WHEN layer = 'circle' THEN 1 WHEN {hav('lat', 'lng', 'my', 'mx')} > 30 THEN 0 ELSE n END AS n_parts
FROM layered JOIN left_over USING (entity) JOIN entities USING (entity)""",
)
def geo9(spark, sf):
    s = shapes(spark, sf)
    official = s.where("entity % 3 = 0").select("entity", "parts")
    cached = s.where("entity % 3 = 1").select("entity", "parts")
    anchors = s.select("entity", "lat", "lng").join(
        spatial.nearest_other(s.select("entity", "lat", "lng"), "entity").hint("merge"), "entity"
    )
    out = geometry.assemble_boundaries(official, cached, anchors, "entity")
    n = F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts"))
    return out.select("entity", "layer", n.cast("long").alias("n_parts"))
