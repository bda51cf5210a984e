"""Queries of the streaming jobs and the bulk expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from placescope.plans import expand, roles
from placescope.plans.catalog import Catalog
from placescope.plans.naming import REGION_CODE_EXPR
from placescope.plans.roles import ENTITY_SQL, SITE_SQL
from placescope.plans.scoring import scored
from placescope.plans.signals import _prior_sql
from placescope.plans.spatial import CHORD_SQL, HAVERSINE_SQL
from placescope.session import fresh_path
from placescope.streaming import jobs

CATALOG = Catalog()


def landed_events(spark, sf) -> str:
    """The event log as landed files, all click events sent twice."""
    path = fresh_path(spark, "landing")
    e = roles.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.write.parquet(path)
    e.where("event_type = 'click'").write.mode("append").parquet(path)
    return path


UNIQUE = ("ts", "user_id", "event_type")


@CATALOG.query("str1_ingest_log", "SELECT event_id, user_id, event_type, value FROM events")
def str1(spark, sf):
    """Ingest, then run again: the second run and the repeated files add nothing."""
    landing, base, check = landed_events(spark, sf), fresh_path(spark, "log"), fresh_path(spark, "check")
    schema = spark.read.parquet(landing).schema
    for _ in range(2):
        stream = jobs.read_log(spark, landing, schema, files_per_batch=1)
        jobs.ingest_log(stream, base, check, UNIQUE, "event_id")
    return jobs.stored(spark, base).select("event_id", "user_id", "event_type", "value")


@CATALOG.query("str1_dedup_within_watermark", "SELECT event_id, user_id, event_type, value FROM events")
def str1_recent(spark, sf):
    landing, out, check = landed_events(spark, sf), fresh_path(spark, "log"), fresh_path(spark, "check")
    stream = jobs.read_log(spark, landing, spark.read.parquet(landing).schema)
    jobs.append_parquet(jobs.dedup_recent(stream, UNIQUE, "40 days"), out, check)
    return jobs.stored(spark, out).select("event_id", "user_id", "event_type", "value")


_NEAREST_SQL = f"""WITH {ENTITY_SQL}, {SITE_SQL}, p AS (SELECT site, s.lat, s.lng, balance, entity, {HAVERSINE_SQL.format(a='s', b='e')} AS d FROM sites s, entities e),
k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY d, entity) AS rank FROM p)
SELECT site, round(sum(balance / greatest(d, 0.5)) / sum(1 / greatest(d, 0.5)), 4) AS balance FROM k WHERE rank <= 5 GROUP BY 1"""


@CATALOG.query("str2_incremental_enrichment", _NEAREST_SQL)
def str2(spark, sf):
    """Sites arrive as files and are scored against the static entities; a rerun adds nothing."""
    landing, base, check = fresh_path(spark, "landing"), fresh_path(spark, "scored"), fresh_path(spark, "check")
    sites = roles.sites(spark, sf).select("site", "lat", "lng").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    sites.write.parquet(landing)
    sites.write.mode("append").parquet(landing)
    schema = spark.read.parquet(landing).schema
    trusted = roles.entities(spark, sf).select("entity", "lat", "lng", "balance")
    for _ in range(2):
        stream = jobs.read_log(spark, landing, schema, files_per_batch=1)
        jobs.enrich(stream, trusted, "site", "entity", ["balance"], base, check)
    return jobs.stored(spark, base).select("site", F.round("balance", 4).alias("balance"))


@CATALOG.query(
    "str3_live_counts",
    "SELECT event_type, count(*) + CASE event_type WHEN 'click' THEN count(*) ELSE 0 END AS n FROM events GROUP BY 1",
)
def str3(spark, sf):
    from placescope.sources import store

    landing, base, check = landed_events(spark, sf), fresh_path(spark, "counts"), fresh_path(spark, "check")
    stream = jobs.read_log(spark, landing, spark.read.parquet(landing).schema)
    jobs.live_counts(stream, "event_type", base, check)
    return store.read_current(spark, base)


def trusted_entities(spark, sf):
    s = scored(spark, sf).select(
        "entity", "index", F.col("est_monthly_income_hh").alias("income"), F.col("est_monthly_spend_hh").alias("spend")
    )
    e = roles.entities(spark, sf).select(F.col("entity"), "name", "lat", "lng")
    return e.join(s, "entity").withColumn("entity", F.concat(F.lit("E"), F.col("entity").cast("string")))


def candidate_sites(spark, sf):
    return roles.sites(spark, sf).select(
        F.concat(F.lit("S"), F.col("site").cast("string")).alias("entity"),
        F.concat(F.lit("GROUP "), "coarse").alias("group"),
        F.concat(F.lit("region "), "coarse").alias("region"),
        "lat", "lng", F.col("site_balance").alias("figure"),
    )


EXPAND_SQL = (
    "WITH {money}, "
    + SITE_SQL
    + f""", base AS (SELECT 'E' || entity AS entity, entity AS num, name, lat, lng, "index", est_monthly_income_hh AS income, est_monthly_spend_hh AS spend FROM ranked JOIN entities USING (entity)),
p AS (SELECT site, b.*, {CHORD_SQL.format(a='s', b='b')} AS c, {HAVERSINE_SQL.format(a='s', b='b')} AS d FROM sites s, base b),
k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY c, entity) AS rank FROM p),
v AS (SELECT site, sum("index" / greatest(d, 0.5)) / sum(1 / greatest(d, 0.5)) AS i, sum(income / greatest(d, 0.5)) / sum(1 / greatest(d, 0.5)) AS inc,
  sum(spend / greatest(d, 0.5)) / sum(1 / greatest(d, 0.5)) AS sp FROM k WHERE rank <= 5 GROUP BY 1),
med AS (SELECT coarse, median(site_balance) AS med FROM sites GROUP BY 1),
f AS (SELECT s.*, CASE WHEN site_balance > 0 AND med > 0 THEN pow(site_balance / med, 0.35) ELSE 1 END AS f FROM sites s JOIN med USING (coarse))
SELECT entity, name, "index", income, spend FROM base UNION ALL
SELECT 'S' || site, 'Group ' || coarse || ', Region ' || coarse || ' · S' || site, CAST(round_even(i * f, 0) AS INTEGER), round_even(inc * f, -2), round_even(sp * f, -2)
FROM f JOIN v USING (site)"""
)


def _expand_sql() -> str:
    from placescope.plans.scoring import MONEY_SQL

    return EXPAND_SQL.replace("{money}", MONEY_SQL)


@CATALOG.query("sc7_bulk_expansion", _expand_sql())
def sc7(spark, sf):
    """Sites outside the trusted entities get interpolated scores, names and are appended."""
    out = expand.expand(candidate_sites(spark, sf), trusted_entities(spark, sf), "entity")
    return out.select("entity", "name", "index", "income", "spend")


@CATALOG.query(
    "sc7_proxy_backfill",
    f"""WITH poi AS (SELECT CAST((10 + (c_custkey * 31) % 80) * 10000 + c_custkey % 10000 AS VARCHAR) AS code, abs(c_acctbal) / 100 AS v FROM customer),
known AS (SELECT {REGION_CODE_EXPR} AS region, v FROM poi), m AS (SELECT region, median(v) AS med FROM known GROUP BY 1),
new AS (SELECT s_suppkey AS site, CAST((10 + (s_suppkey * 17) % 80) * 10000 + s_suppkey % 10000 AS VARCHAR) AS code FROM supplier),
r AS (SELECT site, {REGION_CODE_EXPR} AS region FROM new),
j AS (SELECT site, region, CASE WHEN med >= 1 THEN med ELSE 15 END AS med FROM r LEFT JOIN m USING (region))
SELECT site, region, round_even({_prior_sql(0)}, 0) AS rate_per_area, round_even({_prior_sql(3)}, 4) AS filers_per_capita,
  round_even({_prior_sql(7)}, 1) AS cars_per_1000, {_prior_sql(5)} AS luxury_share, round(med, 6) AS poi_per_km2, 0.04::DOUBLE AS fin_density_per_km2 FROM j""",
)
def sc7_backfill(spark, sf):
    code = lambda k, m: ((10 + (k * m) % 80) * 10000 + k % 10000).cast("string")
    poi = roles.entities(spark, sf).select(
        code(F.col("entity"), 31).alias("code"), (F.abs("balance") / 100).alias("poi_per_km2")
    )
    new = roles.sites(spark, sf).select("site", code(F.col("site"), 17).alias("code"))
    out = expand.backfill_proxies(new, poi, "site", "code")
    return out.select(
        "site", "region", "rate_per_area", "filers_per_capita", "cars_per_1000", "luxury_share",
        F.round("poi_per_km2", 6).alias("poi_per_km2"), "fin_density_per_km2",
    )
