"""Queries of the baseline index: z-scores, composite, money, gates, ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from placescope.operators import score, stats
from placescope.plans import roles
from placescope.plans.catalog import Catalog
from placescope.plans.roles import LONG_SQL, SCORE_SQL, SIGNAL_SQL, SIGNALS, WEIGHTS, Z_SQL
from placescope.session import materialize

CATALOG = Catalog()

MONEY_SQL = (
    SCORE_SQL
    + """, money AS (
  SELECT *, 6996 * 4.1::DOUBLE * exp(0.55 * composite_z) AS s,
         greatest(least(0.82 - 0.10 * composite_z, 0.85), 0.45) AS share FROM scores),
ranked AS (
  SELECT entity, composite_z, "index", coverage, round_even(s, -2) AS est_monthly_spend_hh,
         round_even(s / share, -2) AS est_monthly_income_hh,
         round_even(round_even(s, -2) * 12, -3) AS est_annual_spend_hh FROM money)"""
)


def signal_table(spark: SparkSession, sf: str) -> DataFrame:
    """Signals per entity, written once: the line items are read and shuffled one time, and the
    statistics passes that follow read a narrow table."""
    return materialize(roles.signals(spark, sf), "signals")


def z_table(spark: SparkSession, sf: str) -> DataFrame:
    return stats.winsor_z(signal_table(spark, sf), SIGNALS)


def baseline(signals: DataFrame) -> DataFrame:
    """The composite index of a written signal table."""
    return score.composite(stats.winsor_z(signals, SIGNALS), "entity", WEIGHTS)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return score.money(score.composite(z_table(spark, sf), "entity", WEIGHTS))


@CATALOG.query("flagship_ranked_index", f"WITH {MONEY_SQL} SELECT * FROM ranked")
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Signals to ranked affluence index with money estimates."""
    return scored(spark, sf).orderBy(F.col("index").desc(), "entity")


@CATALOG.query(
    "win1_winsor_z",
    f"WITH {Z_SQL} SELECT entity, signal, round(z, 6) AS z FROM zs",
)
def win1(spark, sf):
    z = z_table(spark, sf).select("entity", *[F.col(f"z_{s}").alias(s) for s in SIGNALS])
    return stats.to_long(z, "entity", SIGNALS).select("entity", "signal", F.round("value", 6).alias("z"))


@CATALOG.query(
    "sc1_composite", f'WITH {SCORE_SQL} SELECT entity, composite_z, "index", coverage FROM scores'
)
def sc1(spark, sf):
    return baseline(signal_table(spark, sf))


@CATALOG.query(
    "sc2_money",
    f"WITH {MONEY_SQL} SELECT entity, est_monthly_spend_hh, est_monthly_income_hh, est_annual_spend_hh FROM ranked",
)
def sc2(spark, sf):
    return scored(spark, sf).select(
        "entity", "est_monthly_spend_hh", "est_monthly_income_hh", "est_annual_spend_hh"
    )


@CATALOG.query(
    "sc3_leave_one_out",
    f"""WITH {SCORE_SQL}, dropped AS (
  SELECT d.signal AS signal, z.entity, sum(zw.w * z.z) / sum(zw.w) AS c
  FROM weights d CROSS JOIN zs z JOIN weights zw ON zw.signal = z.signal
  WHERE z.signal <> d.signal GROUP BY 1, 2),
swings AS (
  SELECT dropped.signal, abs(scores."index" -
    CAST(round_even(greatest(least(100 + 30 * dropped.c, 200), 40), 0) AS INTEGER)) AS swing
  FROM dropped JOIN scores USING (entity))
SELECT signal, max(swing) AS max_swing, CASE WHEN max(swing) <= 10 THEN 'PASS' ELSE 'WARN' END AS status
FROM swings GROUP BY 1""",
)
def sc3(spark, sf):
    return score.leave_one_out(z_table(spark, sf), WEIGHTS)


@CATALOG.query(
    "sc4_ordering_gates",
    f"""WITH {SCORE_SQL}, nations AS (
  SELECT nation, arg_max(entity, (spend, entity)) AS hi, arg_min(entity, (spend, entity)) AS lo
  FROM signals WHERE spend IS NOT NULL GROUP BY 1)
SELECT nation AS gate, hi, lo, h."index" AS hi_value, l."index" AS lo_value,
       CASE WHEN h."index" IS NULL OR l."index" IS NULL THEN 'SKIP'
            WHEN h."index" > l."index" THEN 'PASS' ELSE 'FAIL' END AS status
FROM nations LEFT JOIN scores h ON h.entity = hi LEFT JOIN scores l ON l.entity = lo""",
)
def sc4(spark, sf):
    s = roles.signals(spark, sf).where("spend is not null")
    by_spend = F.struct("spend", "entity")
    gates = s.groupBy(F.col("nation").alias("gate")).agg(
        F.max_by("entity", by_spend).alias("hi"), F.min_by("entity", by_spend).alias("lo")
    )
    return score.ordering_gates(gates, sc1(spark, sf), "entity", "index")


@CATALOG.query(
    "sc5_drift",
    f"""WITH {SCORE_SQL}, previous AS (
  SELECT entity, CAST(round_even(greatest(least(100 + 30 * sum(w * z) / sum(w), 200), 40), 0) AS INTEGER) AS old_value
  FROM zs JOIN weights USING (signal) WHERE signal <> 'bulk' GROUP BY 1)
SELECT entity, "index" AS new_value, old_value, abs("index" - old_value) AS delta,
       CASE WHEN abs("index" - old_value) > 10 THEN 'WARN' ELSE 'PASS' END AS status
FROM scores JOIN previous USING (entity)""",
)
def sc5(spark, sf):
    z = z_table(spark, sf)
    before = {s: w for s, w in WEIGHTS.items() if s != "bulk"}
    return score.drift(
        score.composite(z, "entity", WEIGHTS), score.composite(z, "entity", before), "entity", "index"
    )


@CATALOG.query(
    "agg10_coverage",
    f"""WITH {SIGNAL_SQL}, total AS (SELECT count(*) AS total FROM signals), filled AS (
  SELECT 'balance' AS signal, count(balance) AS filled FROM signals UNION ALL
  SELECT 'spend', count(spend) FROM signals UNION ALL SELECT 'discount', count(discount) FROM signals UNION ALL
  SELECT 'urgent', count(urgent) FROM signals UNION ALL SELECT 'bulk', count(bulk) FROM signals)
SELECT signal, filled, total, round(filled / total, 4) AS share FROM filled, total""",
)
def agg10(spark, sf):
    return score.coverage_report(roles.signals(spark, sf), SIGNALS)


@CATALOG.query(
    "jn2_outer_alignment",
    f"""WITH {LONG_SQL} SELECT entity,
  round(max(CASE WHEN signal = 'balance' THEN value END), 2) AS balance,
  round(max(CASE WHEN signal = 'spend' THEN value END), 2) AS spend,
  round(max(CASE WHEN signal = 'discount' THEN value END), 10) AS discount,
  round(max(CASE WHEN signal = 'urgent' THEN value END), 2) AS urgent,
  round(max(CASE WHEN signal = 'bulk' THEN value END), 2) AS bulk
FROM long GROUP BY 1""",
)
def jn2(spark, sf):
    long = stats.to_long(roles.signals(spark, sf), "entity", SIGNALS)
    wide = stats.to_wide(long, "entity", SIGNALS)
    digits = {"discount": 10}
    return wide.select("entity", *[F.round(s, digits.get(s, 2)).alias(s) for s in SIGNALS])


@CATALOG.query(
    "fn24_change_band",
    f"""WITH {SIGNAL_SQL} SELECT entity, round((spend - balance) / greatest(abs(balance), 1e-9) * 100, 2) AS pct,
  CASE WHEN (spend - balance) / greatest(abs(balance), 1e-9) * 100 > 2 THEN '▲'
       WHEN (spend - balance) / greatest(abs(balance), 1e-9) * 100 < -2 THEN '▼' ELSE '≈' END AS arrow
FROM signals WHERE spend IS NOT NULL""",
)
def fn24(spark, sf):
    pct, arrow = score.change_band(F.col("balance"), F.col("spend"))
    return (
        roles.signals(spark, sf)
        .where("spend is not null")
        .select("entity", F.round(pct, 2).alias("pct"), arrow.alias("arrow"))
    )


@CATALOG.query(
    "ord1_sorted_scores", f'WITH {SCORE_SQL} SELECT entity, "index" FROM scores'
)
def ord1(spark, sf):
    return sc1(spark, sf).select("entity", "index").orderBy(F.col("index").desc(), "entity")


@CATALOG.query(
    "ord2_top_and_bottom",
    f"""WITH {SCORE_SQL}
(SELECT 'top' AS side, entity, "index" FROM scores ORDER BY "index" DESC, entity LIMIT 10)
UNION ALL (SELECT 'bottom', entity, "index" FROM scores ORDER BY "index", entity LIMIT 10)""",
)
def ord2(spark, sf):
    s = sc1(spark, sf).select("entity", "index")
    top = s.orderBy(F.col("index").desc(), "entity").limit(10)
    low = s.orderBy("index", "entity").limit(10)
    return top.withColumn("side", F.lit("top")).unionByName(low.withColumn("side", F.lit("bottom")))
