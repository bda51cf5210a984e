"""Queries of signal building: rates, shares, medians, bands, downscaling, estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from placescope.functions import estimates, names
from placescope.functions import fixed_values as fixed
from placescope.operators import joins, rates, stats
from placescope.plans import roles
from placescope.plans.catalog import Catalog
from placescope.plans.naming import (
    CODED_SQL, NORMED_SQL, OFFICE_SQL, REGION_CODE_EXPR, VEHICLE_SQL, coded_entities, normed_nations,
    offices, vehicle_records,
)
from placescope.plans.roles import ENTITY_SQL, SIGNAL_SQL
from placescope.plans.scoring import signal_table

CATALOG = Catalog()
NATION_POP_SQL = "pop AS (SELECT c_nationkey AS nation, count(*) * 1000 AS population FROM customer GROUP BY 1)"


def nation_population(spark, sf):
    return (
        roles.entities(spark, sf)
        .groupBy("nation")
        .agg((F.count(F.lit(1)) * 1000).alias("population"))
    )


@CATALOG.query(
    "jn1_downscale",
    f"WITH {SIGNAL_SQL}, g AS (SELECT nation, round(avg(spend), 2) AS figure FROM signals GROUP BY 1 HAVING count(*) > 55) "
    "SELECT entity, figure FROM signals LEFT JOIN g USING (nation)",
)
def jn1(spark, sf):
    s = roles.signals(spark, sf)
    g = s.groupBy("nation").agg(F.round(F.avg("spend"), 2).alias("figure"), F.count(F.lit(1)).alias("n"))
    return joins.downscale(g.where("n > 55"), s, "nation", "entity", "figure")


@CATALOG.query(
    "jn3_population_rate",
    f"""WITH {NORMED_SQL}, {NATION_POP_SQL}, totals AS (
  SELECT c_nationkey AS nation, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT region_norm, group_norm, n_orders, population, round_even(n_orders / population * 100000, 2) AS rate
FROM totals JOIN normed USING (nation) JOIN pop USING (nation)""",
)
def jn3(spark, sf):
    """Orders per lakh on the normalised (region, group) key, population deduplicated per key."""
    e = roles.entities(spark, sf).select("entity", "nation")
    o = roles.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.count(F.lit(1)).alias("n"))
    named = normed_nations(spark, sf).select("nation", "region_norm", "group_norm")
    totals = (
        o.join(e, "entity").groupBy("nation").agg(F.sum("n").alias("n_orders")).join(named, "nation").drop("nation")
    )
    population = nation_population(spark, sf).join(named, "nation").select("region_norm", "group_norm", "population", "nation")
    return joins.population_rate(
        totals, population, ("region_norm", "group_norm"), "n_orders", F.col("nation"), rates.LAKH, 2
    ).drop("nation")


@CATALOG.query(
    "jn4_uniform_lookup",
    """WITH r AS (SELECT n_regionkey, round(avg(s_acctbal), 4) AS figure FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT c_custkey AS entity, figure FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN r USING (n_regionkey)
WHERE c_custkey IN (SELECT o_custkey FROM orders)""",
)
def jn4(spark, sf):
    n = roles.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    s = roles.table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "nation")
    figures = s.join(n, "nation").groupBy("region").agg(F.round(F.avg("s_acctbal"), 4).alias("figure"))
    members = roles.entities(spark, sf).join(n, "nation").select("entity", "region")
    known = roles.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"))
    return joins.uniform_lookup(members, known, figures, "entity", "region", F.col("region")).select("entity", "figure")


@CATALOG.query(
    "jn9_tiered_sources",
    f"""WITH {ENTITY_SQL}, f AS (SELECT fine, round(avg(balance), 2) AS v FROM entities GROUP BY 1 HAVING count(*) >= 12),
g AS (SELECT coarse, round(avg(balance), 2) AS v FROM entities GROUP BY 1 HAVING count(*) >= 60)
SELECT entity, coalesce(f.v, g.v, 7000) AS figure FROM entities LEFT JOIN f USING (fine) LEFT JOIN g USING (coarse)""",
)
def jn9(spark, sf):
    e = roles.entities(spark, sf)

    def means(group, least):
        g = e.groupBy(group).agg(F.round(F.avg("balance"), 2).alias("v"), F.count(F.lit(1)).alias("n"))
        return g.where(F.col("n") >= least)

    out = joins.tiered(e, "entity", [(means("fine", 12), "fine", "v"), (means("coarse", 60), "coarse", "v")], "figure")
    return out.select("entity", F.coalesce("figure", F.lit(7000.0)).alias("figure"))


@CATALOG.query(
    "agg1_weighted_bands",
    """SELECT l_suppkey AS place,
  coalesce(round_even(sum(l_quantity * l_extendedprice) / sum(l_quantity), 0), 0) AS combined,
  coalesce(round_even(sum(l_quantity * l_extendedprice) FILTER (WHERE l_linestatus = 'F') / sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0), 0) AS rural,
  coalesce(round_even(sum(l_quantity * l_extendedprice) FILTER (WHERE l_linestatus = 'O') / sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0), 0) AS urban,
  coalesce(round_even(sum(l_quantity * l_extendedprice) FILTER (WHERE l_linenumber IN (4, 5)) / sum(l_quantity) FILTER (WHERE l_linenumber IN (4, 5)), 0), 0) AS middle
FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY 1""",
)
def agg1(spark, sf):
    li = roles.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "place")
    band = F.concat_ws("-", (F.col("l_linenumber") * 10).cast("string"), (F.col("l_linenumber") * 10 + 10).cast("string"))
    parts = {
        "rural": F.col("l_linestatus") == "F",
        "urban": F.col("l_linestatus") == "O",
        "middle": names.fix_band(band).isin(*fixed.MEDIAN_BANDS),
    }
    return rates.band_means(li, ["place"], "l_extendedprice", "l_quantity", parts)


@CATALOG.query(
    "agg2_modal_label",
    """WITH c AS (SELECT o_custkey AS entity, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT entity, arg_min(label, (-n, label)) AS modal_label, CAST(sum(n) AS BIGINT) AS row_count FROM c GROUP BY 1""",
)
def agg2(spark, sf):
    o = roles.table(spark, sf, "orders").withColumnRenamed("o_custkey", "entity")
    return rates.modal(o, "entity", "o_orderpriority", "modal_label")


_CAR = "lower(vehicle_class) LIKE '%lmv%' OR lower(vehicle_class) LIKE '%m_cab%' OR lower(vehicle_class) LIKE '%car%'"
_BIKE = "lower(vehicle_class) LIKE '%mcwg%' OR lower(vehicle_class) LIKE '%2w%' OR lower(vehicle_class) LIKE '%motorcycle%' OR lower(vehicle_class) LIKE '%scooter%'"


@CATALOG.query(
    "agg3_shares",
    f"""WITH {VEHICLE_SQL}, c AS (SELECT place, count(*) AS total,
  count(*) FILTER (WHERE contains(lower(fuel), 'electric') OR lower(fuel) = 'ev' OR contains(lower(fuel), 'battery')) AS ev,
  count(*) FILTER (WHERE {_CAR.replace('m_cab', 'm!_cab').replace("'%m!_cab%'", "'%m!_cab%' ESCAPE '!'")}) AS cars,
  count(*) FILTER (WHERE {_BIKE}) AS bikes,
  count(*) FILTER (WHERE contains(lower(maker), 'bmw') OR contains(lower(maker), 'volvo') OR price >= 2000000) AS luxury
FROM vehicles GROUP BY 1)
SELECT place, round_even(ev / greatest(total, 1), 4) AS ev_share, round_even(cars / greatest(bikes, 1), 3) AS car_2w_ratio,
  round_even(luxury / greatest(total, 1), 4) AS luxury_share, total AS sample_count FROM c""",
)
def agg3(spark, sf):
    v = vehicle_records(spark, sf)
    fuel, kind = F.lower("fuel"), F.lower("vehicle_class")
    counted = v.groupBy("place").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(fuel.contains("electric") | (fuel == "ev") | fuel.contains("battery")).alias("ev"),
        F.count_if(kind.rlike("lmv|m_cab|car")).alias("cars"),
        F.count_if(kind.rlike("mcwg|2w|motorcycle|scooter")).alias("bikes"),
        F.count_if(names.is_luxury(F.col("maker"), F.col("price"))).alias("luxury"),
    )
    total = F.col("total")
    return counted.select(
        "place",
        rates.ratio(F.col("ev"), total, 4).alias("ev_share"),
        rates.ratio(F.col("cars"), F.col("bikes"), 3).alias("car_2w_ratio"),
        rates.ratio(F.col("luxury"), total, 4).alias("luxury_share"),
        total.alias("sample_count"),
    )


@CATALOG.query(
    "agg4_filtered_rate_with_proxy",
    f"""WITH {NATION_POP_SQL}, t AS (SELECT s_nationkey AS nation, sum(l_quantity) AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  WHERE trim(l_returnflag) = 'R' GROUP BY 1),
r AS (SELECT CAST(nation AS VARCHAR) AS area, round_even(q / population * 1000, 1) AS per_1000 FROM t JOIN pop USING (nation)),
proxy AS (SELECT 'new area' AS area, round_even(sum(q) / sum(population) * 1000 * 1.05::DOUBLE, 1) AS per_1000
  FROM t JOIN pop USING (nation) WHERE nation IN (7, 13))
SELECT * FROM r UNION ALL SELECT * FROM proxy""",
)
def agg4(spark, sf):
    """Category total per area and 1000 people; an area without data borrows two neighbours x 1.05."""
    li = roles.table(spark, sf, "lineitem").where(F.trim("l_returnflag") == "R")
    s = roles.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    per_site = li.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))
    totals = (
        per_site.join(s, per_site.l_suppkey == s.s_suppkey)
        .groupBy("nation")
        .agg(F.sum("q").alias("q"))
        .join(nation_population(spark, sf), "nation")
    )
    own = totals.select(
        F.col("nation").cast("string").alias("area"),
        rates.rate_per(F.col("q"), F.col("population"), 1000, 1).alias("per_1000"),
    )
    proxy = totals.where(F.col("nation").isin(7, 13)).agg(
        F.lit("new area").alias("area"),
        F.bround(F.sum("q") / F.sum("population") * 1000 * 1.05, 1).alias("per_1000"),
    )
    return own.unionByName(proxy)


@CATALOG.query(
    "agg5_median_and_count",
    """SELECT l_suppkey AS place, round(median(l_extendedprice), 4) AS median, count(*) AS sample_count
FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1""",
)
def agg5(spark, sf):
    li = roles.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "place")
    return rates.median_and_count(li, "place", "l_extendedprice").withColumn("median", F.round("median", 4))


@CATALOG.query(
    "agg6_group_median_transform",
    f"""WITH {SIGNAL_SQL}, m AS (SELECT coarse, median(spend) AS med FROM signals GROUP BY 1)
SELECT entity, round(med, 3) AS med, CASE WHEN med >= 1 THEN round(med, 3) ELSE 15 END AS med_or_default
FROM signals JOIN m USING (coarse)""",
)
def agg6(spark, sf):
    s = roles.signals(spark, sf)
    out = rates.transform_median(s, "coarse", "spend", "med")
    shown = F.round("med", 3)
    return out.select(
        "entity", shown.alias("med"), estimates.poi_median_or_default(shown).alias("med_or_default")
    )


@CATALOG.query(
    "agg8_group_rate",
    f"""WITH {NATION_POP_SQL}, t AS (SELECT c_nationkey AS nation, count(*) AS c FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT nation, round(c / population * 100000, 4) AS rate FROM t JOIN pop USING (nation)""",
)
def agg8(spark, sf):
    s = roles.signals(spark, sf).select("nation", "n_orders")
    out = rates.group_rate(s, nation_population(spark, sf), "nation", "n_orders")
    return out.withColumn("rate", F.round("rate", 4))


@CATALOG.query(
    "agg9_counts_and_recent",
    """(SELECT 'count' AS kind, event_type AS label, count(*) AS n FROM events GROUP BY 2)
UNION ALL (SELECT 'recent', event_type, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20)""",
)
def agg9(spark, sf):
    e = roles.table(spark, sf, "events")
    counts = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    recent = rates.latest_events(e, "ts", "event_id", 20)
    return counts.select(F.lit("count").alias("kind"), F.col("event_type").alias("label"), "n").unionByName(
        recent.select(F.lit("recent").alias("kind"), F.col("event_type").alias("label"), F.col("event_id").alias("n"))
    )


WANTED = ("BUILD", "MACHINERY", "HOUSE", "NOTHING")


@CATALOG.query(
    "agg11_latest_value",
    """WITH f AS (SELECT c_mktsegment AS name, CAST(o_orderkey AS BIGINT) AS year, o_totalprice AS value
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'),
w(wanted) AS (VALUES ('BUILD'), ('MACHINERY'), ('HOUSE'), ('NOTHING')),
exact AS (SELECT wanted, arg_max(name, year) AS matched, max(year) AS year, arg_max(value, year) AS value FROM w JOIN f ON f.name = wanted GROUP BY 1),
prefix AS (SELECT wanted, arg_max(name, year) AS matched, max(year) AS year, arg_max(value, year) AS value FROM w JOIN f ON starts_with(f.name, wanted)
  WHERE wanted NOT IN (SELECT wanted FROM exact) GROUP BY 1)
SELECT * FROM exact UNION ALL SELECT * FROM prefix""",
)
def agg11(spark, sf):
    o = roles.table(spark, sf, "orders")
    c = roles.table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("name"))
    facts = o.join(c, o.o_custkey == c.c_custkey).select(
        "name",
        F.col("o_orderkey").alias("year"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("value"),
    )
    return rates.latest_value(facts, WANTED, "name", "year", "value")


@CATALOG.query(
    "agg12_carry_down",
    """WITH lines AS (SELECT event_id, user_id % 16 AS file, value, CASE WHEN event_id % 5 = 0 THEN event_type END AS heading FROM events),
c AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY file ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM lines)
SELECT event_id, file, label, value FROM c WHERE heading IS NULL""",
)
def agg12_carry(spark, sf):
    """Events as lines of 16 files, every fifth a heading that holds for the lines below it."""
    heading = F.when(F.col("event_id") % 5 == 0, F.col("event_type"))
    lines = roles.table(spark, sf, "events").select("event_id", (F.col("user_id") % 16).alias("file"), "value", heading.alias("heading"))
    carried = rates.carry_down(lines, "file", "event_id", "heading", "label")
    return carried.where("heading is null").select("event_id", "file", "label", "value")


@CATALOG.query(
    "agg12_latest_year_table",
    """WITH y AS (SELECT c_nationkey AS nation, year(o_orderdate) AS year, round(sum(o_totalprice), 2) AS value
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
l AS (SELECT nation, year, value FROM y WHERE year = (SELECT max(year) FROM y))
SELECT * FROM l UNION ALL SELECT 25, year, value FROM l WHERE nation = 4""",
)
def agg12(spark, sf):
    """Totals per year as columns, unpivoted, latest year kept, an area without figures filled by its donor."""
    o = roles.table(spark, sf, "orders").withColumn("y", F.year("o_orderdate").cast("string"))
    years = [r["y"] for r in o.where("y is not null").select("y").distinct().orderBy("y").collect()]  # calendar years
    c = roles.entities(spark, sf).select("entity", "nation")
    per_entity = o.groupBy(F.col("o_custkey").alias("entity")).agg(
        *[F.sum(F.when(F.col("y") == y, F.col("o_totalprice"))).alias(y) for y in years]
    )
    wide = per_entity.join(c, "entity").groupBy("nation").agg(*[F.round(F.sum(f"`{y}`"), 2).alias(y) for y in years])
    newest = rates.latest_year_table(rates.unpivot_years(wide, "nation", years), "nation")
    return rates.donor_fill(newest, "nation", 25, 4)


@CATALOG.query(
    "agg13_prefix_totals",
    f"WITH {CODED_SQL} SELECT left(code, 2) AS prefix, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM coded JOIN customer ON c_custkey = entity GROUP BY 1",
)
def agg13(spark, sf):
    e = coded_entities(spark, sf)
    return e.groupBy(F.substring("code", 1, 2).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("balance"), 2).alias("total")
    )


@CATALOG.query(
    "agg14_first_per_key",
    """SELECT o_custkey AS entity, o_orderpriority, o_orderkey, o_totalprice FROM
(SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def agg14(spark, sf):
    o = roles.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity"), "o_orderpriority", "o_orderkey", "o_totalprice"
    )
    order = F.struct(-F.col("o_totalprice"), F.col("o_orderkey"))
    return joins.first_per_key(o, ["entity", "o_orderpriority"], order)


@CATALOG.query(
    "agg15_collected_names",
    "SELECT p_brand AS brand, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS types, count(*) AS n FROM part GROUP BY 1",
)
def agg15(spark, sf):
    p = roles.table(spark, sf, "part").withColumnRenamed("p_brand", "brand")
    return rates.collected_names(p, "brand", "p_type", "types")


@CATALOG.query(
    "agg16_parent_rollup_rate",
    f"""WITH {NATION_POP_SQL}, m AS (SELECT n_regionkey AS region, sum(c_acctbal) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
p AS (SELECT n_regionkey AS region, sum(population) AS population FROM pop JOIN nation ON nation = n_nationkey GROUP BY 1)
SELECT region, round_even(total * 1e7 / population, 2) AS per_head, round_even(total / population * 1e5, 2) AS per_lakh FROM m JOIN p USING (region)""",
)
def agg16(spark, sf):
    n = roles.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    per_nation = roles.entities(spark, sf).groupBy("nation").agg(
        F.sum("balance").alias("total"), (F.count(F.lit(1)) * 1000).alias("population")
    )
    up = per_nation.join(n, "nation").groupBy("region").agg(
        F.sum("total").alias("total"), F.sum("population").alias("population")
    )
    total, population = F.col("total"), F.col("population")
    return up.select(
        "region",
        F.bround(total * F.lit(float(rates.CRORE)) / population, 2).alias("per_head"),
        rates.rate_per(total, population, rates.LAKH, 2).alias("per_lakh"),
    )


@CATALOG.query(
    "win2_group_z_with_fallback",
    f"""WITH {SIGNAL_SQL}, s AS (SELECT fine, count(*) AS n FROM signals GROUP BY 1),
t AS (SELECT entity, coalesce(spend, 0) AS value, CASE WHEN n >= 10 THEN fine ELSE coarse END AS effective FROM signals JOIN s USING (fine)),
m AS (SELECT effective, count(*) AS n, avg(value) AS a, stddev_samp(value) AS d FROM t GROUP BY 1)
SELECT entity, effective, round(CASE WHEN n < 2 THEN 0 ELSE (value - a) / CASE WHEN d > 1e-9 THEN d ELSE 1 END END, 6) AS z
FROM t JOIN m USING (effective)""",
)
def win2(spark, sf):
    s = roles.signals(spark, sf).fillna({"spend": 0.0})
    out = stats.group_z(s.select("entity", "fine", "coarse", "spend"), ("spend",), "fine", "coarse", min_size=10)
    return out.select("entity", "effective", F.round("spend", 6).alias("z"))


def _band_sql(lo, hi, expr="value"):
    return f"greatest({lo}, least({hi}, {lo} + ({hi} - {lo}) * ({expr} - mn) / greatest(mx - mn, 0.1)))"


@CATALOG.query(
    "win3_minmax_band",
    f"""WITH {SIGNAL_SQL}, p AS (SELECT fine, min(bulk) AS mn, max(bulk) AS mx, count(bulk) AS n FROM signals GROUP BY 1),
j AS (SELECT entity, bulk AS value, mn, mx, n FROM signals JOIN p USING (fine))
SELECT entity, round(CASE WHEN value IS NOT NULL AND n >= 2 THEN {_band_sql('0.6::DOUBLE', '1.4::DOUBLE')} ELSE 1 END, 6) AS wide,
  round(CASE WHEN value IS NOT NULL AND n >= 2 THEN greatest(0.5, least(1.5, 1.5 - (value - mn) / greatest(mx - mn, 0.1))) ELSE 1 END, 6) AS inverted,
  round(CASE WHEN value IS NOT NULL AND n >= 2 AND mn < mx THEN {_band_sql('0.65::DOUBLE', '1.35::DOUBLE')} ELSE 1 END, 6) AS spread
FROM j""",
)
def win3(spark, sf):
    s = roles.signals(spark, sf).select("entity", "fine", "bulk")
    s = stats.band_scalar(s, "bulk", "fine", 0.60, 1.40, "wide")
    s = stats.band_scalar(s, "bulk", "fine", 0.50, 1.50, "inverted", invert=True)
    s = stats.band_scalar(s, "bulk", "fine", 0.65, 1.35, "spread", need_spread=True)
    return s.select("entity", *[F.round(c, 6).alias(c) for c in ("wide", "inverted", "spread")])


@CATALOG.query(
    "win4_minmax_scale",
    """WITH s AS (SELECT min(c_acctbal) FILTER (WHERE c_acctbal > 0) AS lo, max(c_acctbal) FILTER (WHERE c_acctbal > 0) AS hi FROM customer)
SELECT c_custkey AS entity, CASE WHEN c_acctbal > 0 THEN round_even(100 * (c_acctbal - lo) / (hi - lo), 1) END AS scaled,
  CASE WHEN c_acctbal > 0 THEN round_even(50 + 50 * (c_acctbal - lo) / (hi - lo), 1) END AS half_scaled FROM customer, s""",
)
def win4(spark, sf):
    e = roles.entities(spark, sf)
    out = stats.minmax_scale(e, "balance", "scaled")
    return stats.minmax_scale(out, "balance", "half_scaled", lo=50.0).select("entity", "scaled", "half_scaled")


@CATALOG.query(
    "win5_representative",
    """SELECT o_custkey AS entity, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY
  CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END,
  CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, o_orderkey) AS rn FROM orders) WHERE rn = 1""",
)
def win5(spark, sf):
    """Representative order per customer: delivery flag first, then the office type rank."""
    o = roles.table(spark, sf, "orders").withColumnRenamed("o_custkey", "entity")
    p = F.col("o_orderpriority")
    office = F.when(p == "1-URGENT", "H.O").when(p == "2-HIGH", "S.O").when(p == "3-MEDIUM", "B.O").otherwise("?")
    rank = F.coalesce(
        names.lookup({k: str(v) for k, v in fixed.OFFICE_RANK.items()}, office).cast("int"),
        F.lit(fixed.OTHER_OFFICE_RANK),
    )
    order = [F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), rank, F.col("o_orderkey")]
    return stats.representative(o, "entity", order).select("entity", "o_orderkey")


@CATALOG.query(
    "win6_latest_event",
    "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
)
def win6(spark, sf):
    e = roles.table(spark, sf, "events")
    at = F.struct("ts", "event_id")
    return stats.latest_per(e, ["user_id"], at, {"event_id": F.col("event_id"), "event_type": F.col("event_type")})


@CATALOG.query(
    "win7_rank_of_value",
    "SELECT o_orderkey, CAST(count(*) OVER (ORDER BY round(o_totalprice, -3) DESC RANGE UNBOUNDED PRECEDING) AS BIGINT) AS rank FROM orders",
)
def win7(spark, sf):
    o = roles.table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", -3).alias("value"))
    return stats.rank_of_values(o, "value").select("o_orderkey", "rank")


@CATALOG.query(
    "win8_ratio_to_max",
    f"""WITH {SIGNAL_SQL}, g AS (SELECT coarse, sum(n_orders) AS v FROM signals GROUP BY 1),
p AS (SELECT coarse, min(balance) AS mn, max(balance) AS mx FROM signals GROUP BY 1)
SELECT entity, round_even(least(v / (SELECT max(v) FROM g) * {_band_sql('0.5::DOUBLE', '1.5::DOUBLE', 'balance')}, 1), 4) AS density
FROM signals JOIN g USING (coarse) JOIN p USING (coarse)""",
)
def win8(spark, sf):
    s = roles.signals(spark, sf).select("entity", "coarse", "balance", "n_orders")
    totals = s.groupBy("coarse").agg(F.sum("n_orders").alias("v"))
    banded = stats.band_scalar(s, "balance", "coarse", 0.50, 1.50)
    out = stats.ratio_to_max(rates.attach(banded, totals, "coarse"), "v", F.col("scalar"), "density")
    return out.select("entity", "density")


@CATALOG.query(
    "win9_p95_norm",
    f"""WITH {SIGNAL_SQL}, q AS (SELECT quantile_cont(spend, 0.95) AS p95 FROM signals)
SELECT entity, CASE WHEN spend IS NOT NULL THEN round_even(greatest(least(spend / p95 * 100, 100), 0), 1) END AS poi FROM signals, q""",
)
def win9(spark, sf):
    return stats.p95_norm(roles.signals(spark, sf), "spend", "poi").select("entity", "poi")


@CATALOG.query(
    "win10_impute_median",
    f"""WITH {SIGNAL_SQL} SELECT entity, round(coalesce(urgent, (SELECT median(urgent) FROM signals)), 3) AS urgent,
  round(coalesce(bulk, (SELECT median(bulk) FROM signals)), 3) AS bulk FROM signals""",
)
def win10(spark, sf):
    s = stats.impute_median(signal_table(spark, sf), ("urgent", "bulk"))
    return s.select("entity", F.round("urgent", 3).alias("urgent"), F.round("bulk", 3).alias("bulk"))


def _prior_sql(i: int) -> str:
    whens = " ".join(f"WHEN '{r}' THEN {v[i]}::DOUBLE" for r, v in fixed.REGION_PRIORS.items())
    return f"CASE region {whens} ELSE {fixed.DEFAULT_PRIOR[i]}::DOUBLE END"


_RATIO = "greatest(0.15::DOUBLE, least(5.0::DOUBLE, poi / greatest(med, 0.5::DOUBLE)))"


@CATALOG.query(
    "fn17_scale_from_density",
    f"""WITH {CODED_SQL}, r AS (SELECT entity, {REGION_CODE_EXPR} AS region, abs(c_acctbal) / 100 AS poi FROM coded JOIN customer ON c_custkey = entity),
m AS (SELECT region, CASE WHEN median(poi) >= 1 THEN median(poi) ELSE 15 END AS med FROM r GROUP BY 1),
j AS (SELECT *, {_RATIO} AS ratio FROM r JOIN m USING (region))
SELECT entity, round_even({_prior_sql(0)} * pow(ratio, 0.80), 0) AS rate_per_area,
  round_even({_prior_sql(1)} * pow(ratio, 0.75), 0) AS deposits_per_capita,
  round_even({_prior_sql(2)} * pow(ratio, 0.25), 1) AS radiance_mean,
  round_even({_prior_sql(3)} * pow(ratio, 0.55), 4) AS filers_per_capita,
  round_even({_prior_sql(7)} * pow(ratio, 0.35), 1) AS cars_per_1000,
  {_prior_sql(4)} AS car_2w_ratio, {_prior_sql(5)} AS luxury_share, {_prior_sql(6)} AS ev_share,
  round(poi, 4) AS poi_per_km2, round_even(0.04::DOUBLE * pow(ratio, 0.50), 4) AS fin_density_per_km2 FROM j""",
)
def fn17(spark, sf):
    e = coded_entities(spark, sf).select(
        "entity", names.region_of(F.col("code")).alias("region"), (F.abs("balance") / 100).alias("poi")
    )
    e = rates.transform_median(e, "region", "poi", "med")
    median = estimates.poi_median_or_default(F.col("med"))
    out = estimates.scale_from_density(F.col("poi"), median, estimates.prior_columns(F.col("region")))
    out["poi_per_km2"] = F.round(out["poi_per_km2"], 4)
    return e.select("entity", *[c.alias(n) for n, c in out.items()])


@CATALOG.query(
    "fn18_ratio_factor",
    f"""WITH {ENTITY_SQL}, m AS (SELECT coarse, median(balance) AS med FROM entities GROUP BY 1)
SELECT entity, round(CASE WHEN balance > 0 AND med > 0 THEN pow(balance / med, 0.35) ELSE 1 END, 6) AS factor
FROM entities JOIN m USING (coarse)""",
)
def fn18(spark, sf):
    e = rates.transform_median(roles.entities(spark, sf), "coarse", "balance", "med")
    factor = estimates.ratio_factor(F.col("balance"), F.col("med"))
    return e.select("entity", F.round(factor, 6).alias("factor"))


@CATALOG.query(
    "fn19_relative_rate",
    f"""WITH {SIGNAL_SQL}, m AS (SELECT coarse, median(spend) AS med FROM signals GROUP BY 1),
r AS (SELECT *, CASE nation % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.26 WHEN 2 THEN 0.22 ELSE 0.235 END::DOUBLE AS base,
  CASE nation % 4 WHEN 1 THEN 0.60 ELSE 0.70 END::DOUBLE AS ex FROM signals JOIN m USING (coarse))
SELECT entity, round_even(base * pow(spend / med, ex), 4) AS filers FROM r WHERE spend IS NOT NULL""",
)
def fn19(spark, sf):
    s = rates.transform_median(roles.signals(spark, sf), "coarse", "spend", "med").where("spend is not null")
    city = F.col("nation") % 4
    base = F.when(city == 0, 0.25).when(city == 1, 0.26).when(city == 2, 0.22).otherwise(0.235)
    exponent = F.when(city == 1, 0.60).otherwise(0.70)
    return s.select(
        "entity", estimates.relative_rate(base, F.col("spend"), F.col("med"), exponent).alias("filers")
    )


@CATALOG.query(
    "fn20_growth_weight",
    """WITH t AS (SELECT o_custkey AS entity, sum(o_totalprice) FILTER (WHERE year(o_orderdate) <= 1997) AS base,
  sum(o_totalprice) FILTER (WHERE year(o_orderdate) > 1997) AS latest FROM orders GROUP BY 1),
g AS (SELECT entity, (latest / base - 1) * 100 AS growth FROM t WHERE base > 0 AND latest IS NOT NULL),
m AS (SELECT median(growth) AS med FROM g)
SELECT entity, round_even(growth, 1) AS growth_pct, round_even(pow(greatest(growth / med, 0.2), 0.2), 4) AS weight FROM g, m""",
)
def fn20(spark, sf):
    o = roles.table(spark, sf, "orders")
    early, total = F.year("o_orderdate") <= 1997, F.col("o_totalprice")
    t = o.groupBy(F.col("o_custkey").alias("entity")).agg(
        F.sum(F.when(early, total)).alias("base"), F.sum(F.when(~early, total)).alias("latest")
    ).where("base > 0 and latest is not null")
    return growth_table(t).select("entity", "growth_pct", "weight")


def growth_table(t):
    """Growth and calibration weight against the median growth of all rows."""
    g = t.withColumn("_g", estimates.growth_pct(F.col("base"), F.col("latest")))
    median = rates.medians(g, [], "_g", "med").scalar()
    return g.select(
        *t.columns,
        F.bround("_g", 1).alias("growth_pct"),
        F.bround(estimates.calibration_weight(F.col("_g"), median), 4).alias("weight"),
    )


@CATALOG.query(
    "fn21_anchors",
    """WITH v AS (SELECT c_nationkey AS nation, arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority = '5-LOW') AS hh,
  arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderpriority = '2-HIGH') / 10000 AS ppp FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT nation, round_even(hh * ppp / 12, 0) AS monthly_spend, round_even(hh * ppp / 12 * 1.5, 0) AS index100_spend FROM v""",
)
def fn21(spark, sf):
    """Two indicators pivoted per area; their product over 12 is the monthly anchor, x 1.5 the index-100 one."""
    o = roles.table(spark, sf, "orders")
    c = roles.entities(spark, sf).select("entity", "nation")
    facts = o.join(c, o.o_custkey == c.entity)
    pick = lambda p: F.max_by(
        F.col("o_totalprice"), F.when(F.col("o_orderpriority") == p, F.col("o_orderkey"))
    )
    v = facts.groupBy("nation").agg(pick("5-LOW").alias("hh"), (pick("2-HIGH") / 10000).alias("ppp"))
    monthly = F.col("hh") * F.col("ppp") / 12
    return v.select(
        "nation", F.bround(monthly, 0).alias("monthly_spend"), F.bround(monthly * 1.5, 0).alias("index100_spend")
    )


@CATALOG.query(
    "fn22_group_anchor",
    f"""WITH {NATION_POP_SQL}, t AS (SELECT c_nationkey AS nation, count(*) AS branches FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT nation, round_even((branches / (population / 100000)) / CASE WHEN nation < 10 THEN 0.62 ELSE 0.55 END::DOUBLE, 1) AS anchor
FROM t JOIN pop USING (nation)""",
)
def fn22(spark, sf):
    s = roles.signals(spark, sf).groupBy("nation").agg(F.sum("n_orders").alias("branches"))
    share = F.when(F.col("nation") < 10, 0.62).otherwise(0.55)
    anchor = (F.col("branches") / (F.col("population") / rates.LAKH)) / share
    return s.join(nation_population(spark, sf), "nation").select("nation", F.bround(anchor, 1).alias("anchor"))


@CATALOG.query(
    "win5_office_directory",
    f"""WITH {OFFICE_SQL}, r AS (SELECT p_brand AS key, p_partkey, officetype, row_number() OVER (PARTITION BY p_brand ORDER BY
  CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END, CASE officetype WHEN 'H.O' THEN 0 WHEN 'S.O' THEN 1 ELSE 2 END, p_partkey) AS rn FROM offices)
SELECT key, p_partkey, officetype FROM r WHERE rn = 1""",
)
def win5_offices(spark, sf):
    o = offices(spark, sf).withColumnRenamed("p_brand", "key")
    rank = names.lookup({k: str(v) for k, v in fixed.OFFICE_RANK.items()}, F.col("officetype"))
    order = [F.when(F.col("p_type") == "PROMO", 0).otherwise(1), rank, F.col("p_partkey")]
    return stats.representative(o, "key", order).select("key", "p_partkey", "officetype")
