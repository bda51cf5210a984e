"""How the given tables play the engine's roles: entities, groups, signals, points, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SIGNALS = ("balance", "spend", "discount", "urgent", "bulk")
WEIGHTS = {"balance": 0.25, "spend": 0.23, "discount": 0.15, "urgent": 0.10, "bulk": 0.08}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latitude(key: Column, nation: Column) -> Column:
    return F.lit(10.0) + 4 * F.floor(nation / 5) + ((key * 7919) % 10007) / F.lit(10007.0)


def longitude(key: Column, nation: Column) -> Column:
    return F.lit(70.0) + 4 * (nation % 5) + ((key * 104729) % 10009) / F.lit(10009.0)


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """customer as entities: fine group nation/segment, coarse group nation, a point."""
    c = table(spark, folder, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return c.select(
        key.alias("entity"),
        F.concat_ws("/", nation.cast("string"), F.col("c_mktsegment")).alias("fine"),
        nation.cast("string").alias("coarse"),
        nation.alias("nation"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
        latitude(key, nation).alias("lat"),
        longitude(key, nation).alias("lng"),
    )


def sites(spark: SparkSession, folder: str) -> DataFrame:
    """supplier as points of interest or as new points to be scored."""
    s = table(spark, folder, "supplier")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return s.select(
        key.alias("site"),
        nation.cast("string").alias("coarse"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("site_balance"),
        latitude(key, nation).alias("lat"),
        longitude(key, nation).alias("lng"),
    )


def order_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Per customer figures of orders and line items.

    Line items shrink to one row per order before they meet the orders, and orders to one row per
    customer, each with map-side partial sums.
    """
    lines = (
        table(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum("l_discount").alias("_disc"),
            F.count("l_discount").alias("_lines"),
            F.sum(
                F.when(
                    (F.col("l_returnflag") == "R")
                    & (F.col("l_discount") > 0.08)
                    & (F.col("l_quantity") > 40),
                    F.col("l_extendedprice"),
                )
            ).alias("_bulk"),
        )
    )
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"
    )
    return (
        orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
        .groupBy(F.col("o_custkey").alias("entity"))
        .agg(
            F.sum("o_totalprice").alias("spend"),
            F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice"))).alias("urgent"),
            (F.sum("_disc") / F.sum("_lines")).alias("discount"),
            F.sum("_bulk").alias("bulk"),
            F.count(F.lit(1)).alias("n_orders"),
        )
    )


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Entities with all signals, missing ones null."""
    return entities(spark, folder).join(order_signals(spark, folder), "entity", "left")


# DuckDB text of the same roles, used by the correctness queries.
ENTITY_SQL = """entities AS (
  SELECT c_custkey AS entity, c_nationkey || '/' || c_mktsegment AS fine,
         CAST(c_nationkey AS VARCHAR) AS coarse, c_nationkey AS nation, c_name AS name,
         c_mktsegment AS segment, c_acctbal AS balance,
         10.0::DOUBLE + 4 * (c_nationkey // 5) + ((c_custkey * 7919) % 10007) / 10007.0::DOUBLE AS lat,
         70.0::DOUBLE + 4 * (c_nationkey % 5) + ((c_custkey * 104729) % 10009) / 10009.0::DOUBLE AS lng
  FROM customer)"""

SITE_SQL = """sites AS (
  SELECT s_suppkey AS site, CAST(s_nationkey AS VARCHAR) AS coarse, s_name AS name,
         s_acctbal AS site_balance,
         10.0::DOUBLE + 4 * (s_nationkey // 5) + ((s_suppkey * 7919) % 10007) / 10007.0::DOUBLE AS lat,
         70.0::DOUBLE + 4 * (s_nationkey % 5) + ((s_suppkey * 104729) % 10009) / 10009.0::DOUBLE AS lng
  FROM supplier)"""

SIGNAL_SQL = (
    ENTITY_SQL
    + """, line_sums AS (
  SELECT l_orderkey, sum(l_discount) AS disc, count(l_discount) AS n_lines,
         sum(CASE WHEN l_returnflag = 'R' AND l_discount > 0.08 AND l_quantity > 40
                  THEN l_extendedprice END) AS bulk
  FROM lineitem GROUP BY 1),
order_sums AS (
  SELECT o_custkey AS entity, sum(o_totalprice) AS spend,
         sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END) AS urgent,
         sum(disc) / sum(n_lines) AS discount, sum(bulk) AS bulk, count(*) AS n_orders
  FROM orders LEFT JOIN line_sums ON o_orderkey = l_orderkey GROUP BY 1),
signals AS (
  SELECT e.*, spend, urgent, discount, bulk, n_orders
  FROM entities e LEFT JOIN order_sums o ON e.entity = o.entity)"""
)

LONG_SQL = (
    SIGNAL_SQL
    + """, long AS (
  SELECT entity, fine, coarse, 'balance' AS signal, balance AS value FROM signals WHERE balance IS NOT NULL
  UNION ALL SELECT entity, fine, coarse, 'spend', spend FROM signals WHERE spend IS NOT NULL
  UNION ALL SELECT entity, fine, coarse, 'discount', discount FROM signals WHERE discount IS NOT NULL
  UNION ALL SELECT entity, fine, coarse, 'urgent', urgent FROM signals WHERE urgent IS NOT NULL
  UNION ALL SELECT entity, fine, coarse, 'bulk', bulk FROM signals WHERE bulk IS NOT NULL)"""
)

Z_SQL = (
    LONG_SQL
    + """, bounds AS (
  SELECT signal, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM long GROUP BY 1),
clipped AS (
  SELECT entity, fine, coarse, signal, greatest(least(value, hi), lo) AS value FROM long JOIN bounds USING (signal)),
moments AS (SELECT signal, avg(value) AS m, stddev_pop(value) AS s FROM clipped GROUP BY 1),
zs AS (
  SELECT entity, fine, coarse, signal, value, CASE WHEN s > 0 THEN (value - m) / s ELSE 0 END AS z
  FROM clipped JOIN moments USING (signal)),
weights(signal, w) AS (VALUES ('balance', 0.25::DOUBLE), ('spend', 0.23::DOUBLE),
  ('discount', 0.15::DOUBLE), ('urgent', 0.10::DOUBLE), ('bulk', 0.08::DOUBLE))"""
)

SCORE_SQL = (
    Z_SQL
    + """, raw_scores AS (
  SELECT entity, sum(w * z) / sum(w) AS c, count(*) AS k FROM zs JOIN weights USING (signal) GROUP BY 1),
scores AS (
  SELECT entity, c, round_even(c, 3) AS composite_z,
         CAST(round_even(greatest(least(100 + 30 * c, 200), 40), 0) AS INTEGER) AS "index",
         k || '/5' AS coverage
  FROM raw_scores)"""
)
