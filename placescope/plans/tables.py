"""Queries of table maintenance, export and served tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from placescope.operators import filters, score, tables
from placescope.plans import roles
from placescope.plans.catalog import Catalog
from placescope.plans.roles import SCORE_SQL, WEIGHTS
from placescope.plans.scoring import MONEY_SQL, scored, z_table
from placescope.session import fresh_path
from placescope.sources import store

CATALOG = Catalog()

# Two thirds of the customers are stored; the others and all orders come in, so that every row is on one side.
BASE_SQL = "base AS (SELECT c_custkey AS entity, c_name AS name, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0)"
INCOMING_SQL = """incoming AS (SELECT entity, round(max(balance), 2) AS balance, count(*) AS n FROM
(SELECT o_custkey AS entity, o_totalprice AS balance FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0) GROUP BY 1)"""


def base(spark, sf):
    c = roles.table(spark, sf, "customer").where("c_custkey % 3 <> 0")
    return c.select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))


def incoming(spark, sf):
    o = roles.table(spark, sf, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_totalprice").alias("balance"))
    c = roles.table(spark, sf, "customer").where("c_custkey % 3 = 0").select("c_custkey", "c_acctbal")
    return o.union(c).groupBy("entity").agg(F.round(F.max("balance"), 2).alias("balance"), F.count(F.lit(1)).alias("n"))


@CATALOG.query(
    "snk1_sorted_export",
    f'WITH {MONEY_SQL} SELECT entity, "index", est_monthly_income_hh FROM ranked',
)
def snk1(spark, sf):
    """Scores written as sorted CSV and JSON; the CSV read back is the result."""
    s = scored(spark, sf)
    columns = ("entity", "index", "est_monthly_income_hh")
    order = [F.col("index").desc(), F.col("entity")]
    path = fresh_path(spark, "export")
    store.export_csv(s, f"{path}/csv", columns, order)
    return spark.read.option("header", True).schema(
        "entity long, index int, est_monthly_income_hh double"
    ).csv(f"{path}/csv")


@CATALOG.query(
    "snk1_json_envelope",
    f"WITH {SCORE_SQL} SELECT count(*) AS count, 'scores' AS source FROM scores",
)
def snk1_json(spark, sf):
    path = fresh_path(spark, "export")
    s = score.composite(z_table(spark, sf), "entity", WEIGHTS)
    store.export_json(s, path, ("entity", "index"), [F.col("index").desc(), F.col("entity")], "scores")
    return spark.read.schema("count long, source string").json(f"{path}/envelope")


@CATALOG.query(
    "snk2_append_new",
    f"""WITH {BASE_SQL}, {INCOMING_SQL} SELECT entity, name, balance FROM base
UNION ALL SELECT entity, NULL, balance FROM incoming WHERE entity NOT IN (SELECT entity FROM base)""",
)
def snk2(spark, sf):
    return tables.append_new(base(spark, sf), incoming(spark, sf), "entity")


@CATALOG.query(
    "snk3_merge_authoritative",
    """SELECT p_name AS key, min(p_retailprice) AS price FROM part WHERE p_size <= 25 GROUP BY 1
UNION ALL SELECT p_name || ' ' || p_brand, min(p_retailprice) FROM part WHERE p_size > 25 GROUP BY 1""",
)
def snk3(spark, sf):
    """Small parts are the repo, the others the backup, which also has the repo's keys and an empty key."""
    p = roles.table(spark, sf, "part")
    repo = p.where("p_size <= 25").groupBy(F.col("p_name").alias("key")).agg(F.min("p_retailprice").alias("price"))
    longer = F.concat_ws(" ", "p_name", "p_brand")
    backup = p.where("p_size > 25").groupBy(longer.alias("key")).agg(F.min("p_retailprice").alias("price"))
    empty = backup.agg(F.lit("").alias("key"), F.min("price").alias("price"))
    backup = backup.unionByName(empty).unionByName(repo.withColumn("price", F.lit(0.0)))
    return tables.merge_authoritative(repo, backup, "key")


@CATALOG.query(
    "snk4_update_existing",
    f"WITH {BASE_SQL}, {INCOMING_SQL} SELECT entity, name, coalesce(i.balance, b.balance) AS balance FROM base b LEFT JOIN incoming i USING (entity)",
)
def snk4(spark, sf):
    return tables.update_existing(base(spark, sf), incoming(spark, sf), "entity")


@CATALOG.query(
    "snk5_fill_gaps",
    f"""WITH {BASE_SQL}, {INCOMING_SQL}, b2 AS (SELECT entity, name, CASE WHEN balance > 5000 THEN balance END AS balance FROM base),
i AS (SELECT * FROM incoming)
SELECT coalesce(b2.entity, i.entity) AS entity, name, coalesce(b2.balance, i.balance) AS balance, n FROM b2 FULL JOIN i ON b2.entity = i.entity""",
)
def snk5(spark, sf):
    b = base(spark, sf).withColumn("balance", F.when(F.col("balance") > 5000, F.col("balance")))
    return tables.fill_gaps(b, incoming(spark, sf), "entity")


@CATALOG.query(
    "snk6_upsert_latest",
    """SELECT user_id AS key, arg_max(event_type, (ts, w, event_id)) AS name, arg_max(value, (ts, w, event_id)) AS figure FROM
(SELECT *, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS w FROM events) GROUP BY 1""",
)
def snk6(spark, sf):
    """Purchases upserted over all other events, committed as table versions; the second reads the first."""
    e = roles.table(spark, sf, "events")

    def rows(condition):
        r = e.where(condition)
        newest = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id")).alias("_p")
        return r.groupBy(F.col("user_id").alias("key")).agg(F.max("ts").alias("updated_at"), newest).select(
            "key", F.col("_p.event_type").alias("name"), F.col("_p.value").alias("figure"), "updated_at"
        )

    path = fresh_path(spark, "upsert")
    store.commit(rows("event_type <> 'purchase'"), path)
    current = store.read_current(spark, path)
    done = store.commit(tables.upsert_latest(current, rows("event_type = 'purchase'"), "key", "updated_at"), path)
    return done.select("key", "name", "figure")


@CATALOG.query(
    "snk6_upsert_validated",
    """WITH raw AS (SELECT user_id AS key, ts, event_id, event_type, CASE WHEN event_id % 7 = 0 THEN 'n/a' WHEN event_id % 11 = 0 THEN 'None' ELSE CAST(CAST(value * 1000 AS BIGINT) AS VARCHAR) END AS figure FROM events),
cur AS (SELECT key, max(ts) AS updated_at, 'stored' AS name FROM raw WHERE event_type <> 'purchase' GROUP BY 1),
inc AS (SELECT key, arg_max(event_id, event_id) AS event_id, arg_max(TRY_CAST(figure AS BIGINT), event_id) AS figure FROM
  (SELECT key, event_id, coalesce(TRY_CAST(figure AS BIGINT), -1) AS figure FROM raw WHERE event_type = 'purchase' AND event_id % 7 <> 0) GROUP BY 1)
SELECT coalesce(cur.key, inc.key) AS key, CASE WHEN inc.key IS NULL THEN 'stored' ELSE 'incoming' END AS name, nullif(inc.figure, -1) AS figure FROM cur FULL JOIN inc ON cur.key = inc.key""",
)
def snk6_validated(spark, sf):
    """Purchases with text figures over all other events: bad rows are skipped, the last good one of a key wins even if it is older."""
    e = roles.table(spark, sf, "events").withColumnRenamed("user_id", "key")
    figure = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 11 == 0, "None").otherwise((F.col("value") * 1000).cast("long").cast("string"))
    stored = e.where("event_type <> 'purchase'").groupBy("key").agg(F.max("ts").alias("updated_at"))
    stored = stored.select("key", F.lit("stored").alias("name"), F.lit(None).cast("long").alias("figure"), "updated_at")
    raw = e.where("event_type = 'purchase'").select("key", F.lit("incoming").alias("name"), figure.alias("figure"), F.col("ts").alias("updated_at"), "event_id")
    good, _ = tables.valid_rows(raw, {"key": "long"}, {"figure": "long"})
    path = fresh_path(spark, "upsert")
    store.commit(stored, path)
    done = store.commit(tables.upsert(store.read_current(spark, path), good, "key", F.col("event_id")), path)
    return done.select("key", "name", "figure")


@CATALOG.query(
    "snk7_insert_ignore",
    "SELECT event_id, user_id, event_type AS source, CAST(CAST(value * 1000 AS BIGINT) AS DOUBLE) AS income FROM events WHERE event_type <> 'error'",
)
def snk7(spark, sf):
    """The log re-sent twice with comma numbers and malformed rows: every good event lands once."""
    e = roles.table(spark, sf, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    raw = e.select(
        "event_id", F.concat(text, F.lit("Z")).alias("ts"), "user_id", F.col("event_type").alias("source"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.format_number(F.bround(F.col("value") * 1000), 0)).alias("income"),
    )
    rows = tables.parse_log(raw, "ts", "user_id", "source", ["income"])
    unique = ["ts", "user_id", "source"]
    log = tables.insert_ignore(rows.limit(0), rows.unionByName(rows), unique, "event_id")
    again = tables.insert_ignore(log, rows, unique, "event_id")
    return again.select("event_id", "user_id", "source", "income")


@CATALOG.query(
    "snk8_preserve_added",
    f"""WITH {SCORE_SQL} SELECT entity, "index" FROM scores
UNION ALL SELECT 1000000 + s_suppkey, CAST(100 AS INTEGER) FROM supplier""",
)
def snk8(spark, sf):
    result = score.composite(z_table(spark, sf), "entity", WEIGHTS).select("entity", "index")
    live = roles.table(spark, sf, "supplier").select(
        (1000000 + F.col("s_suppkey")).alias("entity"), F.lit(100).alias("index")
    )
    stored = roles.entities(spark, sf).select("entity", F.lit(1).alias("index")).unionByName(live)
    return tables.preserve_added(result, stored, "entity")


@CATALOG.query(
    "snk9_app_table",
    f"""WITH {MONEY_SQL}, q AS (SELECT quantile_cont(n_orders, 0.95) AS p95 FROM signals)
SELECT entity, name, round(lat, 8) AS lat, round(lng, 8) AS lng, "index", est_monthly_income_hh AS income,
  CASE WHEN n_orders IS NOT NULL THEN round_even(greatest(least(n_orders / p95 * 100, 100), 0), 1) END AS poi FROM ranked JOIN signals USING (entity), q""",
)
def snk9(spark, sf):
    e = roles.entities(spark, sf)
    scores = scored(spark, sf).join(e.select("entity", "lat", "lng"), "entity")
    poi = roles.order_signals(spark, sf).select("entity", F.col("n_orders").alias("poi_per_km2"))
    out = tables.app_table(scores.withColumnRenamed("est_monthly_income_hh", "income"), e, poi, "entity")
    return out.withColumns({"lat": F.round("lat", 8), "lng": F.round("lng", 8)})


@CATALOG.query(
    "snk10_parity",
    """WITH a AS (SELECT c_custkey AS k FROM customer), b AS (SELECT user_id AS k FROM events)
SELECT (SELECT count(*) FROM a) AS rows_a, (SELECT count(*) FROM b) AS rows_b,
  (SELECT count(DISTINCT k) FROM a WHERE k NOT IN (SELECT k FROM b)) AS only_a,
  (SELECT count(DISTINCT k) FROM b WHERE k NOT IN (SELECT k FROM a)) AS only_b""",
)
def snk10(spark, sf):
    a = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))
    return tables.parity(a, roles.table(spark, sf, "events").select(F.col("user_id").alias("k")), "k")


@CATALOG.query(
    "jn8_star_join",
    f"""WITH {MONEY_SQL}, ev AS (SELECT user_id AS entity, count(*) AS n_events, round(sum(value), 2) AS activity FROM events GROUP BY 1)
SELECT entity, name, "index", est_monthly_income_hh, round(spend, 2) AS spend, round(urgent, 2) AS urgent,
  round(discount, 10) AS discount, round(bulk, 2) AS bulk, n_orders, n_events, activity
FROM signals LEFT JOIN ranked USING (entity) LEFT JOIN ev USING (entity)""",
)
def jn8(spark, sf):
    """Core scores left-joined with every signal table; signal rows outside the core are dropped."""
    core = roles.entities(spark, sf).select("entity", "name").join(
        scored(spark, sf).select("entity", "index", "est_monthly_income_hh"), "entity", "left"
    )
    o = roles.order_signals(spark, sf)
    events = roles.table(spark, sf, "events").groupBy(F.col("user_id").alias("entity")).agg(
        F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 2).alias("activity")
    )
    out = tables.star_join(core, [o.select("entity", "spend", "urgent", "discount", "bulk", "n_orders"), events], "entity")
    return out.withColumns(
        {c: F.round(c, d) for c, d in (("spend", 2), ("urgent", 2), ("discount", 10), ("bulk", 2))}
    )


@CATALOG.query(
    "ord3_next_batch",
    """SELECT c_custkey AS entity FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events) ORDER BY 1 LIMIT 60""",
)
def ord3(spark, sf):
    done = roles.table(spark, sf, "events").select(F.col("user_id").alias("entity"))
    return filters.next_batch(roles.entities(spark, sf).select("entity"), done, "entity", 60)


@CATALOG.query(
    "snk1_radius_export",
    f"""WITH {MONEY_SQL}, c AS (SELECT 14.5::DOUBLE AS clat, 74.5::DOUBLE AS clng)
SELECT entity, "index", round(bulk, 2) AS bulk FROM ranked JOIN signals USING (entity), c
WHERE 2 * 6371 * asin(least(1, sqrt(pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lng - clng) / 2), 2)))) <= 400""",
)
def radius_export(spark, sf):
    """Served view: star join, radius filter, sort by score, chosen columns."""
    near = filters.within_radius(roles.signals(spark, sf), 14.5, 74.5, 400)
    view = near.join(scored(spark, sf).select("entity", "index"), "entity")
    chosen = filters.choose_columns(view, ("entity", "index"), ("spend", "bulk"), ("bulk",))
    return chosen.withColumn("bulk", F.round("bulk", 2)).orderBy(F.col("index").desc(), "entity")
