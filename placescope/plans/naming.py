"""Queries of key resolution: names, codes, numbers, filters, matching joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from placescope.functions import fixed_values as fixed
from placescope.functions import names
from placescope.operators import filters, joins, rates
from placescope.plans import roles
from placescope.plans.catalog import Catalog
from placescope.plans.roles import ENTITY_SQL, SIGNAL_SQL

CATALOG = Catalog()


def sql_case(table: dict, expr: str, default: str) -> str:
    """Constant lookup as SQL text."""
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def sql_any(words, expr: str) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


# Nations carry generated names, so known spellings are put on them by key for these queries.
REGION_SPELLINGS = {
    0: "NCT of Delhi", 1: "Pondicherry**", 2: "Daman & Diu", 3: "Jammu  &  Kashmir",
    4: " The Dadra and Nagar Haveli and Daman and Diu ", 5: "Andaman &Nicobar Islands*",
}
GROUP_SPELLINGS = {
    0: "South-West district", 1: "Shahdara", 2: "Bengaluru (Urban)", 3: "Y.S.R.", 4: "Leh-Ladakh",
    5: "Nasik District", 6: "North 24 Praganas",
}


def spelled_nations(spark, sf):
    n = roles.table(spark, sf, "nation")
    key = F.col("n_nationkey")

    def pick(table, default):
        pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
        return F.coalesce(F.element_at(F.create_map(*pairs), key), default)

    return n.select(
        key.alias("nation"),
        pick(REGION_SPELLINGS, F.concat(F.lit("  "), "n_name", F.lit(" & Co* "))).alias("raw_region"),
        pick(GROUP_SPELLINGS, F.concat_ws("-", F.lit("Group"), "n_name")).alias("raw_group"),
    )


def _spelled_sql() -> str:
    def pick(table, default):
        return "CASE n_nationkey " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"

    return f"""spelled AS (SELECT n_nationkey AS nation,
  {pick(REGION_SPELLINGS, "'  ' || n_name || ' & Co* '")} AS raw_region,
  {pick(GROUP_SPELLINGS, "'Group-' || n_name")} AS raw_group FROM nation)"""


SPELLED_SQL = _spelled_sql()
_REGION_BASE = (
    "trim(regexp_replace(regexp_replace(regexp_replace(trim(upper(raw_region)), '\\*+$', ''), "
    "'\\s*&\\s*', ' AND ', 'g'), '\\s+', ' ', 'g'))"
)
REGION_EXPR = sql_case(fixed.REGION_ALIASES, _REGION_BASE, _REGION_BASE)
NORMED_SQL = (
    SPELLED_SQL
    + f""", regioned AS (SELECT *, {REGION_EXPR} AS region_norm FROM spelled),
squeezed AS (SELECT *, regexp_replace(trim(regexp_replace(upper(raw_group), '[^A-Z0-9]+', ' ', 'g')), ' DISTRICT$', '') AS g0 FROM regioned),
suffixed AS (SELECT *, CASE WHEN region_norm = 'DELHI' AND NOT ends_with(g0, 'DELHI') AND g0 <> 'SHAHDARA'
  THEN g0 || ' DELHI' ELSE g0 END AS g1 FROM squeezed),
normed AS (SELECT nation, raw_region, raw_group, region_norm, {sql_case(fixed.GROUP_ALIASES, 'g1', 'g1')} AS group_norm FROM suffixed)"""
)


def normed_nations(spark, sf):
    s = spelled_nations(spark, sf)
    s = s.withColumn("region_norm", names.norm_region(F.col("raw_region")))
    return s.withColumn("group_norm", names.norm_group(F.col("raw_group"), F.col("region_norm")))


def named_members(spark, sf):
    """Entities with the spelled names of their nation: the names are normalised once per nation."""
    return roles.entities(spark, sf).join(normed_nations(spark, sf), "nation")


@CATALOG.query(
    "fn1_norm_region",
    f"WITH {NORMED_SQL}, {ENTITY_SQL} SELECT entity, region_norm FROM entities JOIN normed USING (nation)",
)
def fn1(spark, sf):
    return named_members(spark, sf).select("entity", "region_norm")


@CATALOG.query(
    "fn2_norm_group",
    f"WITH {NORMED_SQL}, {ENTITY_SQL} SELECT entity, group_norm FROM entities JOIN normed USING (nation)",
)
def fn2(spark, sf):
    return named_members(spark, sf).select("entity", "group_norm")


@CATALOG.query(
    "fn3_fold_place",
    """SELECT p_partkey, replace(regexp_replace(lower(regexp_replace('Bengaluru ' || p_name || ' (' || p_type || ')',
  '\\([^)]*\\)', '', 'g')), '[^a-z0-9]', '', 'g'), 'bengaluru', 'bangalore') AS folded FROM part""",
)
def fn3(spark, sf):
    p = roles.table(spark, sf, "part")
    raw = F.concat(F.lit("Bengaluru "), "p_name", F.lit(" ("), "p_type", F.lit(")"))
    return p.select("p_partkey", names.fold_place(raw).alias("folded"))


_OFFICE_STEP = "trim(regexp_replace(trim(regexp_replace({}, '\\s*\\([^)]*\\)\\s*$', '')), '\\s+[A-Z]\\.?O\\.?\\s*$', ''))"
OFFICE_SQL = """offices AS (
  SELECT p_partkey, p_brand, p_size, p_type, p_retailprice,
    CASE WHEN p_size % 3 = 0 THEN 'H.O' WHEN p_size % 3 = 1 THEN 'S.O' ELSE 'B.O' END AS officetype,
    p_name || CASE WHEN p_size % 2 = 0 THEN ' (' || p_type || ')' ELSE '' END
      || CASE WHEN p_size % 3 = 0 THEN ' H.O' WHEN p_size % 3 = 1 THEN ' S.O' ELSE ' B.O' END
      || CASE WHEN p_size % 5 = 0 THEN ' (Central)' ELSE '' END AS officename FROM part)"""


def offices(spark, sf):
    p = roles.table(spark, sf, "part")
    kind = (
        F.when(F.col("p_size") % 3 == 0, "H.O").when(F.col("p_size") % 3 == 1, "S.O").otherwise("B.O")
    )
    inner = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" ("), "p_type", F.lit(")"))).otherwise("")
    outer = F.when(F.col("p_size") % 5 == 0, " (Central)").otherwise("")
    return p.select(
        "p_partkey", "p_brand", "p_size", "p_type", "p_retailprice", kind.alias("officetype"),
        F.concat("p_name", inner, F.lit(" "), kind, outer).alias("officename"),
    )


@CATALOG.query(
    "fn4_clean_office",
    f"""WITH {OFFICE_SQL}, cut AS (SELECT p_partkey, officename,
  CASE WHEN ends_with(officename, ' ' || officetype) THEN left(officename, length(officename) - length(officetype) - 1)
       ELSE officename END AS n0 FROM offices),
once AS (SELECT *, {_OFFICE_STEP.format('n0')} AS n1 FROM cut),
twice AS (SELECT *, {_OFFICE_STEP.format('n1')} AS n2 FROM once)
SELECT p_partkey, coalesce(nullif(n2, ''), officename) AS office FROM twice""",
)
def fn4(spark, sf):
    clean = names.clean_office(F.col("officename"), F.col("officetype"))
    return offices(spark, sf).select("p_partkey", clean.alias("office"))


@CATALOG.query(
    "fn5_trailing_code",
    """SELECT o_orderkey, nullif(regexp_extract(trim('Plot ' || o_custkey || ' Main Road ' ||
   CASE WHEN o_orderstatus = 'P' THEN '' ELSE CAST(100000 + o_orderkey % 900000 AS VARCHAR) END || '" '),
   '(\\d{6})\\s*"?\\s*$', 1), '') AS code FROM orders""",
)
def fn5(spark, sf):
    o = roles.table(spark, sf, "orders")
    code = F.when(F.col("o_orderstatus") == "P", "").otherwise(
        (100000 + F.col("o_orderkey") % 900000).cast("string")
    )
    address = F.concat(F.lit("Plot "), F.col("o_custkey").cast("string"), F.lit(" Main Road "), code, F.lit('" '))
    return o.select("o_orderkey", names.trailing_code(address).alias("code"))


@CATALOG.query(
    "fn6_modal_code",
    """WITH codes AS (SELECT o_custkey AS doc, 100000 + (o_custkey * 37) % 50 + (o_orderkey % 3) AS code FROM orders),
counts AS (SELECT doc, CAST(code AS VARCHAR) AS code, count(*) AS c FROM codes GROUP BY 1, 2)
SELECT doc, arg_min(code, (-c, code)) AS modal_code FROM counts GROUP BY 1""",
)
def fn6(spark, sf):
    """Most frequent code of each entity's texts; one text line per order."""
    o = roles.table(spark, sf, "orders")
    code = (100000 + (F.col("o_custkey") * 37) % 50 + F.col("o_orderkey") % 3).cast("string")
    text = F.concat(F.lit("Deed 012345 for code "), code, F.lit(", sheet 1234567."))
    found = o.select(F.col("o_custkey").alias("doc"), F.explode(names.codes_in(text)).alias("code"))
    return rates.modal(found, "doc", "code", "modal_code").drop("row_count")


@CATALOG.query(
    "fn7_parse_number",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(CAST(l_extendedprice AS BIGINT) AS DOUBLE) END AS parsed,
  CAST(CAST(l_extendedprice AS BIGINT) AS DOUBLE) AS digits FROM lineitem""",
)
def fn7(spark, sf):
    li = roles.table(spark, sf, "lineitem")
    grouped = F.format_number(F.bround("l_extendedprice", 0), 0)
    raw = (
        F.when(F.col("l_returnflag") == "A", F.lit("-"))
        .when(F.col("l_returnflag") == "R", F.concat(grouped, F.lit("[37]")))
        .otherwise(grouped)
    )
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        names.parse_number(raw).alias("parsed"),
        names.digits_number(F.concat(F.lit("Rs "), grouped, F.lit(" only"))).alias("digits"),
    )


_CLASS_TEXT = "lower(concat_ws(' ', p_name, CASE WHEN p_size % 4 = 0 THEN 'Gramin Bank' WHEN p_size % 4 = 1 THEN 'SVC Bank' END, CASE WHEN p_size % 7 = 0 THEN 'Jana SFB' ELSE p_brand END))"


@CATALOG.query(
    "fn8_classify",
    "WITH t AS (SELECT p_partkey, " + _CLASS_TEXT + " AS tags FROM part) SELECT p_partkey, CASE "
    + " ".join(f"WHEN {sql_any(words, 'tags')} THEN '{c}'" for c, words in fixed.OFFICE_CLASSES)
    + " ELSE '' END AS class FROM t",
)
def fn8(spark, sf):
    p = roles.table(spark, sf, "part")
    operator = F.when(F.col("p_size") % 4 == 0, "Gramin Bank").when(F.col("p_size") % 4 == 1, "SVC Bank")
    brand = F.when(F.col("p_size") % 7 == 0, F.lit("Jana SFB")).otherwise(F.col("p_brand"))
    return p.select(
        "p_partkey", names.classify(names.tag_text(F.col("p_name"), operator, brand)).alias("class")
    )


def vehicle_records(spark, sf):
    """line items as vehicle records: fuel by return flag, class by quantity, maker by part key."""
    li = roles.table(spark, sf, "lineitem")
    q, k = F.col("l_quantity"), F.col("l_partkey")
    maker = F.when(k % 11 == 0, "BMW India Pvt").when(k % 13 == 0, "Volvo Car").otherwise("Maruti")
    fuel = F.when(F.col("l_returnflag") == "R", "Electric(BOV)").otherwise("Petrol")
    kind = F.when(q > 30, "LMV").when(q > 10, "MCWG").otherwise("HGV")
    return li.select(
        F.col("l_suppkey").alias("place"), maker.alias("maker"), fuel.alias("fuel"),
        kind.alias("vehicle_class"), (F.col("l_extendedprice") * 25).alias("price"),
    )


VEHICLE_SQL = """vehicles AS (SELECT l_suppkey AS place,
  CASE WHEN l_partkey % 11 = 0 THEN 'BMW India Pvt' WHEN l_partkey % 13 = 0 THEN 'Volvo Car' ELSE 'Maruti' END AS maker,
  CASE WHEN l_returnflag = 'R' THEN 'Electric(BOV)' ELSE 'Petrol' END AS fuel,
  CASE WHEN l_quantity > 30 THEN 'LMV' WHEN l_quantity > 10 THEN 'MCWG' ELSE 'HGV' END AS vehicle_class,
  l_extendedprice * 25 AS price FROM lineitem)"""


@CATALOG.query(
    "fn9_luxury_flag",
    f"WITH {VEHICLE_SQL} SELECT place, count(*) AS n, "
    f"count(*) FILTER (WHERE {sql_any([w.lower() for w in fixed.LUXURY_MAKERS], 'lower(maker)')}) AS maker_luxury, "
    f"count(*) FILTER (WHERE {sql_any(fixed.LUXURY_BRANDS, 'lower(maker)')} OR price >= 2000000) AS any_luxury "
    "FROM vehicles GROUP BY 1",
)
def fn9(spark, sf):
    v = vehicle_records(spark, sf)
    by_maker = names.is_luxury(F.col("maker"), words=fixed.LUXURY_MAKERS)
    return v.groupBy("place").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(by_maker).alias("maker_luxury"),
        F.count_if(names.is_luxury(F.col("maker"), F.col("price"))).alias("any_luxury"),
    )


CODED_SQL = """coded AS (SELECT c_custkey AS entity,
  CAST((10 + (c_custkey * 31) % 80) * 10000 + c_custkey % 10000 AS VARCHAR) AS code FROM customer)"""


def coded_entities(spark, sf):
    """Entities with a six-digit code whose first two digits name a region."""
    e = roles.entities(spark, sf)
    k = F.col("entity")
    return e.withColumn("code", ((10 + (k * 31) % 80) * 10000 + k % 10000).cast("string"))


REGION_CODE_EXPR = sql_case(fixed.PREFIX_REGION, "left(code, 2)", "'XX'")


@CATALOG.query(
    "fn10_region_of_code",
    f"WITH {CODED_SQL} SELECT entity, code, CASE code WHEN '110003' THEN 'NX' ELSE {REGION_CODE_EXPR} END AS region FROM coded",
)
def fn10(spark, sf):
    return coded_entities(spark, sf).select(
        "entity", "code", names.region_of(F.col("code"), {"110003": "NX"}).alias("region")
    )


@CATALOG.query(
    "fn23_synthetic_key",
    f"""WITH {ENTITY_SQL} SELECT entity, 'D' || md5(name || '|' || CAST(round(lat * 1000000) AS BIGINT) || '|' || CAST(round(lng * 1000000) AS BIGINT)) AS new_key FROM entities""",
)
def fn23(spark, sf):
    e = roles.entities(spark, sf)
    return e.select("entity", names.synthetic_key(F.col("name"), F.col("lat"), F.col("lng")).alias("new_key"))


@CATALOG.query(
    "fn25_display_name",
    f"""WITH {ENTITY_SQL} SELECT entity, upper(left(segment, 1)) || lower(substr(segment, 2)) || ', ' ||
  upper(left(n_name, 1)) || lower(substr(n_name, 2)) || ' · ' || entity AS display
FROM entities JOIN nation ON nation = n_nationkey""",
)
def fn25(spark, sf):
    n = roles.table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    shown = names.display_name(F.col("segment"), F.col("n_name"), F.col("entity").cast("string"))
    return roles.entities(spark, sf).join(n, "nation").select("entity", shown.alias("display"))


@CATALOG.query(
    "fn26_fix_band",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '5-10' WHEN '2-HIGH' THEN '10-20'
  ELSE o_orderpriority END AS band FROM orders""",
)
def fn26(spark, sf):
    p = F.col("o_orderpriority")
    mangled = F.when(p == "1-URGENT", "05-Oct").when(p == "2-HIGH", "Oct-20").otherwise(p)
    return roles.table(spark, sf, "orders").select("o_orderkey", names.fix_band(mangled).alias("band"))


@CATALOG.query(
    "flt1_key_membership",
    """SELECT c_custkey AS entity, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
  THEN 'in' ELSE 'out' END AS side FROM customer""",
)
def flt1(spark, sf):
    e = roles.entities(spark, sf).select("entity")
    keys = roles.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("entity")
    )
    inside = filters.include(e, keys, "entity").withColumn("side", F.lit("in"))
    return inside.unionByName(filters.exclude(e, keys, "entity").withColumn("side", F.lit("out")))


_LABELS = "CASE p_type WHEN 'PROMO' THEN 'All-India' WHEN 'SMALL' THEN 'NORTHERN REGION ' WHEN 'LARGE' THEN 'Total of ' || p_name WHEN 'MEDIUM' THEN 'Source: ' || p_name ELSE p_name END"


@CATALOG.query(
    "flt2_total_rows",
    f"""SELECT p_partkey, label FROM (SELECT p_partkey, {_LABELS} AS label FROM part)
WHERE NOT regexp_matches(label, '(?i)all.india|region\\s*$|^total|^note|^source')""",
)
def flt2(spark, sf):
    p = roles.table(spark, sf, "part")
    kind, name = F.col("p_type"), F.col("p_name")
    label = (
        F.when(kind == "PROMO", "All-India")
        .when(kind == "SMALL", "NORTHERN REGION ")
        .when(kind == "LARGE", F.concat(F.lit("Total of "), name))
        .when(kind == "MEDIUM", F.concat(F.lit("Source: "), name))
        .otherwise(name)
    )
    return p.select("p_partkey", label.alias("label")).where(~names.is_total_row(F.col("label")))


@CATALOG.query(
    "flt3_coerce",
    """SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN NULL WHEN 'error' THEN NULL
   WHEN 'signup' THEN NULL ELSE value END AS v, value AS plain FROM events""",
)
def flt3(spark, sf):
    e = roles.table(spark, sf, "events")
    kind, raw = F.col("event_type"), F.col("value").cast("string")
    mixed = (
        F.when(kind == "click", "")
        .when(kind == "view", "NaN")
        .when(kind == "error", "Infinity")
        .when(kind == "signup", "n/a")
        .otherwise(raw)
    )
    return e.select(
        "event_id", names.coerce_number(mixed).alias("v"), names.coerce_number(raw).alias("plain")
    )


@CATALOG.query(
    "flt5_column_opt_in",
    f"WITH {SIGNAL_SQL} SELECT entity, name, lat, lng, round(spend, 2) AS spend, round(bulk, 2) AS bulk FROM signals",
)
def flt5(spark, sf):
    wide = filters.choose_columns(
        roles.signals(spark, sf),
        core=("entity", "name", "lat", "lng"),
        optional=("spend", "urgent", "discount", "bulk"),
        requested=("bulk", "spend", "unknown"),
    )
    return wide.withColumns({c: F.round(c, 2) for c in ("spend", "bulk")})


@CATALOG.query(
    "flt6_lookback",
    """SELECT e.event_id, e.user_id FROM events e WHERE e.event_type IN ('click', 'purchase')
  AND e.ts >= TIMESTAMP '2024-01-10 00:00:00'
  AND e.user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 90)""",
)
def flt6(spark, sf):
    e = roles.table(spark, sf, "events")
    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.when(F.col("event_id") % 2 == 0, "Z").otherwise("+00:00"))
    log = e.select("event_id", "user_id", "event_type", iso.alias("ts_text"))
    done = e.where("event_type = 'error' and value > 90").select("user_id")
    recent = filters.lookback(
        log, "ts_text", F.lit("2024-01-10T00:00:00Z").try_cast("timestamp"), "event_type", ("click", "purchase")
    )
    return filters.exclude(recent, done, "user_id").select("event_id", "user_id")


@CATALOG.query(
    "flt7_plausible_band",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice / l_quantity, 8) AS rate FROM lineitem
WHERE l_quantity > 0 AND l_extendedprice / l_quantity BETWEEN 1000 AND 1800""",
)
def flt7(spark, sf):
    li = roles.table(spark, sf, "lineitem").where("l_quantity > 0")
    rate = F.col("l_extendedprice") / F.col("l_quantity")
    return li.where(filters.plausible(rate, 1000, 1800)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(rate, 8).alias("rate")
    )


@CATALOG.query(
    "flt8_trusted_matches",
    """SELECT o_orderpriority AS priority, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""",
)
def flt8(spark, sf):
    method = F.when(F.col("o_orderstatus") == "F", "exact").when(F.col("o_orderstatus") == "O", "verified_manual").otherwise("fuzzy")
    o = roles.table(spark, sf, "orders").withColumn("match_method", method)
    return filters.trusted(o, "match_method").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n")
    )


@CATALOG.query(
    "set1_union",
    """SELECT 'customer' AS kind, c_custkey AS key, c_nationkey AS nation FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier""",
)
def set1(spark, sf):
    c = roles.table(spark, sf, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation")
    )
    s = roles.table(spark, sf, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation")
    )
    return c.unionByName(s)


@CATALOG.query(
    "set2_difference_intersection",
    """SELECT 'both' AS side, key FROM (SELECT DISTINCT c_custkey AS key FROM customer INTERSECT SELECT user_id FROM events)
UNION ALL SELECT 'left', key FROM (SELECT DISTINCT c_custkey AS key FROM customer EXCEPT SELECT user_id FROM events)""",
)
def set2(spark, sf):
    c = roles.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))
    u = roles.table(spark, sf, "events").select(F.col("user_id").alias("key"))
    both = c.intersect(u).withColumn("side", F.lit("both"))
    return both.unionByName(c.subtract(u).withColumn("side", F.lit("left")))


@CATALOG.query(
    "set3_precedence_union",
    """SELECT key, name, 'official' AS layer FROM (SELECT s_suppkey AS key, s_name AS name FROM supplier)
UNION ALL SELECT c_custkey, c_name, 'cached' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)""",
)
def set3(spark, sf):
    a = roles.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("official").alias("layer")
    )
    b = roles.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("cached").alias("layer")
    )
    return filters.precedence_union(a, b, "key")


@CATALOG.query(
    "jn5_two_path",
    f"""WITH {ENTITY_SQL}, survey AS (SELECT 'N' || c_nationkey AS grp, round(avg(c_acctbal), 2) AS value FROM customer GROUP BY 1),
curated AS (SELECT entity, CASE WHEN balance > 8000 THEN 'N' || nation ELSE 'none' END AS grp FROM entities WHERE balance > 5000),
crosswalk AS (SELECT n_name AS postal, 'N' || n_nationkey AS grp,
  CASE WHEN n_regionkey < 2 THEN 'exact' WHEN n_regionkey = 2 THEN 'verified_manual' ELSE 'fuzzy' END AS match_method FROM nation),
a AS (SELECT entity, c.grp, value FROM curated c LEFT JOIN survey s ON c.grp = s.grp),
b AS (SELECT entity, x.grp, value FROM entities e JOIN nation ON nation = n_nationkey
  JOIN crosswalk x ON x.postal = n_name JOIN survey s ON s.grp = x.grp
  WHERE match_method IN ('exact', 'verified_manual') AND entity NOT IN (SELECT entity FROM curated))
SELECT entity, grp AS "group", value FROM a UNION ALL SELECT * FROM b""",
)
def jn5(spark, sf):
    e = roles.entities(spark, sf)
    n = roles.table(spark, sf, "nation")
    code = lambda c: F.concat(F.lit("N"), F.col(c).cast("string"))
    survey = e.groupBy(code("nation").alias("group")).agg(F.round(F.avg("balance"), 2).alias("value"))
    curated = e.where("balance > 5000").select(
        "entity", F.when(F.col("balance") > 8000, code("nation")).otherwise("none").alias("group")
    )
    method = (
        F.when(F.col("n_regionkey") < 2, "exact").when(F.col("n_regionkey") == 2, "verified_manual").otherwise("fuzzy")
    )
    crosswalk = n.select(
        F.col("n_name").alias("postal"), code("n_nationkey").alias("group"), method.alias("match_method")
    )
    directory = e.join(n, e.nation == n.n_nationkey).select("entity", F.col("n_name").alias("postal"))
    return joins.two_path(curated, directory, crosswalk, survey, "entity")


KEY_FIXES = {("BUILDING", "3"): ("MACHINERY", "4"), ("FURNITURE", "7"): ("HOUSEHOLD", "7")}


@CATALOG.query(
    "jn6_key_fixes",
    f"""WITH {ENTITY_SQL} SELECT entity,
  CASE WHEN segment = 'BUILDING' AND coarse = '3' THEN 'MACHINERY' WHEN segment = 'FURNITURE' AND coarse = '7' THEN 'HOUSEHOLD' ELSE segment END AS segment,
  CASE WHEN segment = 'BUILDING' AND coarse = '3' THEN '4' ELSE coarse END AS coarse FROM entities""",
)
def jn6(spark, sf):
    e = roles.entities(spark, sf).select("entity", "segment", "coarse")
    return joins.apply_key_fixes(e, KEY_FIXES, "segment", "coarse")


@CATALOG.query(
    "jn7_prefer_first",
    """WITH c AS (SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer)
SELECT coalesce(c_custkey, s_suppkey * 40) AS key, coalesce(c_name, s_name) AS name, coalesce(balance, s_acctbal) AS balance
FROM c FULL JOIN supplier ON c_custkey = s_suppkey * 40 WHERE coalesce(balance, s_acctbal) IS NOT NULL""",
)
def jn7(spark, sf):
    """A customer's balance counts where it is positive; every 40th key has a supplier to fall back on."""
    c = roles.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance")
    )
    s = roles.table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 40).alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return joins.prefer_first(c, s, "key", ("name", "balance"), ("balance",)).orderBy("key")


# "idge" stands inside a word, the next two span words.
LISTED_WORDS = ("small bolt", "red gear", "idge", "ring", "gear", "bolt", "red", "small")


@CATALOG.query(
    "jn11_keyword_lookup",
    "SELECT p_partkey, CASE " + " ".join(f"WHEN contains(lower(p_name), '{w}') THEN '{w}'" for w in LISTED_WORDS)
    + " END AS word FROM part",
)
def jn11(spark, sf):
    p = roles.table(spark, sf, "part").select("p_partkey", "p_name")
    return joins.keyword_lookup(p, "p_name", LISTED_WORDS, "word").select("p_partkey", "word")


def misspelled(name, key):
    """Every third name loses a letter, every third doubles one, the rest gain an ending."""
    return (
        F.when(key % 3 == 0, F.concat(F.left(name, F.lit(4)), F.substring(name, 6, 100)))
        .when(key % 3 == 1, F.concat(F.left(name, F.lit(3)), F.substring(name, 3, 100)))
        .otherwise(F.concat(name, F.lit("a")))
    )


@CATALOG.query("jn10_match_names")
def jn10(spark, sf):
    """Misspelled part names against the clean list, matched in three tiers."""
    p = roles.table(spark, sf, "part")
    clean = names.fold_place(F.col("p_name"))
    left = p.select(misspelled(clean, F.col("p_partkey")).alias("left_name")).distinct()
    return joins.match_names(left, p.select(clean.alias("right_name")).distinct())


@CATALOG.query("agg7_matched_mean")
def agg7(spark, sf):
    """Mean figure of the matched children per parent, by name matching."""
    p = roles.table(spark, sf, "part")
    folded = names.fold_place(F.col("p_name"))
    income = p.groupBy(folded.alias("right_name")).agg(F.avg("p_retailprice").alias("income"))
    children = p.select(
        misspelled(folded, F.col("p_partkey")).alias("left_name"), F.col("p_brand").alias("parent")
    ).distinct()
    matched = joins.match_names(children.select("left_name").distinct(), income.select("right_name"))
    return (
        children.join(matched, "left_name")
        .join(income, "right_name")
        .groupBy("parent")
        .agg(F.round(F.avg("income"), 4).alias("mean_income"), F.count(F.lit(1)).alias("n"))
    )
