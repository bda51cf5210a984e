"""Queries of the format readers and of field harvesting from texts.

Each reader query first writes one of the given tables in the format at hand with Spark, in bounded
documents, and then reads it back through the reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from placescope.functions import fixed_values as fixed
from placescope.functions import harvest, names
from placescope.operators import rates, stats
from placescope.plans import roles
from placescope.plans.catalog import Catalog
from placescope.plans.roles import ENTITY_SQL, LONG_SQL
from placescope.session import fresh_path
from placescope.sources import readers

CATALOG = Catalog()

# Rows per written document.
CHUNK = 500


def documents(df: DataFrame, key: str, line, head: str, chunk: int = CHUNK, by: tuple = ()) -> DataFrame:
    """Bounded text documents: a head and the sorted lines of ``chunk`` consecutive keys."""
    rows = df.select(*by, F.floor(F.col(key) / chunk).alias("doc"), F.struct(F.col(key), line.alias("line")).alias("_r"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["line"]), "\n")
    return rows.groupBy(*by, "doc").agg(F.concat(F.lit(head), body).alias("text"))


def write_files(docs: DataFrame, path: str, *parts: str) -> str:
    """One file per document."""
    docs.write.partitionBy(*parts).text(path)
    return f"{path}" + "/*" * len(parts)


@CATALOG.query("src1_signal_csv", f"WITH {LONG_SQL} SELECT entity, signal, round(value, 2) AS value FROM long")
def src1(spark, sf):
    """All signal files are read; one more is absent and another lacks the wanted column."""
    path = fresh_path(spark, "signals")
    s = roles.signals(spark, sf)
    for name in roles.SIGNALS:
        s.where(F.col(name).isNotNull()).select("entity", F.round(name, 2).alias(name)).write.option("header", True).csv(f"{path}/{name}")
    s.select("entity", "segment").write.option("header", True).csv(f"{path}/segment")
    long = None
    for name in (*roles.SIGNALS, "absent", "segment"):
        column = "value" if name == "segment" else name
        df = readers.read_signal(spark, f"{path}/{name}", f"{column} double", "entity", [column])
        if df is not None:
            part = stats.to_long(df.withColumn("entity", F.col("entity").cast("long")), "entity", [column])
            long = part if long is None else long.unionByName(part)
    return long


@CATALOG.query("src2_commented_csv", f"WITH {ENTITY_SQL} SELECT entity, segment, balance FROM entities")
def src2(spark, sf):
    path = fresh_path(spark, "commented")
    line = F.concat_ws(",", F.col("entity").cast("string"), "segment", F.col("balance").cast("string"))
    docs = documents(roles.entities(spark, sf), "entity", line, "# source note\n# unit: rupees\nentity,segment,balance\n", 20_000)
    files = write_files(docs, path, "doc")
    return readers.read_commented(spark, files, "entity long, segment string, balance double")


@CATALOG.query(
    "src3_sectioned_text",
    f"WITH {ENTITY_SQL} SELECT segment AS district, coarse AS state_code, round(balance, 2) AS rate FROM entities",
)
def src3(spark, sf):
    path = fresh_path(spark, "sections")
    head = "# rates by state\n# state,rate\nALL,0.25\nX,1\n\n# district,state_code,est_filer_rate\n"
    line = F.concat(
        F.concat_ws(",", "segment", "coarse", F.col("balance").cast("string")),
        F.when(F.col("entity") % 3 == 0, F.lit("\n# remark\nshort,row")).otherwise(""),
    )
    docs = documents(roles.entities(spark, sf), "entity", line, head, 20_000, by=("segment",)).withColumnRenamed("segment", "part")
    files = write_files(docs, path, "part", "doc")
    rows = readers.read_section(
        spark, files, "district,state_code,est_filer_rate",
        {"district": "string", "state_code": "string", "rate": "double"},
    )
    return rows.select("district", "state_code", F.round("rate", 2).alias("rate"))


@CATALOG.query(
    "src4_header_discovery",
    f"WITH {ENTITY_SQL} SELECT entity AS pos_key, segment AS state, round(balance, 2) AS schools FROM entities",
)
def src4(spark, sf):
    """Grids with a title, differing header wordings and total rows, one wording per segment."""
    path = fresh_path(spark, "grids")
    e = roles.entities(spark, sf)
    line = F.concat_ws(
        ";",
        F.col("entity").cast("string"), F.col("segment"),
        F.when(F.col("entity") % 2 == 0, F.concat(F.col("balance").cast("string"), F.lit(" "))).otherwise(F.col("balance").cast("string")),
        F.lit("7"),
    )
    title = "TABLE 155: STATE-WISE SCHOOLS AND OTHER FIGURES OF ALL KINDS;;;\n"
    a = documents(e.where("nation < 12"), "entity", line, title + "Sl. No.;Region/State/Union Territory;Total No. of Schools;Schools per head\n;All India;99;1\n", 20_000)
    b = documents(e.where("nation >= 12"), "entity", line, title + "\nSl. No.;State/UT;No. of Schools;x\n", 20_000)
    docs = a.withColumn("part", F.lit("a")).unionByName(b.withColumn("part", F.lit("b")))
    files = write_files(docs, path, "part", "doc")
    rows = readers.read_grids(
        spark, files, "state",
        {"state": ("state/ut", "state", "ut"), "schools": ("total no. of school", "no. of schools", "schools"), "pos_key": ("sl. no",)},
        sep=";",
    )
    rows = rows.where(~names.is_total_row(F.col("state")))
    return rows.select(
        F.col("pos_key").try_cast("long").alias("pos_key"), "state",
        F.round(names.parse_number(F.col("schools")), 2).alias("schools"),
    )


@CATALOG.query(
    "src5_piped_master",
    """WITH b AS (SELECT CAST(100000 + o_custkey AS VARCHAR) AS code, o_orderpriority AS district, count(*) AS c FROM orders
  WHERE o_orderstatus <> 'P' AND o_custkey % 5 <> 0 GROUP BY 1, 2)
SELECT code, arg_min(upper(district), (-c, upper(district))) AS district, CAST(sum(c) AS BIGINT) AS branch_count FROM b GROUP BY 1""",
)
def src5(spark, sf):
    """A quoted pipe file set: branches with a code at the end of the address, counted per code."""
    path = fresh_path(spark, "piped")
    o = roles.table(spark, sf, "orders")
    code = F.when(F.col("o_custkey") % 5 != 0, (100000 + F.col("o_custkey")).cast("string")).otherwise("")
    fixed_cols = {2: F.lit("STATE"), 3: F.col("o_orderpriority"), 7: F.lit("Bank | Co"),
                  15: F.concat(F.lit('Shop "1", Road | lane '), code), 16: F.when(F.col("o_orderstatus") == "P", "ATM").otherwise("Branch ")}
    o.select(*[fixed_cols.get(i, F.col("o_orderkey").cast("string")).alias(f"c{i}") for i in range(17)]).write.option(
        "sep", "|"
    ).option("header", True).option("escape", '"').csv(path)
    rows = readers.read_piped(
        spark, f"{path}/*.csv", 17, {"state": 2, "district": 3, "bank": 7, "address": 15, "channel": 16}
    )
    branches = rows.where(F.upper(F.trim("channel")) == "BRANCH").select(
        names.trailing_code(F.col("address")).alias("code"), F.upper(F.trim("district")).alias("district")
    ).where("code is not null")
    return rates.modal(branches, "code", "district", "district").withColumnRenamed("row_count", "branch_count")


@CATALOG.query(
    "src6_staged_concat",
    """SELECT 'customer' AS kind, c_custkey AS key, c_acctbal AS balance FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier""",
)
def src6(spark, sf):
    path = fresh_path(spark, "concat")
    for name, p in (("customer", "c_custkey c_acctbal"), ("supplier", "s_suppkey s_acctbal")):
        key, bal = p.split()
        roles.table(spark, sf, name).select(
            F.lit(name).alias("kind"), F.col(key).alias("key"), F.col(bal).alias("balance")
        ).write.option("header", True).csv(f"{path}/{name}")
    schema = "kind string, key long, balance double"
    sources = [f"{path}/customer", f"{path}/supplier"]
    readers.read_many(spark, sources, schema, f"{path}/staged")
    return readers.read_many(spark, sources, schema, f"{path}/staged")


@CATALOG.query(
    "src7_parquet_predicate",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000",
)
def src7(spark, sf):
    o = roles.table(spark, sf, "orders")
    return o.where("o_orderpriority = '1-URGENT' and o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@CATALOG.query(
    "src8_nested_payload",
    "SELECT p_partkey, p_name AS name, CASE WHEN p_size % 4 = 0 THEN 0 ELSE p_retailprice END AS amount FROM part",
)
def src8(spark, sf):
    p = roles.table(spark, sf, "part")
    metric = lambda kind, v: F.struct(F.lit(kind).alias("type"), F.lit(1).alias("count"), v.alias("amount"))
    metrics = F.when(F.col("p_size") % 4 == 0, F.array(metric("PARTIAL", F.col("p_retailprice")))).otherwise(
        F.array(metric("PARTIAL", F.lit(1.0)), metric("TOTAL", F.col("p_retailprice")))
    )
    entry = F.struct(F.col("p_name").alias("name"), metrics.alias("metric"))
    payload = F.to_json(F.struct(F.struct(F.array(entry).alias("hoverDataList")).alias("data")))
    return readers.explode_payload(p.select("p_partkey", payload.alias("payload")), "payload", ["p_partkey"])


@CATALOG.query(
    "src9_json_matrix",
    f"WITH {ENTITY_SQL} SELECT round(lat, 8) AS lat, round(lng, 8) AS lng, balance AS metric, name AS label FROM entities",
)
def src9(spark, sf):
    e = roles.entities(spark, sf)
    row = F.array(*[F.col(c).cast("string") for c in ("lat", "lng", "balance", "name")])
    docs = e.groupBy(F.floor(F.col("entity") / CHUNK).alias("doc")).agg(F.to_json(F.collect_list(row)).alias("payload"))
    out = readers.explode_matrix(docs, "payload", [])
    return out.withColumns({c: F.round(c, 8) for c in ("lat", "lng")})


def square(lat, lng, half: float):
    """Closed square ring around a point as [lng, lat] pairs."""
    corner = lambda dx, dy: F.array(lng + F.lit(dx * half), lat + F.lit(dy * half))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


@CATALOG.query(
    "src10_geojson",
    f"WITH {ENTITY_SQL} SELECT CAST(entity AS VARCHAR) AS code, CAST(CASE WHEN entity % 10 = 0 THEN 2 ELSE 1 END AS INTEGER) AS parts, round(lng - 0.01, 6) AS west FROM entities WHERE balance >= 0",
)
def src10(spark, sf):
    """Mixed polygons and multipolygons; features without a key or a geometry are dropped."""
    path = fresh_path(spark, "geojson")
    e = roles.entities(spark, sf)
    ring = square(F.col("lat"), F.col("lng"), 0.01)
    far = square(F.col("lat") + 1, F.col("lng") + 1, 0.02)
    poly = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))
    multi = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(ring), F.array(far)).alias("coordinates")))
    geometry = F.when(F.col("balance") < -500, "null").when(F.col("entity") % 10 == 0, multi).otherwise(poly)
    key = F.when(F.col("balance").between(-500, -0.001), "").otherwise(F.col("entity").cast("string"))
    feature = F.concat(
        F.lit('{"type":"Feature","properties":{"code":"'), key, F.lit('"},"geometry":'), geometry, F.lit("}")
    )
    docs = e.groupBy(F.floor(F.col("entity") / CHUNK).alias("doc")).agg(F.array_join(F.collect_list(feature), ",").alias("f"))
    docs.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value")).write.text(path)
    rows = readers.read_geojson(spark, path, "code", per_line=True)
    west = F.array_min(F.transform(F.col("parts")[0][0], lambda p: p[0]))
    return rows.select("code", F.size("parts").alias("parts"), F.round(west, 6).alias("west"))


@CATALOG.query(
    "src11_html_tables",
    """SELECT 'Area ' || c_mktsegment || ' (AB)' AS heading, c_name AS name, CAST(1000 + c_custkey AS DOUBLE) AS population FROM customer""",
)
def src11(spark, sf):
    """Pages with one section and table per segment; only matching headings count."""
    c = roles.table(spark, sf, "customer")
    row = F.concat(
        F.lit("<tr><td><a href='#'>"), "c_name", F.lit("</a>[a]</td><td>"),
        F.format_number(1000 + F.col("c_custkey"), 0), F.lit("[37]</td></tr>"),
    )
    section = c.groupBy(F.floor(F.col("c_custkey") / CHUNK).alias("page"), "c_mktsegment").agg(
        F.concat(
            F.lit("<h2 id='x'><span>Area "), F.first("c_mktsegment"), F.lit(" (AB)</span></h2><p>text</p><table class='wikitable sortable'><tr><th>District</th><th>Population</th></tr>"),
            F.array_join(F.collect_list(row), ""), F.lit("</table><table class='wikitable'><tr><td>second</td><td>1</td></tr></table>"),
        ).alias("s")
    )
    pages = section.groupBy("page").agg(
        F.concat(F.lit("<html><h2>Contents</h2><table class='wikitable'><tr><td>no</td><td>1</td></tr></table>"), F.array_join(F.collect_list("s"), "\n")).alias("html")
    )
    rows = readers.tables_by_heading(pages, "html", r"^Area [A-Z]+ \([A-Z]{2}\)$", ["page"])
    data = rows.where("row > 0")
    return data.select(
        "heading", F.col("cells")[0].alias("name"), names.parse_number(F.col("cells")[1]).alias("population")
    )


@CATALOG.query(
    "src12_paged_records",
    "SELECT CAST(100000 + o_orderkey AS VARCHAR) AS pincode, o_orderpriority AS officename FROM orders WHERE o_orderstatus <> 'P'",
)
def src12(spark, sf):
    path = fresh_path(spark, "records")
    o = roles.table(spark, sf, "orders")
    code = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise((100000 + F.col("o_orderkey")).cast("string"))
    record = F.struct(code.alias("pincode"), F.col("o_orderpriority").alias("officename"))
    batches = o.groupBy(F.floor(F.col("o_orderkey") / CHUNK).alias("batch")).agg(F.collect_list(record).alias("records"))
    batches.select(F.lit(0).cast("long").alias("total"), "records").write.json(path)
    return readers.read_pages_of_records(spark, path, "pincode:string,officename:string", "pincode", r"^\d{6,}$")


@CATALOG.query(
    "src13_sample_means",
    "SELECT user_id AS key, round_even(avg(value + 0.00037), 1) AS radiance FROM events WHERE event_type <> 'error' AND value + 0.00037 > 0 GROUP BY 1",
)
def src13(spark, sf):
    e = roles.table(spark, sf, "events")
    raw = F.when(F.col("event_type") == "error", "-9999").otherwise((F.col("value") + 0.00037).cast("string"))
    return readers.mean_of_samples(e.select(F.col("user_id").alias("key"), raw.alias("v")), "key", "v", "radiance")


@CATALOG.query(
    "fn11_land_record",
    """WITH r AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'high' WHEN p_size % 5 = 4 THEN 'low' ELSE 'medium' END AS k,
  CAST(CAST(p_retailprice * 1000 AS BIGINT) AS DOUBLE) AS amount,
  (p_size * 100) * CASE p_size % 5 WHEN 1 THEN 1.0 WHEN 2 THEN 10.764 ELSE 435.6 END::DOUBLE AS area FROM part),
d AS (SELECT *, CASE WHEN k = 'medium' AND NOT (amount / area BETWEEN 500 AND 500000) THEN 'low' ELSE k END AS confidence FROM r)
SELECT p_partkey, confidence, CASE confidence WHEN 'high' THEN 1234.5 WHEN 'medium' THEN round_even(amount / area, 0) END AS rate_per_sqft,
  CASE WHEN confidence = 'medium' THEN amount END AS transaction_value, CASE WHEN confidence = 'medium' THEN round_even(area, 0) END AS area_sqft FROM d""",
)
def fn11(spark, sf):
    p = roles.table(spark, sf, "part")
    size = F.col("p_size")
    unit = F.when(size % 5 == 1, "sq ft").when(size % 5 == 2, "Sq. M").otherwise("cent")
    text = F.concat(
        F.lit("Deed no. 7. Total consideration: Rs. "), F.format_number(F.floor(F.bround(F.col("p_retailprice") * 1000, 0)), 0),
        F.lit(" only.\n"),
        F.when(size % 5 == 4, "no extent given").otherwise(
            F.concat(F.lit("Total area: "), (size * 100).cast("string"), F.lit(" "), unit)
        ),
        F.when(size % 5 == 0, "\nRate per sq.ft: Rs 1,234.50").otherwise(""),
    )
    out = harvest.land_record(p.select("p_partkey", text.alias("text")), "text")
    return out.drop("text")


@CATALOG.query(
    "fn12_vehicle_record",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE l_returnflag WHEN 'R' THEN 'Electric' ELSE 'Petrol/cng' END AS fuel_type,
  CASE WHEN l_quantity > 30 THEN 'LMV' WHEN l_quantity > 10 THEN 'M-CYCLE' END AS vehicle_class,
  CAST(400000 + l_suppkey AS VARCHAR) AS owner_code,
  CAST(CAST(l_extendedprice AS BIGINT) * 25 AS DOUBLE) AS price,
  (l_partkey % 11 = 0 OR CAST(l_extendedprice AS BIGINT) * 25 >= 2000000) AS is_luxury FROM lineitem""",
)
def fn12(spark, sf):
    li = roles.table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    price = F.format_number(F.bround("l_extendedprice", 0).cast("long") * 25, 0)
    kind = F.when(q > 30, "Vehicle Class: LMV\n").when(q > 10, "vehicle class - M/CYCLE\n").otherwise("class unknown\n")
    text = F.concat(
        F.lit("Registration\nFuel Type : "), F.when(F.col("l_returnflag") == "R", "ELECTRIC").otherwise("petrol/CNG"), F.lit("\n"), kind,
        F.lit("Owner: A B\nAddress: 1 Road, "), (400000 + F.col("l_suppkey")).cast("string"),
        F.lit("\nEx-Showroom Price: Rs. "), price, F.lit("\nMaker "),
        F.when(F.col("l_partkey") % 11 == 0, "Jaguar").otherwise("Tata"),
    )
    out = harvest.vehicle_record(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("text")), "text").drop("text")
    # One spelling per class keeps the two wordings apart from the unit test of the pattern.
    return out.withColumn("vehicle_class", F.regexp_replace("vehicle_class", "/", "-"))


@CATALOG.query(
    "fn13_tax_receipt",
    """SELECT o_orderkey, '2021-2022' AS year, CAST(20000000 + o_orderkey AS VARCHAR) AS receipt_no, '01-04-2021' AS date,
  CAST(o_custkey % 198 AS VARCHAR) AS ward_no, 'SHETTY HALLI' AS ward_name,
  chr(CAST(65 + o_custkey % 6 AS INTEGER)) AS zone,
  ['CBD / prime commercial', 'Near-CBD / premium residential', 'Mid-city residential', 'Outer residential', 'Peripheral residential', 'Far peripheral / semi-rural'][1 + o_custkey % 6] AS zone_label,
  [128, 112, 96, 82, 65, 50][1 + o_custkey % 6] AS index_low, [150, 130, 115, 98, 82, 67][1 + o_custkey % 6] AS index_high,
  '12 Gandhi MAIN ROAD, Shetty Halli' AS property_address, '12 Gandhi MAIN ROAD' AS area_hint,
  CAST(CAST(o_totalprice AS BIGINT) AS DOUBLE) AS property_tax, 10.0 AS cesses, 20.0 AS total_tax,
  CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 4.0 END AS penalty, CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 5.0 END AS interest,
  CASE WHEN o_orderstatus = 'F' THEN 0.0 ELSE 6.0 END AS swm_cess, CASE WHEN o_orderstatus = 'F' THEN 30.5 ELSE 7.0 END AS net_tax_paid FROM orders""",
)
def fn13(spark, sf):
    """Receipts with labelled amounts for status F, with a bare summary row otherwise."""
    o = roles.table(spark, sf, "orders")
    tax = F.bround("o_totalprice", 0).cast("long")
    zone = F.substring(F.lit("ABCDEF"), 1 + F.pmod(F.col("o_custkey"), F.lit(6)).cast("int"), F.lit(1))
    labelled = F.concat(
        F.lit("Property Tax "), F.format_number(tax, 0), F.lit(".00\nCesses 10\nTotal Tax 20\nNet Tax to be Paid 30.5\n")
    )
    row = F.concat(F.lit("2021-2022 "), tax.cast("string"), F.lit(".0 10 20 1 4 5 6 7\n"))
    text = F.concat(
        F.lit("Receipt No. : "), (20000000 + F.col("o_orderkey")).cast("string"), F.lit("\nDate : 01-04-2021\n"),
        F.lit("1234567890 "), (F.col("o_custkey") % 198).cast("string"), F.lit("- SHETTY HALLI (cid:1)\n"),
        F.lit("Tax Paid Year : 2021-2022\nResidential zone classification "), zone, F.lit(" Non Residential zone\n"),
        F.lit("12 Gandhi MAIN ROAD\nProperty Address : Shetty Halli Survey No 4\n"),
        F.when(F.col("o_orderstatus") == "F", labelled).otherwise(row),
    )
    return harvest.tax_receipt(o.select("o_orderkey", text.alias("text")), "text").drop("text")


REPORT_REGIONS = ("Maharashtra", "KARNATAKA", "Delhi", "Uttar Pradesh", "tamil nadu")


@CATALOG.query(
    "fn14_region_rows",
    """WITH r AS (SELECT o_orderkey AS doc, unnest(['maharashtra', 'karnataka', 'delhi', 'uttar pradesh', 'tamil nadu']) AS region,
  unnest([0, 1, 2, 3, 4]) AS i, CAST(o_totalprice AS BIGINT) AS t, o_custkey AS k, year(o_orderdate) AS y FROM orders)
SELECT doc, region, CAST(t + 100 + i AS DOUBLE) AS volume, CAST((k + 10) * 1000 + i AS DOUBLE) AS amount,
  CAST(y + 20 AS VARCHAR) || '-' || right(CAST(y + 21 AS VARCHAR), 2) AS year FROM r""",
)
def fn14(spark, sf):
    """State lines of a report text per order, with the assessment year named in it."""
    o = roles.table(spark, sf, "orders")
    t, k = F.bround("o_totalprice", 0).cast("long"), F.col("o_custkey")
    lines = []
    for i, region in enumerate(REPORT_REGIONS):
        sep = " | " if i % 2 == 0 else "  "
        lines += [F.lit(f"{region}{sep}"), F.format_number(t + 100 + i, 0), F.lit(" | " if i % 2 == 0 else " "),
                  F.format_number((k + 10) * 1000 + i, 0), F.lit("\n")]
    y = F.year("o_orderdate")
    label = F.concat(F.lit("Assessment Year: "), (y + 20).cast("string"), F.lit("-"), F.right((y + 21).cast("string"), F.lit(2)), F.lit("\n"))
    docs = o.select(F.col("o_orderkey").alias("doc"), F.concat(label, F.lit("Delhi | 10 | 10\n"), *lines).alias("text"))
    years = docs.select("doc", harvest.year_guess(F.col("text")).alias("year"))
    return harvest.region_rows(docs, "text", ["doc"]).join(years, "doc")


def _document_sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    year = " , ".join(f"nullif(trim(regexp_extract(text, '{quoted(p)}', 1)), '')" for p in (fixed.YEAR_LABEL_PATTERN, fixed.YEAR_PATTERN))
    whens = " ".join(
        "WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + f" THEN '{c}'"
        for c, words in fixed.OFFICE_CLASSES
    )
    return (
        f"SELECT doc_id, coalesce({year}, '') AS year, CAST(len(regexp_extract_all(text, '\\b([1-9]\\d{{5}})\\b', 1)) AS INTEGER) AS n_codes, "
        f"CASE {whens} ELSE '' END AS class FROM documents"
    )


@CATALOG.query("fn14_codes_in_documents", _document_sql())
def fn14_documents(spark, sf):
    """Whole texts of all documents searched for years, codes and keyword classes."""
    d = roles.table(spark, sf, "documents")
    text = F.col("text")
    return d.select(
        "doc_id",
        harvest.year_guess(text).alias("year"),
        F.size(names.codes_in(text)).alias("n_codes"),
        names.classify(text, fixed.OFFICE_CLASSES).alias("class"),
    )
