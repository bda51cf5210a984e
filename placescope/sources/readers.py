"""Readers of the input formats: keyed CSV, sectioned and ragged text, JSON, GeoJSON, HTML pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from placescope.sources.store import path_exists


def read_signal(
    spark: SparkSession, path: str, schema: str, key: str, columns: Sequence[str], optional: bool = True
) -> DataFrame | None:
    """Key and value columns of a headed CSV; None when the file or all its columns are missing.

    Columns are matched by the file's own header, so files may carry more or fewer of them.
    """
    if optional and not path_exists(spark, path):
        return None
    df = spark.read.option("header", True).csv(path)
    present = [c for c in columns if c in df.columns]
    if key not in df.columns or not present:
        return None
    types = {f.name: f.dataType for f in StructType.fromDDL(schema).fields}
    return df.select(
        F.col(key).cast("string").alias(key), *[F.col(c).try_cast(types[c]).alias(c) for c in present]
    )


def read_commented(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Headed CSV behind a preamble of # lines."""
    return (
        spark.read.option("comment", "#").option("header", True).schema(schema).csv(path)
    )


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of many text files as (file, pos, line); files are split across tasks by file."""
    whole = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value"
    )
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def read_section(spark: SparkSession, path: str, marker: str, columns: Mapping[str, str]) -> DataFrame:
    """Rows after the first comment line that names the marker, in each file.

    Other comment lines and blanks are skipped, short rows dropped. Everything happens inside the
    file's own row, so the marker search needs no shuffle.
    """
    whole = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), "value"
    )
    after = F.regexp_extract("value", r"(?s)(?:^|\n)[ \t]*#[^\n]*" + marker + r"[^\n]*\n(.*)$", 1)
    lines = F.filter(
        F.transform(F.split(after, r"\r?\n"), lambda l: F.trim(l)),
        lambda l: (l != "") & ~l.startswith("#"),
    )
    cells = whole.select("file", F.explode(F.transform(lines, lambda l: F.split(l, ","))).alias("_c"))
    cells = cells.where(F.size("_c") >= len(columns))
    return cells.select(
        "file", *[F.trim(F.col("_c")[i]).try_cast(t).alias(n) for i, (n, t) in enumerate(columns.items())]
    )


def pick_column(header: Column, keywords: Sequence[str]) -> Column:
    """Zero-based position of the first header cell with the longest matching keyword, else null."""
    cells = F.transform(header, lambda c: F.lower(F.trim(c)))

    def first_with(word: str) -> Column:
        flags = F.transform(cells, lambda c: F.contains(c, F.lit(word)))
        return F.nullif(F.array_position(flags, F.lit(True)), F.lit(0).cast("long"))

    ordered = sorted(keywords, key=len, reverse=True)
    return (F.coalesce(*[first_with(w) for w in ordered]) - 1).cast("int")


def read_grids(
    spark: SparkSession,
    path: str,
    header_word: str,
    fields: Mapping[str, Sequence[str]],
    sep: str = ",",
    max_label: int = 40,
) -> DataFrame:
    """Delimited text grids whose header row and columns are found by keyword, file by file.

    The header is the first row with a short cell holding ``header_word``; a long title sentence
    with the word does not count. Each field takes the column of its longest matching keyword.
    """
    lines = text_lines(spark, path).withColumn("cells", F.split("line", sep))
    is_header = F.exists(
        "cells", lambda c: F.contains(F.lower(c), F.lit(header_word)) & (F.length(F.trim(c)) <= max_label)
    )
    headers = (
        lines.where(is_header)
        .groupBy("file")
        .agg(F.min(F.struct("pos", "cells")).alias("_h"))
        .select("file", F.col("_h.pos").alias("_hpos"), F.col("_h.cells").alias("_head"))
    )
    for name, words in fields.items():
        headers = headers.withColumn(f"_at_{name}", pick_column(F.col("_head"), words))
    body = lines.join(headers, "file").where(F.col("pos") > F.col("_hpos"))
    value = lambda n: F.trim(F.get("cells", F.col(f"_at_{n}")))
    return body.select("file", "pos", *[value(n).alias(n) for n in fields]).where(
        F.coalesce(F.col(list(fields)[0]), F.lit("")) != ""
    )


def read_piped(spark: SparkSession, glob: str, min_fields: int, positions: Mapping[str, int]) -> DataFrame:
    """Pipe-delimited quoted files with a header row each; rows with fewer fields are dropped."""
    names = [f"f{i}" for i in range(min_fields)]
    schema = ", ".join(f"{n} string" for n in names) + ", _corrupt string"
    # Without pruning the parser sees all fields of the schema and can tell a short row.
    df = (
        spark.read.option("sep", "|")
        .option("quote", '"')
        .option("escape", '"')
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", "_corrupt")
        .schema(schema)
        .csv(glob, header=True)
    )
    # Longer rows count as corrupt too, but still carry all wanted fields.
    whole = df.where(F.col("_corrupt").isNull() | F.col(names[-1]).isNotNull())
    return whole.select(*[F.col(f"f{i}").alias(n) for n, i in positions.items()])


def read_many(spark: SparkSession, paths: Sequence[str], schema: str, staged: str) -> DataFrame:
    """Several CSV files as one table, written once as Parquet and read from there afterwards."""
    if not path_exists(spark, f"{staged}/_SUCCESS"):
        spark.read.option("header", True).schema(schema).csv(list(paths)).write.mode("overwrite").parquet(staged)
    return spark.read.schema(schema).parquet(staged)


def explode_payload(df: DataFrame, payload: str, keep: Sequence[str]) -> DataFrame:
    """Nested hover payload: one row per entry with the amount of its last TOTAL metric, else 0."""
    schema = (
        "struct<data:struct<hoverDataList:array<struct<name:string,"
        "metric:array<struct<type:string,amount:double>>>>>>"
    )
    entries = df.withColumn("_j", F.from_json(payload, schema)).select(
        *keep, F.explode("_j.data.hoverDataList").alias("_e")
    )
    totals = F.filter("_e.metric", lambda m: m["type"] == "TOTAL")
    amount = F.coalesce(F.try_element_at(totals, F.lit(-1))["amount"], F.lit(0.0))
    return entries.select(*keep, F.col("_e.name").alias("name"), amount.alias("amount"))


def explode_matrix(df: DataFrame, payload: str, keep: Sequence[str]) -> DataFrame:
    """JSON array of [lat, lng, metric, label] rows."""
    rows = df.select(*keep, F.explode(F.from_json(payload, "array<array<string>>")).alias("_r"))
    at = lambda i: F.get("_r", F.lit(i))
    return rows.select(
        *keep,
        at(0).try_cast("double").alias("lat"),
        at(1).try_cast("double").alias("lng"),
        at(2).try_cast("double").alias("metric"),
        at(3).alias("label"),
    )


FEATURE_SCHEMA = (
    "type string, properties map<string,string>, geometry struct<type:string, coordinates:string>"
)


def lift_geometry(kind: Column, coordinates: Column) -> Column:
    """Polygon or MultiPolygon coordinates text as parts of rings of [lng, lat]."""
    polygon = F.from_json(coordinates, "array<array<array<double>>>")
    multi = F.from_json(coordinates, "array<array<array<array<double>>>>")
    return F.when(kind == "Polygon", F.array(polygon)).when(kind == "MultiPolygon", multi)


def parse_features(df: DataFrame, feature: Column, key: str) -> DataFrame:
    """Features as (key, parts); those without key or geometry are dropped."""
    f = F.from_json(feature, FEATURE_SCHEMA)
    rows = df.select(f.alias("_f")).select(
        F.col("_f.properties")[key].alias(key),
        lift_geometry(F.col("_f.geometry.type"), F.col("_f.geometry.coordinates")).alias("parts"),
    )
    return rows.where((F.coalesce(key, F.lit("")) != "") & F.col("parts").isNotNull())


def read_geojson(spark: SparkSession, path: str, key: str, per_line: bool = False) -> DataFrame:
    """FeatureCollections, one per file or one per line, as one row per feature.

    Geometry stays text until its type is known, because a file may mix nesting depths.
    """
    docs = spark.read.text(path, wholetext=not per_line)
    features = docs.select(
        F.explode(F.from_json("value", "struct<features:array<string>>")["features"]).alias("_t")
    )
    return parse_features(features, F.col("_t"), key)


def read_feature_lines(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One feature per line: the splittable form for large layers."""
    return parse_features(spark.read.text(path), F.col("value"), key)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(html, r"<[^>]+>", ""))


def tables_by_heading(pages: DataFrame, html: str, heading: str, keep: Sequence[str]) -> DataFrame:
    """Rows of the first table in every section whose h2/h3 heading matches a pattern.

    Sections run from one heading to the next. Cells lose tags and [n] footnotes.
    """
    # A heading opens a section; the split keeps it at the start of its piece.
    sections = F.split(F.col(html), r"(?=<h[23][^>]*>)")
    piece = pages.select(*keep, F.posexplode(sections).alias("_pos", "_s")).withColumn(
        "heading", strip_tags(F.regexp_extract("_s", r"(?s)^<h[23][^>]*>(.*?)</h[23]>", 1))
    )
    found = piece.where(F.col("heading").rlike(heading)).withColumn(
        "_table", F.regexp_extract("_s", r"(?s)<table[^>]*wikitable[^>]*>(.*?)</table>", 1)
    )
    rows = found.select(
        *keep, "heading", F.posexplode(F.regexp_extract_all("_table", F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1)).alias("row", "_r")
    )
    cells = F.regexp_extract_all("_r", F.lit(r"(?s)<t[hd][^>]*>(.*?)</t[hd]>"), 1)
    clean = F.transform(cells, lambda c: F.trim(F.regexp_replace(strip_tags(c), r"\[\w+\]", "")))
    return rows.select(*keep, "heading", "row", clean.alias("cells"))


def read_pages_of_records(spark: SparkSession, glob: str, record: str, key: str, pattern: str) -> DataFrame:
    """Offset batches {records: [...]} of many files as one table with valid keys only."""
    docs = spark.read.schema(f"total long, records array<struct<{record}>>").json(glob)
    rows = docs.select(F.explode("records").alias("_r")).select("_r.*")
    return rows.where(F.trim(F.col(key)).rlike(pattern))


def mean_of_samples(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Mean of the positive numeric samples per key, one decimal; fill values are dropped."""
    v = F.col(value).try_cast("double")
    return df.where(v > 0).groupBy(key).agg(F.bround(F.avg(v), 1).alias(out))
