"""Table maintenance: append, merge, update, upsert, log dedup, parity, app table.

All functions are DataFrame to DataFrame; ``placescope.sources.store`` writes the result as a new
version, so no plan reads and overwrites the same path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placescope.functions.names import parse_number
from placescope.operators.joins import first_per_key
from placescope.operators.stats import p95_norm


def append_new(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Current rows untouched plus new rows with unseen keys, in the current column set."""
    fresh = new.join(current.select(key), key, "left_anti")
    known = [c for c in current.columns if c in new.columns]
    return current.unionByName(fresh.select(*known), allowMissingColumns=True)


def merge_authoritative(repo: DataFrame, backup: DataFrame, key: str) -> DataFrame:
    """Repo rows win; the backup adds only missing, non-empty keys. No key column: unchanged."""
    if key not in repo.columns or key not in backup.columns:
        return repo
    usable = backup.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    fresh = usable.join(repo.select(key), key, "left_anti")
    return repo.unionByName(fresh, allowMissingColumns=True)


def update_existing(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Overwrite matching keys with non-null new values; new keys are ignored."""
    shared = [c for c in new.columns if c != key and c in current.columns]
    incoming = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in shared])
    merged = current.join(incoming, key, "left")
    return merged.withColumns({c: F.coalesce(f"_n_{c}", c) for c in shared}).select(*current.columns)


def fill_gaps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Union of keys and columns, the left value preferred where both have one."""
    columns = [c for c in left.columns if c != key]
    columns += [c for c in right.columns if c != key and c not in columns]
    a, b = left.alias("a"), right.alias("b")

    def pick(c: str) -> Column:
        if c not in right.columns:
            return F.col(f"a.{c}")
        if c not in left.columns:
            return F.col(f"b.{c}")
        return F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))

    return a.join(b, key, "full").select(key, *[pick(c).alias(c) for c in columns])


def upsert_latest(current: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """One row per key, the one with the latest timestamp; the incoming row wins a tie."""
    both = current.withColumn("_in", F.lit(0)).unionByName(
        new.withColumn("_in", F.lit(1)), allowMissingColumns=True
    )
    newest = F.struct(F.col(at), F.col("_in"))
    rest = [c for c in current.columns if c != key]
    return (
        both.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max_by(F.struct(*rest), newest).alias("_p"))
        .select(key, "_p.*")
    )


def valid_rows(rows: DataFrame, required: Mapping[str, str], optional: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose figures have the wanted types, typed, and the rows that do not.

    A required column must be present and convert. An optional one may be null, blank or "None", which
    counts as null; any other text that does not convert makes the row bad. Bad rows come back as they
    were, with the first failing column in ``bad_column``.
    """
    bad, typed = F.lit(None).cast("string"), {}
    for names, needed in ((required, True), (optional, False)):
        for c, kind in names.items():
            text = F.trim(F.col(c).cast("string"))
            blank = text.isNull() | text.isin("", "None")
            typed[c] = F.when(~blank, text.try_cast(kind))
            bad = F.coalesce(bad, F.when(typed[c].isNull() & (F.lit(True) if needed else ~blank), F.lit(c)))
    judged = rows.withColumn("bad_column", bad)
    return judged.where("bad_column is null").drop("bad_column").withColumns(typed), judged.where("bad_column is not null")


def upsert(current: DataFrame, incoming: DataFrame, key: str, order: Column) -> DataFrame:
    """``current`` with every incoming row in place of the stored row of its key, whatever their timestamps.

    Of several incoming rows of a key the last by ``order`` comes in; a null key never does. Columns
    that the incoming rows lack become null. Only the batch is grouped; the stored rows pass a join
    against its keys, which the planner broadcasts while they are few.
    """
    last = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*[c for c in incoming.columns if c != key]), order).alias("_row")).select(key, "_row.*")
    kept = current.join(last.select(key), key, "left_anti").select(*current.columns)
    return kept.unionByName(last.select(*[c for c in current.columns if c in last.columns]), allowMissingColumns=True)


def parse_log(raw: DataFrame, ts: str, key: str, source: str, numbers: Sequence[str]) -> DataFrame:
    """Typed log rows: bad timestamps or non-numeric figures drop the row, commas are allowed."""
    typed = raw.withColumn(ts, F.col(ts).try_cast("timestamp"))
    ok = F.col(ts).isNotNull() & F.col(key).isNotNull() & F.col(source).isNotNull()
    for n in numbers:
        text = F.col(n)
        parsed = parse_number(text)
        blank = text.isNull() | text.isin("", "None")
        typed = typed.withColumn(f"_{n}", parsed).withColumn(f"_bad_{n}", ~blank & parsed.isNull())
        ok = ok & ~F.col(f"_bad_{n}")
    kept = typed.where(ok)
    for n in numbers:
        kept = kept.withColumn(n, F.col(f"_{n}")).drop(f"_{n}", f"_bad_{n}")
    return kept


def insert_ignore(log: DataFrame, rows: DataFrame, unique: Sequence[str], order: str) -> DataFrame:
    """Log plus rows whose unique key is new; among equal new keys the first by ``order`` stays."""
    once = first_per_key(rows, list(unique), F.col(order)).select(*rows.columns)
    fresh = once.join(log.select(*unique), list(unique), "left_anti")
    return log.unionByName(fresh.select(*log.columns))


def preserve_added(result: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Result plus stored rows whose key appeared while the run was computing."""
    added = stored.join(result.select(key), key, "left_anti")
    return result.unionByName(added.select(*[c for c in result.columns if c in added.columns]), allowMissingColumns=True)


def app_table(scores: DataFrame, names: DataFrame, poi: DataFrame, key: str) -> DataFrame:
    """Display table: name, point, index, income and the p95-normalised poi figure."""
    scaled = p95_norm(poi, "poi_per_km2", "poi").select(key, "poi")
    return (
        scores.join(names.select(key, "name"), key, "left")
        .join(scaled, key, "left")
        .select(key, "name", "lat", "lng", "index", "income", "poi")
    )


def parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Row counts of two copies and the keys only one of them has, in one row."""
    sides = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    per_key = sides.groupBy(key).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return per_key.agg(
        F.sum("_a").alias("rows_a"),
        F.sum("_b").alias("rows_b"),
        F.count_if((F.col("_a") > 0) & (F.col("_b") == 0)).alias("only_a"),
        F.count_if((F.col("_b") > 0) & (F.col("_a") == 0)).alias("only_b"),
    )


def star_join(core: DataFrame, signals: Sequence[DataFrame], key: str) -> DataFrame:
    """Core rows with the columns of every signal table; rows outside the core are dropped."""
    for s in signals:
        core = core.join(s, key, "left")
    return core


def diagnostics(
    importances: DataFrame, figures: DataFrame, gates: DataFrame, anomalies: DataFrame, threshold: float = 0.15, moved: DataFrame | None = None
) -> DataFrame:
    """The run's diagnostics as (section, item, json) rows; of ``moved`` the rows beyond the drift limit.

    One row per item instead of one document: the flagged keys of a large run do not fit in a cell.
    """

    def section(df: DataFrame, name: str, item: str) -> DataFrame:
        body = F.to_json(F.struct(*[F.col(c) for c in df.columns if c != item]))
        return df.select(F.lit(name).alias("section"), F.col(item).cast("string").alias("item"), body.alias("json"))

    flagged = anomalies.where(F.col("is_anomaly") | (F.col("anomaly_score") > threshold))
    parts = (
        section(importances, "importance", importances.columns[0])
        .unionByName(section(figures, "figure", figures.columns[0]))
        .unionByName(section(gates, "gate", gates.columns[0]))
        .unionByName(section(flagged, "anomaly", flagged.columns[0]))
    )
    return parts if moved is None else parts.unionByName(section(moved.where("status = 'WARN'"), "drift", moved.columns[0]))
