"""Aggregations that turn counts and totals into signals per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from placescope.operators.quantile import exact_quantiles, medians

LAKH, CRORE = 100_000, 10_000_000

#: Positions of a file that one task carries labels over.
RANGE_LINES = 100_000


def weighted_mean(value: Column, weight: Column, where: Column | None = None) -> Column:
    """Aggregate: weighted mean, 0 when the weights sum to nothing."""
    if where is not None:
        weight = F.when(where, weight)
    return F.coalesce(
        F.try_divide(F.sum(weight * value), F.nullif(F.sum(weight), F.lit(0.0))), F.lit(0.0)
    )


def band_means(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    weight: str,
    parts: Mapping[str, Column],
    digits: int = 0,
) -> DataFrame:
    """Weighted mean over all rows and over each named part, from positive rows only."""
    rows = df.where((F.col(weight) > 0) & (F.col(value) > 0))
    v, w = F.col(value), F.col(weight)
    return rows.groupBy(*keys).agg(
        F.bround(weighted_mean(v, w), digits).alias("combined"),
        *[F.bround(weighted_mean(v, w, cond), digits).alias(n) for n, cond in parts.items()],
    )


def modal(df: DataFrame, key: str, label: str, out: str) -> DataFrame:
    """Most frequent label per key, the smaller label on ties, plus the row count of the key.

    Labels are counted first, so even a hot key reaches the second step as few rows.
    """
    counts = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("_c"))
    best = F.min_by(F.col(label), F.struct(-F.col("_c"), F.col(label)))
    return counts.groupBy(key).agg(best.alias(out), F.sum("_c").alias("row_count"))


def ratio(num: Column, den: Column, digits: int) -> Column:
    """num / max(den, 1), rounded half-even."""
    return F.bround(num / F.greatest(den, F.lit(1)), digits)


def rate_per(num: Column, den: Column, unit: float, digits: int) -> Column:
    return F.bround(F.try_divide(num, den) * F.lit(float(unit)), digits)


def attach(rows: DataFrame, figures: DataFrame, keys: Sequence[str] | str, how: str = "left") -> DataFrame:
    """Bring group figures to their members by an equi-join.

    No broadcast hint: the planner broadcasts figures whose measured size is below its threshold
    and otherwise splits the hot groups of the member side.
    """
    return rows.join(figures, keys if isinstance(keys, str) else list(keys), how)


def group_rate(
    members: DataFrame, population: DataFrame, group: str, count: str, unit: float = LAKH
) -> DataFrame:
    """Sum of a count over all rows of a group per unit of the group's population."""
    totals = members.groupBy(group).agg(F.sum(count).alias("_total"))
    return totals.join(population, group).select(
        group, (F.col("_total") / F.col("population") * unit).alias("rate")
    )


def transform_median(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """Exact median of the group on each of its rows."""
    return attach(df, medians(df, [group], value, out), group)


def median_and_count(df: DataFrame, key: str, value: str) -> DataFrame:
    """Median and count of positive values per key."""
    return exact_quantiles(df.where(F.col(value) > 0), [key], value, {"median": 0.5}, count="sample_count")


def latest_value(
    facts: DataFrame, wanted: Sequence[str], name: str, year: str, value: str
) -> DataFrame:
    """Latest non-null value per wanted name: exact name first, else names that start with it.

    Facts shrink to the latest row per name first; each distinct name then finds the wanted
    prefixes in a constant list, so there is no join on the prefix.
    """
    newest = (
        facts.where(F.col(value).isNotNull())
        .groupBy(F.col(name).alias("_name"))
        .agg(F.max(F.struct(F.col(year), F.col(value))).alias("_p"))
    )
    listed = F.array(*[F.lit(w) for w in wanted])
    hits = newest.select(
        "_name", "_p", F.explode(F.filter(listed, lambda w: F.col("_name").startswith(w))).alias("wanted")
    )
    exact = (F.col("_name") == F.col("wanted")).cast("int")
    return (
        hits.groupBy("wanted")
        .agg(F.max(F.struct(exact.alias("exact"), F.col("_p"), F.col("_name"))).alias("_b"))
        .select(
            "wanted",
            F.col("_b._name").alias("matched"),
            F.col("_b._p")[year].alias(year),
            F.col("_b._p")[value].alias(value),
        )
    )


def unpivot_years(df: DataFrame, key: str, years: Sequence[str]) -> DataFrame:
    """Year columns to (key, year, value) rows, without nulls."""
    pairs = F.array(*[F.struct(F.lit(int(y[:4])).alias("year"), F.col(f"`{y}`").alias("value")) for y in years])
    return (
        df.select(key, F.explode(pairs).alias("_p"))
        .select(key, "_p.year", "_p.value")
        .where(F.col("value").isNotNull())
    )


def latest_year_table(long: DataFrame, key: str) -> DataFrame:
    """Rows of the most recent year that has any data."""
    newest = long.agg(F.max("year")).scalar()
    return long.where(F.col("year") == newest)


def carry_down(df: DataFrame, file: str, pos: str, label: str, out: str, lines: int = RANGE_LINES) -> DataFrame:
    """Last label seen at or above each line of its file; null above the first one.

    ``pos`` is a whole number, each once in a file. A file is cut into ranges of ``lines`` positions, and the
    last label before a range enters it as a line above its first. So a task orders one range, and the
    window over a whole file meets one row per range.
    """
    ranged = df.withColumn("_range", F.floor(F.col(pos) / lines))
    labelled = F.when(F.col(label).isNotNull(), F.col(pos))
    last = ranged.groupBy(file, "_range").agg(F.max_by(label, labelled).alias("_last"))
    before = W.partitionBy(file).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    heads = last.select(file, "_range", F.last("_last", ignorenulls=True).over(before).alias(label), F.lit(True).alias("_head"))
    rows = ranged.withColumn("_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    above = W.partitionBy(file, "_range").orderBy(F.col("_head").desc(), pos).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(label, ignorenulls=True).over(above)).where("not _head").drop("_range", "_head")


def donor_fill(figures: DataFrame, key: str, missing: str, donor: str) -> DataFrame:
    """Give a missing key the figures of a donor key."""
    present = figures.where(F.col(key) == missing)
    copy = figures.where(F.col(key) == donor).withColumn(key, F.lit(missing))
    return figures.unionByName(copy.join(present.select(key), key, "left_anti"))


def collected_names(df: DataFrame, group: str, name: str, out: str, sep: str = ", ") -> DataFrame:
    """Distinct names of a group, sorted and joined, with the row count."""
    return df.groupBy(group).agg(
        F.array_join(F.array_sort(F.collect_set(name)), sep).alias(out),
        F.count(F.lit(1)).alias("n"),
    )


def latest_events(df: DataFrame, at: str, tie: str, n: int) -> DataFrame:
    """The last n events, newest first (a top-k, not a sort of the log)."""
    return df.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(n)


def quartile_table(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
