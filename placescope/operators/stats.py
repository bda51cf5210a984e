"""Window-like statistics: z-scores, bands, imputation, ranks.

Group figures are partial-aggregated and joined back, so a hot group never sits in one task.
Global figures enter as constants of a fit step or as scalar subqueries, never as cross joins.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from placescope.operators import quantile
from placescope.operators.quantile import exact_quantiles


def clip(value: Column, low: Column, high: Column) -> Column:
    """Clamp that keeps null, unlike ``least``/``greatest`` alone."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, high), low))


def to_long(
    df: DataFrame, key: str, signals: Sequence[str], keep: Sequence[str] = (), drop_null: bool = True
) -> DataFrame:
    """One row per (key, signal), by default only where the value is present."""
    pairs = F.array(
        *[
            F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value"))
            for s in signals
        ]
    )
    long = df.select(key, *keep, F.explode(pairs).alias("_p")).select(
        key, *keep, "_p.signal", "_p.value"
    )
    return long.where(F.col("value").isNotNull()) if drop_null else long


def to_wide(long: DataFrame, key: str, signals: Sequence[str], value: str = "value") -> DataFrame:
    """Outer alignment of signals on a key: one aggregation instead of a chain of full joins."""
    return long.groupBy(key).agg(
        *[F.max(F.when(F.col("signal") == s, F.col(value))).alias(s) for s in signals]
    )


def signal_quantiles(df: DataFrame, signals: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """One row with one struct: the exact quantile ``<name>_<signal>`` of every signal."""
    pairs = F.array(
        *[F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value")) for s in signals]
    )
    long = df.select(F.explode(pairs).alias("_p")).select("_p.signal", "_p.value")
    found = quantile.exact_quantiles(long, ["signal"], "value", probs, registered_keys=True)
    return found.agg(
        F.struct(
            *[
                F.max(F.when(F.col("signal") == s, F.col(name))).alias(f"{name}_{s}")
                for s in signals
                for name in probs
            ]
        )
    )


def winsorize(df: DataFrame, signals: Sequence[str], lo: float, hi: float) -> DataFrame:
    """Clip each signal column to its quantiles; the rows are not shuffled."""
    bounds = signal_quantiles(df, signals, {"lo": lo, "hi": hi})
    one = F.col("_bounds")
    clipped = {
        s: clip(F.col(s).cast("double"), one[f"lo_{s}"], one[f"hi_{s}"]) for s in signals
    }
    return with_figures(df, bounds, "_bounds").withColumns(clipped).drop("_bounds")


def winsor_z(
    df: DataFrame, signals: Sequence[str], lo: float = 0.01, hi: float = 0.99, prefix: str = "z_"
) -> DataFrame:
    """Winsorised z-score of each signal as ``z_<signal>``: population std, zero std gives 0.

    Two small statistics passes, then row-local arithmetic: no shuffle of the rows.
    """
    clipped = winsorize(df, signals, lo, hi)
    moments = clipped.agg(
        F.struct(
            *[F.avg(s).alias(f"m_{s}") for s in signals],
            *[F.stddev_pop(s).alias(f"s_{s}") for s in signals],
        )
    )
    one = F.col("_moments")
    z = {
        f"{prefix}{s}": F.when(F.col(s).isNull(), None)
        .when(one[f"s_{s}"] > 0, (F.col(s) - one[f"m_{s}"]) / one[f"s_{s}"])
        .otherwise(0.0)
        for s in signals
    }
    return with_figures(clipped, moments, "_moments").withColumns(z).drop("_moments")


def with_figures(df: DataFrame, figures: DataFrame, name: str = "_one") -> DataFrame:
    """Put the struct of a one-row, one-column frame on every row as a constant.

    This is a fit step: the figures are computed now, and what follows is row-local arithmetic with
    literals. Only one row of numbers reaches the driver. Stacked steps read ``df`` once per fit, so
    hand them a written table.
    """
    row = figures.first()[0]
    fields = figures.schema.fields[0].dataType.fields
    constant = F.struct(*[F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in fields])
    return df.withColumn(name, constant)


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its population z-score; a constant column becomes 0."""
    figures = df.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        )
    )
    one = F.col("_one")
    scaled = {
        c: (F.col(c) - one[f"m_{c}"]) / F.when(one[f"s_{c}"] > 0, one[f"s_{c}"]).otherwise(1.0)
        for c in columns
    }
    return with_figures(df, figures).withColumns(scaled).drop("_one")


def group_z(
    df: DataFrame, columns: Sequence[str], fine: str, coarse: str, min_size: int = 5
) -> DataFrame:
    """Replace columns by group z-scores; a fine group below ``min_size`` rows uses its coarse group.

    Rows are counted with missing values included. Adds ``effective``, the group used; a one-member
    group gets 0 and a tiny std counts as 1.
    """
    sizes = df.groupBy(fine).agg(F.count(F.lit(1)).alias("_fine_n"))
    effective = F.when(F.col("_fine_n") >= min_size, F.col(fine)).otherwise(F.col(coarse))
    tagged = df.join(sizes, fine).withColumn("effective", effective.cast("string")).drop("_fine_n")
    figures = tagged.groupBy("effective").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(c).alias(f"_m_{c}") for c in columns],
        *[F.stddev_samp(c).alias(f"_s_{c}") for c in columns],
    )

    def z(c: str) -> Column:
        spread = F.when(F.col(f"_s_{c}") > 1e-9, F.col(f"_s_{c}")).otherwise(1.0)
        return F.when(F.col("_n") < 2, F.lit(0.0)).otherwise((F.col(c) - F.col(f"_m_{c}")) / spread)

    used = ["_n", *[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns]]
    return tagged.join(figures, "effective").withColumns({c: z(c) for c in columns}).drop(*used)


def band_scalar(
    df: DataFrame,
    value: str,
    group: str,
    lo: float,
    hi: float,
    out: str = "scalar",
    invert: bool = False,
    need_spread: bool = False,
) -> DataFrame:
    """Place a value in the band [lo, hi] by its min-max position in the group.

    1.0 when the value is missing or the group has fewer than two values; with ``need_spread`` also
    when all values of the group are equal.
    """
    peers = df.groupBy(group).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n")
    )
    start, width = (hi, lo - hi) if invert else (lo, hi - lo)
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0.1))
    raw = F.lit(start) + F.lit(width) * (F.col(value) - F.col("_lo")) / span
    usable = F.col(value).isNotNull() & (F.col("_n") >= 2)
    if need_spread:
        usable = usable & (F.col("_lo") < F.col("_hi"))
    scalar = F.when(usable, F.greatest(F.lit(lo), F.least(F.lit(hi), raw))).otherwise(1.0)
    return df.join(peers, group, "left").withColumn(out, scalar).drop("_lo", "_hi", "_n")


def minmax_scale(
    df: DataFrame, value: str, out: str, lo: float = 0.0, hi: float = 100.0, digits: int = 1
) -> DataFrame:
    """Global min-max over positive values; other rows get null; span 0 counts as 1."""
    positive = F.when(F.col(value) > 0, F.col(value))
    figures = df.agg(F.struct(F.min(positive).alias("lo"), F.max(positive).alias("hi")))
    one = F.col("_one")
    span = F.when(one["hi"] > one["lo"], one["hi"] - one["lo"]).otherwise(1.0)
    scaled = F.bround(F.lit(lo) + F.lit(hi - lo) * (positive - one["lo"]) / span, digits)
    return with_figures(df, figures).withColumn(out, scaled).drop("_one")


def representative(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the stated order.

    ``row_number() = 1`` runs with a map-side limit per key, so a hot key shuffles few rows.
    """
    first = W.partitionBy(key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def latest(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    return representative(df, key, [F.col(at).desc(), F.col(tie).desc()])


# Buckets of the value ranking: 32 coarse steps of 32 fine ones.
RANK_STEP = 32


def rank_of_values(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Count of rows whose value is at least this one, with no window over all rows.

    Equal values collapse first. Their counts are then ranked in two levels: whole buckets above,
    plus the values at or above inside the bucket. Buckets are cut at 1,023 sketched quantiles of
    the distinct values, so each holds about a thousandth of them.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    n = RANK_STEP * RANK_STEP
    fractions = F.array(*[F.lit(i / n) for i in range(1, n)])
    cuts = counts.agg(F.percentile_approx(value, fractions, F.lit(10_000))).scalar()
    below = lambda acc, c: acc + (c < F.col(value)).cast("int")
    coarse = F.transform(
        F.sequence(F.lit(RANK_STEP), F.lit(n - RANK_STEP), F.lit(RANK_STEP)),
        lambda i: F.element_at("_cuts", i),
    )
    fine = F.slice("_cuts", F.col("_a") * RANK_STEP + 1, F.lit(RANK_STEP - 1))
    bucketed = (
        counts.withColumn("_cuts", cuts)
        .withColumn("_a", F.aggregate(coarse, F.lit(0), below))
        # Never null, so that no null filter on the bucket is pushed below the grouping.
        .withColumn("_b", F.coalesce(F.col("_a") * RANK_STEP + F.aggregate(fine, F.lit(0), below), F.lit(0)))
        .drop("_cuts", "_a")
    )
    totals = bucketed.groupBy("_b").agg(F.sum("_c").alias("_t"))
    higher = W.orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
    above = totals.select("_b", F.coalesce(F.sum("_t").over(higher), F.lit(0)).alias("_above"))
    inside = W.partitionBy("_b").orderBy(F.col(value).desc()).rowsBetween(W.unboundedPreceding, 0)
    ranked = (
        bucketed.withColumn("_in", F.sum("_c").over(inside))
        .join(above, "_b")
        .select(value, (F.col("_above") + F.col("_in")).alias(out))
    )
    return df.join(ranked, value, "left")


def ratio_to_max(df: DataFrame, value: str, scalar: Column, out: str) -> DataFrame:
    """value / max(value) times a scalar, capped at 1."""
    top = df.agg(F.max(value)).scalar()
    return df.withColumn(out, F.bround(F.least(F.col(value) / top * scalar, F.lit(1.0)), 4))


def p95_norm(df: DataFrame, value: str, out: str) -> DataFrame:
    """100 x / p95 clipped to 0..100, one decimal; an empty column keeps p95 = 1."""
    p95 = exact_quantiles(df, [], value, {"p95": 0.95}).scalar()
    scaled = F.col(value) / F.coalesce(p95, F.lit(1.0)) * 100
    return df.withColumn(out, F.bround(clip(scaled, F.lit(0.0), F.lit(100.0)), 1))


def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill nulls with the exact median of the column; the rows are not shuffled."""
    medians = signal_quantiles(df, columns, {"med": 0.5})
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col("_one")[f"med_{c}"]) for c in columns}
    return with_figures(df, medians).withColumns(filled).drop("_one")


def latest_per(df: DataFrame, keys: Sequence[str], order: Column, values: Mapping[str, Column]) -> DataFrame:
    """Value columns of the row with the greatest ``order`` per key, by one aggregation."""
    picked = F.max_by(F.struct(*[c.alias(n) for n, c in values.items()]), order)
    return df.groupBy(*keys).agg(picked.alias("_p")).select(*keys, "_p.*")
