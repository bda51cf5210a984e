"""Exact, linearly interpolated quantiles per group without a single-task sort.

``percentile`` keeps a count per distinct value of a group in one aggregation buffer, which a
hot group of continuous values can blow up. Here a bounded sketch first brackets the wanted
ranks; values outside the bracket collapse to a count and the nearest of them before the shuffle,
and only the few values inside are ranked. The same steps run at every size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SKETCH_ACCURACY = 10_000
_LOWEST, _HIGHEST = float("-inf"), float("inf")


def _brackets(value: Column, probs: Sequence[float]) -> Column:
    margin = 2.0 / SKETCH_ACCURACY
    cuts = [min(1.0, max(0.0, p + side * margin)) for p in probs for side in (-1, 1)]
    return F.percentile_approx(value, F.array(*[F.lit(c) for c in cuts]), F.lit(SKETCH_ACCURACY))


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    registered_keys: bool = False,
    count: str | None = None,
) -> DataFrame:
    """One row per group: ``keys`` plus one double column per entry of ``probs``.

    The bracket reaches two rank errors of the sketch to either side, the nearest values outside it one
    row further, which covers the rounding of ranks in groups of any size.

    ``keys`` may be empty for one global row. Null values are ignored; a group with no value is
    absent from the result. ``registered_keys`` states that the keys come from a registry of
    signals, whose length bounds the sketch table, so that the rows need no shuffle to meet it.
    ``count`` names a further column for the number of values, which the sketch has already counted.
    """
    names = list(probs)
    fractions = [float(probs[n]) for n in names]
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), _brackets(F.col("_v"), fractions).alias("_cuts")
    )
    if keys:
        bracketed = rows.join(F.broadcast(sketch) if registered_keys else sketch, keys)
        n, cuts = F.col("_n"), F.col("_cuts")
    else:
        one = rows.withColumn("_one", sketch.select(F.struct("_n", "_cuts")).scalar())
        bracketed = one.select("_v", "_one._n", "_one._cuts")
        n, cuts = F.col("_n"), F.col("_cuts")
    targets = F.array(
        *[F.struct(F.lit(i).alias("target"), cuts[2 * i].alias("lo"), cuts[2 * i + 1].alias("hi")) for i in range(len(names))]
    )
    v, lo, hi = F.col("_v"), F.col("_t.lo"), F.col("_t.hi")
    place = F.when(v < lo, F.lit(_LOWEST)).when(v > hi, F.lit(_HIGHEST)).otherwise(v)
    counted = (
        bracketed.select(*keys, "_v", "_n", F.explode(targets).alias("_t"))
        .select(*keys, "_n", "_v", F.col("_t.target").alias("_target"), place.alias("_place"))
        .groupBy(*keys, "_target", "_place")
        .agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        .withColumn("_v", F.when(F.col("_place") == _LOWEST, F.col("_most")).otherwise(F.col("_least")))
    )
    running = W.partitionBy(*keys, "_target").orderBy("_place", "_v").rowsBetween(W.unboundedPreceding, 0)
    fraction = F.element_at(F.array(*[F.lit(p) for p in fractions]), F.col("_target") + 1)
    position = fraction * (F.col("_n") - 1)
    ranked = counted.withColumn("_cum", F.sum("_c").over(running)).withColumn("_pos", position)
    rank = F.floor("_pos")
    picked = ranked.groupBy(*keys, "_target").agg(
        F.min(F.when(F.col("_cum") > rank, F.col("_v"))).alias("_low"),
        F.min(F.when(F.col("_cum") > rank + 1, F.col("_v"))).alias("_high"),
        F.first(F.col("_pos") - rank).alias("_w"),
        F.first("_n").alias("_n"),
    )
    low, high = F.col("_low"), F.coalesce("_high", "_low")
    result = F.when(F.col("_w") == 0, low).otherwise(low + F.col("_w") * (high - low))
    return picked.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_target") == i, result)).alias(n) for i, n in enumerate(names)],
        *([F.first("_n").alias(count)] if count else []),
    )


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})
