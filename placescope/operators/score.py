"""Weighted composite index, money estimates and the gates that check a run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placescope.operators.stats import clip

# Index scale, household base spend, spend-share curve.
INDEX_CENTRE, INDEX_PER_Z, INDEX_MIN, INDEX_MAX = 100, 30, 40, 200
PERSON_MONTHLY_SPEND, HOUSEHOLD_SIZE = 6_996, 4.1
LIFT_RATE = 0.55
SHARE_BASE, SHARE_SLOPE, SHARE_MIN, SHARE_MAX = 0.82, 0.10, 0.45, 0.85
SWING_LIMIT = 10


def index_of(composite: Column) -> Column:
    raw = F.lit(float(INDEX_CENTRE)) + F.lit(float(INDEX_PER_Z)) * composite
    return F.bround(clip(raw, F.lit(float(INDEX_MIN)), F.lit(float(INDEX_MAX)))).cast("int")


def _present(weights: Mapping[str, float], prefix: str) -> tuple[Column, Column, Column]:
    """Weighted sum, weight total and count over the z columns a row has."""
    total, weight, count = F.lit(0.0), F.lit(0.0), F.lit(0)
    for s, w in weights.items():
        z = F.col(f"{prefix}{s}")
        total = total + F.coalesce(z * w, F.lit(0.0))
        weight = weight + F.when(z.isNotNull(), w).otherwise(0.0)
        count = count + z.isNotNull().cast("int")
    return total, weight, count


def composite(df: DataFrame, key: str, weights: Mapping[str, float], prefix: str = "z_") -> DataFrame:
    """Weighted mean of z over the signals a row has, with the weights renormalised to those.

    Row-local; rows without any signal are left out.
    """
    total, weight, count = _present(weights, prefix)
    rows = df.select(key, total.alias("_s"), weight.alias("_t"), count.alias("_k")).where("_k > 0")
    c = F.col("_s") / F.col("_t")
    return rows.select(
        key,
        F.bround(c, 3).alias("composite_z"),
        index_of(c).alias("index"),
        F.concat(F.col("_k").cast("string"), F.lit(f"/{len(weights)}")).alias("coverage"),
    )


def lift(z: Column) -> Column:
    return F.exp(F.lit(LIFT_RATE) * z)


def spend_share(z: Column) -> Column:
    return clip(F.lit(SHARE_BASE) - F.lit(SHARE_SLOPE) * z, F.lit(SHARE_MIN), F.lit(SHARE_MAX))


def money(df: DataFrame, z: str = "composite_z") -> DataFrame:
    """Household spend and income: exponential lift of a base spend, share falls with affluence."""
    spend = F.lit(PERSON_MONTHLY_SPEND * HOUSEHOLD_SIZE) * lift(F.col(z))
    monthly = F.bround(spend, -2)
    return df.withColumns(
        {
            "est_monthly_spend_hh": monthly,
            "est_monthly_income_hh": F.bround(spend / spend_share(F.col(z)), -2),
            "est_annual_spend_hh": F.bround(monthly * 12, -3),
        }
    )


def leave_one_out(df: DataFrame, weights: Mapping[str, float], prefix: str = "z_") -> DataFrame:
    """Largest index swing when one signal is dropped, for all signals in one pass.

    A row without the signal cannot move; a row with no other signal has no reduced index.
    """
    total, weight, _ = _present(weights, prefix)
    rows = df.withColumns({"_s": total, "_t": weight}).where("_t > 0")

    def swing(s: str, w: float) -> Column:
        z = F.col(f"{prefix}{s}")
        rest = F.col("_t") - w
        reduced = F.when(rest > 1e-9, (F.col("_s") - w * z) / rest)
        moved = F.abs(index_of(F.col("_s") / F.col("_t")) - index_of(reduced))
        return F.struct(F.lit(s).alias("signal"), F.max(F.when(z.isNotNull(), moved)).alias("max_swing"))

    one = rows.agg(F.array(*[swing(s, w) for s, w in weights.items()]).alias("_a"))
    status = F.when(F.col("max_swing") <= SWING_LIMIT, "PASS").otherwise("WARN")
    return (
        one.select(F.explode("_a").alias("_p")).select("_p.*").withColumn("status", status)
    )


def ordering_gates(gates: DataFrame, scores: DataFrame, key: str, value: str) -> DataFrame:
    """PASS when value(hi) > value(lo), SKIP when either is missing. ``gates``: gate, hi, lo."""
    hi = scores.select(F.col(key).alias("hi"), F.col(value).alias("hi_value"))
    lo = scores.select(F.col(key).alias("lo"), F.col(value).alias("lo_value"))
    status = (
        F.when(F.col("hi_value").isNull() | F.col("lo_value").isNull(), "SKIP")
        .when(F.col("hi_value") > F.col("lo_value"), "PASS")
        .otherwise("FAIL")
    )
    return gates.join(hi, "hi", "left").join(lo, "lo", "left").withColumn("status", status)


def drift(current: DataFrame, previous: DataFrame, key: str, value: str) -> DataFrame:
    """Keys in both runs with their absolute change and whether it exceeds the limit."""
    new = current.select(key, F.col(value).alias("new_value"))
    old = previous.select(key, F.col(value).alias("old_value"))
    delta = F.abs(F.col("new_value") - F.col("old_value"))
    return (
        new.join(old, key)
        .withColumn("delta", delta)
        .withColumn("status", F.when(F.col("delta") > SWING_LIMIT, "WARN").otherwise("PASS"))
    )


def coverage_report(df: DataFrame, signals: Sequence[str]) -> DataFrame:
    """Filled and total count per signal as long rows, from one aggregation."""
    one = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count(F.col(s)).alias(s) for s in signals]
    )
    pairs = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("filled")) for s in signals])
    return one.select("total", F.explode(pairs).alias("_p")).select(
        "_p.signal", "_p.filled", "total", F.round(F.col("_p.filled") / F.col("total"), 4).alias("share")
    )


def change_band(old: Column, new: Column) -> tuple[Column, Column]:
    """Percent change and its arrow, flat inside +-2 %."""
    pct = (new - old) / F.greatest(F.abs(old), F.lit(1e-9)) * 100
    arrow = F.when(pct > 2, "▲").when(pct < -2, "▼").otherwise("≈")
    return pct, arrow
