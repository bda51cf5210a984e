"""Row and column selection, and set operations on keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from placescope.functions.geo import EARTH_KM, haversine


def include(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_semi")


def exclude(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def choose_columns(
    df: DataFrame, core: Sequence[str], optional: Sequence[str], requested: Sequence[str]
) -> DataFrame:
    """Core columns always, requested optional ones in registry order."""
    return df.select(*core, *[c for c in optional if c in set(requested) and c in df.columns])


def lookback(df: DataFrame, ts_text: str, cutoff: Column, source: str, sources: Sequence[str]) -> DataFrame:
    """Rows of given sources whose ISO timestamp text is at or after the cutoff; bad texts go."""
    at = F.col(ts_text).try_cast("timestamp")
    return df.where(F.col(source).isin(*sources) & (at >= cutoff))


def plausible(value: Column, lo: float, hi: float) -> Column:
    return value.between(lo, hi)


def trusted(df: DataFrame, method: str, accepted: Sequence[str] = ("exact", "verified_manual")) -> DataFrame:
    return df.where(F.col(method).isin(*accepted))


def precedence_union(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All of ``first`` plus the rows of ``second`` whose key it lacks."""
    return first.unionByName(second.join(first.select(key).hint("merge"), key, "left_anti"), allowMissingColumns=True)


def within_radius(df: DataFrame, lat: float, lng: float, km: float) -> DataFrame:
    """Rows within a great-circle radius of a centre, behind a latitude band the scan can use."""
    degrees = km / EARTH_KM * 180 / 3.141592653589793 + 1e-9
    band = F.col("lat").between(lat - degrees, lat + degrees)
    return df.where(band & (haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng")) <= km))


def next_batch(todo: DataFrame, done: DataFrame, key: str, n: int) -> DataFrame:
    """The next n open keys in key order: rerunning after the batch is stored moves on."""
    return exclude(todo, done, key).orderBy(key).limit(n)
