"""Bulk expansion: score places outside the trusted set and append them everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from placescope.functions import estimates, names
from placescope.operators import filters, quantile, rates, spatial, tables


def interpolate(
    candidates: DataFrame, trusted: DataFrame, key: str, k: int = 5
) -> DataFrame:
    """New scores for candidates: neighbours' values times a dampened local-to-region ratio.

    ``candidates``: key, group, region, lat, lng, figure. ``trusted``: key, lat, lng, index, income,
    spend. Candidates already trusted are left out. The region median is over the candidates.
    """
    new = filters.exclude(candidates, trusted, key)
    near = spatial.knn(new, trusted.withColumnRenamed(key, "_ref"), key, "_ref", k, ["index", "income", "spend"])
    estimate = spatial.idw(near, key, ["index", "income", "spend"])
    adjusted = rates.transform_median(new, "region", "figure", "_med").withColumn(
        "_f", estimates.ratio_factor(F.col("figure"), F.col("_med"))
    )
    out = adjusted.join(estimate, key)
    return out.select(
        key,
        names.display_name(F.col("group"), F.col("region"), F.col(key).cast("string")).alias("name"),
        "region", "lat", "lng",
        F.bround(F.col("index") * F.col("_f")).cast("int").alias("index"),
        F.bround(F.col("income") * F.col("_f"), -2).alias("income"),
        F.bround(F.col("spend") * F.col("_f"), -2).alias("spend"),
    )


def backfill_proxies(new: DataFrame, poi: DataFrame, key: str, code: str) -> DataFrame:
    """Signal rows for new places from the region prior, at the region's median POI density.

    ``poi``: code, poi_per_km2 of existing places. Regions follow from the code prefix on both sides.
    """
    known = poi.withColumn("region", names.region_of(F.col(code)))
    medians = quantile.medians(known, ["region"], "poi_per_km2", "_med")
    rows = new.withColumn("region", names.region_of(F.col(code))).join(medians, "region", "left")
    median = estimates.poi_median_or_default(F.col("_med"))
    rows = rows.withColumn("_m", median)
    figures = estimates.scale_from_density(F.col("_m"), F.col("_m"), estimates.prior_columns(F.col("region")))
    return rows.select(key, "region", *[c.alias(n) for n, c in figures.items()])


def expand(candidates: DataFrame, trusted: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Trusted rows untouched plus the newly scored places."""
    scored = interpolate(candidates, trusted, key, k)
    return tables.append_new(trusted, scored, key)
