"""Column functions that scale a prior or base rate by a relative figure."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from placescope.functions import fixed_values as fixed


def prior_columns(region: Column) -> dict[str, Column]:
    """The prior figures of a region as columns, the default prior where it is unknown."""

    def field(i: int) -> Column:
        pairs = [F.lit(x) for r, v in fixed.REGION_PRIORS.items() for x in (r, float(v[i]))]
        known = F.element_at(F.create_map(*pairs), region)
        return F.coalesce(known, F.lit(float(fixed.DEFAULT_PRIOR[i])))

    return {name: field(i) for i, name in enumerate(fixed.PRIOR_FIELDS)}


def scale_from_density(density: Column, median: Column, prior: Mapping[str, Column]) -> dict[str, Column]:
    """All signals of a place from its point-of-interest density relative to the region median."""
    ratio = F.greatest(F.lit(0.15), F.least(F.lit(5.0), density / F.greatest(median, F.lit(0.5))))

    def scaled(name: str, exponent: float, digits: int) -> Column:
        return F.bround(prior[name] * F.pow(ratio, F.lit(exponent)), digits)

    return {
        "rate_per_area": scaled("rate", 0.80, 0),
        "deposits_per_capita": scaled("dep", 0.75, 0),
        "radiance_mean": scaled("nl", 0.25, 1),
        "filers_per_capita": scaled("itr", 0.55, 4),
        "cars_per_1000": scaled("veh", 0.35, 1),
        "car_2w_ratio": prior["c2w"],
        "luxury_share": prior["lux"],
        "ev_share": prior["ev"],
        "poi_per_km2": density,
        "fin_density_per_km2": F.bround(
            F.lit(fixed.FINANCE_DENSITY_MEDIAN) * F.pow(ratio, F.lit(0.50)), 4
        ),
    }


def poi_median_or_default(median: Column) -> Column:
    return F.when(median >= 1, median).otherwise(F.lit(fixed.DEFAULT_POI_MEDIAN))


def ratio_factor(value: Column, median: Column, exponent: float = 0.35) -> Column:
    """Dampened (value / median) factor, 1 where either is missing or not positive."""
    ok = (value > 0) & (median > 0)
    return F.when(ok, F.pow(value / F.when(ok, median).otherwise(1.0), F.lit(exponent))).otherwise(1.0)


def relative_rate(base: Column, value: Column, median: Column, exponent: Column) -> Column:
    return F.bround(base * F.pow(value / median, exponent), 4)


def growth_pct(base: Column, latest: Column) -> Column:
    return (latest / base - 1) * 100


def calibration_weight(growth: Column, median: Column) -> Column:
    return F.pow(F.greatest(growth / median, F.lit(0.2)), F.lit(0.2))
