"""Distances on the sphere as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in km, the root clamped to 1."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.sin(dp) * F.sin(dp) + F.cos(p1) * F.cos(p2) * F.sin(dl) * F.sin(dl)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def cartesian(lat: Column, lng: Column) -> tuple[Column, Column, Column]:
    """Point on the sphere in km; chord distances need no case for poles or the date line."""
    p, l = F.radians(lat), F.radians(lng)
    r = F.lit(EARTH_KM)
    return r * F.cos(p) * F.cos(l), r * F.cos(p) * F.sin(l), r * F.sin(p)


def chord(km: float) -> float:
    """Straight-line length of a great-circle distance."""
    return 2 * EARTH_KM * math.sin(km / (2 * EARTH_KM))
