"""Polygon work on ``parts``: an array of polygons, each an array of rings of [lng, lat] points.

Every shape is one row, so all of it is row-local array expressions without a shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from placescope.functions.geo import haversine
from placescope.operators.filters import precedence_union

# Distances and sizes of the boundary checks.
KEEP_MIN_KM, KEEP_DIAGONALS = 8.0, 4.0
REJECT_KM = 30.0
SIZE_MAX_KM, SIZE_MIN_KM, SIZE_NEIGHBOURS = 15.0, 2.5, 2.0
CIRCLE_DEGREES, CIRCLE_STEPS = 0.012, 12


def vertices(parts: Column) -> Column:
    """All points of all rings."""
    return F.flatten(F.flatten(parts))


def _axis(points: Column, i: int) -> Column:
    return F.transform(points, lambda p: p[i])


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / F.size(values)


def bbox_centre(parts: Column) -> tuple[Column, Column]:
    """(lat, lng) of the bounding box centre."""
    pts = vertices(parts)
    middle = lambda i: (F.array_min(_axis(pts, i)) + F.array_max(_axis(pts, i))) / 2
    return middle(1), middle(0)


def points_diagonal(pts: Column) -> Column:
    lng, lat = _axis(pts, 0), _axis(pts, 1)
    return haversine(F.array_min(lat), F.array_min(lng), F.array_max(lat), F.array_max(lng))


def bbox_diagonal_km(parts: Column) -> Column:
    return points_diagonal(vertices(parts))


def vertex_mean(parts: Column) -> tuple[Column, Column]:
    """(lat, lng) mean of every vertex, not weighted by area."""
    pts = vertices(parts)
    return _mean(_axis(pts, 1)), _mean(_axis(pts, 0))


def ring_centroid_area(ring: Column) -> Column:
    """Struct(lng, lat, area) of a closed ring by the shoelace sums; degenerate: vertex mean, 0."""
    steps = F.when(F.size(ring) > 1, F.sequence(F.lit(0), F.size(ring) - 2)).otherwise(
        F.array().cast("array<int>")
    )
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(acc: Column, i: Column) -> Column:
        p, q = ring[i], ring[i + 1]
        cross = p[0] * q[1] - q[0] * p[1]
        return F.struct(
            (acc["a"] + cross).alias("a"),
            (acc["x"] + (p[0] + q[0]) * cross).alias("x"),
            (acc["y"] + (p[1] + q[1]) * cross).alias("y"),
        )

    def finish(acc: Column) -> Column:
        area = acc["a"] * 0.5
        flat = (F.size(ring) < 3) | (F.abs(area) < 1e-12)
        safe = F.when(flat, F.lit(1.0)).otherwise(area)
        return F.struct(
            F.when(flat, _mean(_axis(ring, 0))).otherwise(acc["x"] / (6 * safe)).alias("lng"),
            F.when(flat, _mean(_axis(ring, 1))).otherwise(acc["y"] / (6 * safe)).alias("lat"),
            F.when(flat, F.lit(0.0)).otherwise(F.abs(area)).alias("area"),
        )

    return F.aggregate(steps, zero, add, finish)


def drop_far_parts(df: DataFrame, parts: str, lat: str = "lat", lng: str = "lng", out: str = "parts") -> DataFrame:
    """Drop polygon parts far from the anchor point, nearest part first in the result.

    A part stays within max(8 km, 4 x the diagonal of the nearest part). Without an anchor the
    smallest part is the reference. A shape without any part in reach is left as it is.
    """
    numbered = F.transform(
        F.col(parts),
        lambda p, i: F.struct(
            points_diagonal(p[0]).alias("diag"), i.alias("i"), ring_centroid_area(p[0]).alias("c"), p.alias("poly")
        ),
    )
    df = df.withColumn("_infos", numbered)
    smallest = F.array_min(F.transform("_infos", lambda s: F.struct(s["diag"], s["i"], s["c"])))
    known = F.col(lat).isNotNull() & F.col(lng).isNotNull() & ~F.isnan(lat) & ~F.isnan(lng)
    df = df.withColumns(
        {
            "_rlat": F.when(known, F.col(lat)).otherwise(smallest["c"]["lat"]),
            "_rlng": F.when(known, F.col(lng)).otherwise(smallest["c"]["lng"]),
        }
    )
    placed = F.array_sort(
        F.transform(
            "_infos",
            lambda s: F.struct(
                haversine(F.col("_rlat"), F.col("_rlng"), s["c"]["lat"], s["c"]["lng"]).alias("d"),
                s["i"].alias("i"), s["diag"].alias("diag"), s["poly"].alias("poly"),
            ),
        )
    )
    df = df.withColumn("_placed", placed)
    reach = F.greatest(F.lit(KEEP_MIN_KM), F.col("_placed")[0]["diag"] * KEEP_DIAGONALS)
    kept = F.transform(F.filter("_placed", lambda s: s["d"] <= reach), lambda s: s["poly"])
    changed = (F.size(parts) > 1) & (F.size(kept) > 0) & (F.size(kept) < F.size(parts))
    return df.withColumn(out, F.when(changed, kept).otherwise(F.col(parts))).drop(
        "_infos", "_placed", "_rlat", "_rlng"
    )


def reject_far(df: DataFrame, parts: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Null the whole shape when its vertex mean is more than 30 km from a known anchor."""
    clat, clng = vertex_mean(F.col(parts))
    far = haversine(F.col(lat), F.col(lng), clat, clng) > REJECT_KM
    return df.withColumn(parts, F.when(F.coalesce(far, F.lit(False)), None).otherwise(F.col(parts)))


def reasonable_size(parts: Column, nn_km: Column) -> Column:
    limit = F.least(F.lit(SIZE_MAX_KM), F.greatest(nn_km * SIZE_NEIGHBOURS, F.lit(SIZE_MIN_KM)))
    return bbox_diagonal_km(parts) <= limit


def circle(lat: Column, lng: Column, degrees: float = CIRCLE_DEGREES) -> Column:
    """Closed 12-gon around a point as one part with one ring."""
    ring = [
        F.array(
            F.round(lng + degrees * math.cos(2 * math.pi * i / CIRCLE_STEPS), 6),
            F.round(lat + degrees * math.sin(2 * math.pi * i / CIRCLE_STEPS), 6),
        )
        for i in range(CIRCLE_STEPS + 1)
    ]
    return F.array(F.array(F.array(*ring)))


def assemble_boundaries(
    official: DataFrame, cached: DataFrame, anchors: DataFrame, key: str
) -> DataFrame:
    """Official shapes, then cached ones of plausible size, then circles; cleaned and checked.

    ``official``, ``cached``: key, parts. ``anchors``: key, lat, lng, nn_km. Official shapes win and
    are not size-checked; all get far parts dropped and are emptied when nowhere near their anchor.
    The joins are sort-merge: shapes are many times larger than the planner takes them for.
    """
    own = anchors.join(cached.withColumnRenamed("parts", "_cached").hint("merge"), key, "left")
    fits = F.coalesce(reasonable_size(F.col("_cached"), F.col("nn_km")), F.lit(False))
    own = own.select(
        key,
        F.when(fits, F.col("_cached")).otherwise(circle(F.col("lat"), F.col("lng"))).alias("parts"),
        F.when(fits, "cached").otherwise("circle").alias("layer"),
    )
    layers = precedence_union(official.select(key, "parts", F.lit("official").alias("layer")), own, key)
    placed = layers.join(anchors.select(key, "lat", "lng").hint("merge"), key, "left")
    return reject_far(drop_far_parts(placed, "parts"), "parts").select(key, "layer", "parts")
