"""Radius joins, nearest neighbours and spatial statistics as bucketed equi-joins.

Points become 3-D km coordinates. A query ball is covered by grid cells twice its radius wide (at
most eight of them), both sides meet by cell equality, and the exact distance decides. Points at
the same place collapse to one row first, so a place holding a third of all rows stays one row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from placescope.functions.geo import cartesian, chord, haversine

# Cells with more distinct places than this are split among several tasks.
PLACES_PER_SPLIT = 20_000

# Pairs held at once while a task sums over pairs, and tiles per radius that it sorts places into.
PAIRS_AT_ONCE, TILES_PER_RADIUS = 16_384, 4

# Dyadic grid of the neighbour search: level l has cells of FINEST_KM * 2**l km. Coordinates are
# shifted to be positive, so cells nest and the top level holds the whole globe in one cell. With
# coordinates of six decimals (11 cm) a finest cell of 16 m has room for about 21,000 places, which
# bounds the work of a query in the densest spot.
FINEST_KM, TOP_LEVEL, SHIFT_KM = 1 / 64, 21, 8_192.0


def with_xyz(df: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    x, y, z = cartesian(F.col(lat), F.col(lng))
    return df.withColumns({"_x": x, "_y": y, "_z": z})


def _cell(size: float) -> Column:
    return F.struct(*[F.floor(F.col(c) / F.lit(size)).alias(c[1:]) for c in ("_x", "_y", "_z")])


def _covering(radius: Column, size: Column, shift: float = 0.0) -> Column:
    """Array of the cells of a grid that meet the cube around the ball."""

    def span(c: str) -> Column:
        v = F.col(c) + F.lit(shift)
        return F.sequence(F.floor((v - radius) / size), F.floor((v + radius) / size))

    return F.flatten(
        F.transform(
            span("_x"),
            lambda x: F.flatten(
                F.transform(
                    span("_y"),
                    lambda y: F.transform(
                        span("_z"),
                        lambda z: F.struct(x.alias("x"), y.alias("y"), z.alias("z")),
                    ),
                )
            ),
        )
    )


def _squared(prefix: str) -> Column:
    return sum((F.col(f"_{c}") - F.col(f"{prefix}{c}")) ** 2 for c in ("x", "y", "z"))


def _keyed_join(a: DataFrame, b: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Sort-merge join: rows multiplied by ``explode`` are planned as small and would be broadcast whole."""
    return a.join(b.hint("merge"), list(on), how)


def places(points: DataFrame, sums: Mapping[str, Column]) -> DataFrame:
    """One row per distinct (lat, lng) with the given aggregates."""
    return points.groupBy("lat", "lng").agg(*[c.alias(n) for n, c in sums.items()])


def pairs_within(a: DataFrame, b: DataFrame, km: float, chord_km: str = "chord_km") -> DataFrame:
    """Every row of ``a`` next to every row of ``b`` at most ``km`` away, with the chord length.

    ``b``'s columns come prefixed ``b_``. Meant for place tables: feed it collapsed points. Cells of
    ``b`` beyond ``PLACES_PER_SPLIT`` rows are dealt to several splits by content hash and the
    ``a`` rows of such cells are copied to each split, so no task holds a whole hot cell.
    """
    radius = chord(km)
    size = 2 * radius
    left = with_xyz(a).withColumn("_cell", F.explode(_covering(F.lit(radius), F.lit(size))))
    right = with_xyz(b).withColumn("_cell", _cell(size))
    counts = right.groupBy("_cell").agg(
        F.ceil(F.count(F.lit(1)) / PLACES_PER_SPLIT).cast("int").alias("_splits")
    )
    left = left.join(counts, "_cell").withColumn(
        "_split", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1))
    )
    right = (
        right.join(counts, "_cell")
        .withColumn("_split", F.pmod(F.xxhash64("lat", "lng"), F.col("_splits")).cast("int"))
        .select("_cell", "_split", *[F.col(f"_{c}").alias(f"_b{c}") for c in "xyz"],
                *[F.col(c).alias(f"b_{c}") for c in b.columns])
    )
    distance = F.sqrt(_squared("_b"))
    return (
        left.join(right, ["_cell", "_split"])
        .withColumn(chord_km, distance)
        .where(F.col(chord_km) <= radius)
        .select(*a.columns, *[f"b_{c}" for c in b.columns], chord_km)
    )


def _tiles(xyz: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tiles, their row counts and the order that puts rows of a tile together."""
    found, tile, counts = np.unique(np.floor(xyz / width), axis=0, return_inverse=True, return_counts=True)
    return found, counts, np.argsort(tile.reshape(-1), kind="stable")


def _sum_pairs(radius: float, weight: Callable[[np.ndarray], np.ndarray], names: Sequence[str], kept: Sequence[str]):
    """Weighted sums over the right rows in reach for each left row of a group, a tile of left rows at a time.

    Tables are Arrow's: pandas would turn a sum that is not a number into a missing one.
    """
    width = radius / TILES_PER_RADIUS

    def matrix(rows: pa.Table, columns: Sequence[str]) -> np.ndarray:
        return np.column_stack([rows.column(c).to_numpy() for c in columns]).astype("float64", copy=False)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = matrix(left, ("_x", "_y", "_z")), matrix(right, ("_x", "_y", "_z"))
        a_tiles, a_counts, a_order = _tiles(a, width)
        b_tiles, b_counts, b_order = _tiles(b, width)
        b, values = b[b_order], matrix(right, names)[b_order]
        finite = bool(np.isfinite(values).all())
        sums, hits = np.zeros((len(a), len(names))), np.zeros(len(a), dtype=bool)
        ends = np.cumsum(a_counts)
        for tile, end, count in zip(a_tiles, ends, a_counts):
            gap = np.maximum(np.abs(b_tiles - tile) - 1, 0) * width
            meets = np.repeat((gap * gap).sum(axis=1) <= radius * radius * (1 + 1e-9), b_counts)
            if not meets.any():
                continue
            (x, y, z), v = b[meets].T.copy(), values[meets]
            step = max(1, PAIRS_AT_ONCE // len(x))
            for start in range(end - count, end, step):
                at = a_order[start : min(end, start + step)]
                d = np.subtract.outer(a[at, 0], x)
                d *= d
                for other, c in ((a[at, 1], y), (a[at, 2], z)):
                    e = np.subtract.outer(other, c)
                    e *= e
                    d += e
                np.sqrt(d, out=d)
                reached = d <= radius
                w = weight(d)
                np.copyto(w, 0.0, where=~reached)
                hits[at] = reached.any(axis=1)
                # A value that is not finite counts only within reach: 0 x NaN would spread it.
                sums[at] = w @ v if finite else np.where(reached[:, :, None], w[:, :, None] * v, 0.0).sum(axis=1)
        out = left.select(list(kept))
        for i, n in enumerate(names):
            out = out.append_column(n, pa.array(sums[:, i]))
        return out.filter(pa.array(hits))

    return run


def sums_within(spots: DataFrame, km: float, weight: Callable[[np.ndarray], np.ndarray], sums: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Per place the sums of ``weight`` (of the chord lengths) times columns over all places at most ``km`` away.

    ``sums`` names the result of each column, ``keep`` other columns of the place. As in ``pairs_within``
    both sides meet in cells twice the radius wide; no pair becomes a row. Both sides of a cell beyond
    ``PLACES_PER_SPLIT`` rows are split by content hash and every split of one side meets every split of
    the other, so a group has a bounded number of rows.
    """
    radius = chord(km)
    size, cell = 2 * radius, ["_cx", "_cy", "_cz"]
    placed = with_xyz(spots).where("_x is not null and not isnan(_x)")
    at = ["lat", "lng", "_x", "_y", "_z"]

    def in_cells(column: str) -> list[Column]:
        return [F.col(f"{column}.{c}").alias(f"_c{c}") for c in "xyz"]

    left = placed.withColumn("_c", F.explode(_covering(F.lit(radius), F.lit(size)))).select(*at, *keep, *in_cells("_c"))
    right = placed.withColumn("_c", _cell(size)).select(
        *[F.col(c).alias(c) for c in at], *[F.col(c).cast("double").alias(n) for n, c in sums.items()], *in_cells("_c")
    )
    splits = lambda n: F.ceil(F.count(F.lit(1)) / PLACES_PER_SPLIT).cast("int").alias(n)
    counts = _keyed_join(left.groupBy(*cell).agg(splits("_m")), right.groupBy(*cell).agg(splits("_n")), cell)
    own = lambda n: F.array(F.pmod(F.xxhash64("lat", "lng"), F.col(n)).cast("int"))
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    group = [*cell, "_i", "_j"]
    parts = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(side: DataFrame, i: Column, j: Column) -> DataFrame:
        met = _keyed_join(side, counts, cell).withColumn("_i", F.explode(i)).withColumn("_j", F.explode(j))
        return met.drop("_m", "_n").repartition(parts, *group).groupBy(*group)

    kept = ["lat", "lng", *keep]
    schema = left.select(*kept).schema
    for n in sums:
        schema = schema.add(n, "double")
    found = dealt(left, own("_m"), all_of("_n")).cogroup(dealt(right, all_of("_m"), own("_n"))).applyInArrow(
        _sum_pairs(radius, weight, list(sums), kept), schema
    )
    return found.groupBy("lat", "lng").agg(*[F.first(k).alias(k) for k in keep], *[F.sum(n).alias(n) for n in sums])


def _levels() -> Column:
    """Cells of all levels a point lies in, as (level, x, y, z)."""

    def at(level: int) -> Column:
        size = FINEST_KM * 2**level
        return F.struct(
            F.lit(level).alias("level"),
            *[F.floor((F.col(f"_{c}") + SHIFT_KM) / F.lit(size)).alias(c) for c in ("x", "y", "z")],
        )

    return F.array(*[at(level) for level in range(TOP_LEVEL + 1)])


def knn(
    queries: DataFrame,
    refs: DataFrame,
    query_key: str,
    ref_key: str,
    k: int,
    values: Sequence[str] = (),
    exclude_self: bool = False,
    max_km: float | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """The k nearest reference points of each query point, exactly; ties go to the smaller key.

    Two steps without a driver loop. Step 1 finds per query the finest own cell holding enough
    references and takes a few of that cell: their k-th distance is a sure upper bound. Step 2
    searches all cells the ball of that bound meets. References at one place are cut to the k
    smallest keys first, since no query can use more of them.

    ``by`` names columns that must agree (a candidate pool). Result: query_key, ref_key, values,
    dist_km (great circle) and rank.
    """
    by = list(by)
    need = k + 1 if exclude_self else k
    first = W.partitionBy(*by, "lat", "lng").orderBy(ref_key)
    refs = (
        refs.select(*by, ref_key, "lat", "lng", *values)
        .where("lat is not null and lng is not null")
        .withColumn("_rn", F.row_number().over(first))
        .where(F.col("_rn") <= need)
        .drop("_rn")
    )
    r = with_xyz(refs).select(
        *by,
        F.col(ref_key).alias("_rk"),
        F.col("lat").alias("_rlat"),
        F.col("lng").alias("_rlng"),
        *[F.col(v).alias(f"_v_{v}") for v in values],
        "_x", "_y", "_z",
    )
    # Dealt by key first: a small file would be one task, and each row becomes TOP_LEVEL + 1 rows.
    q = with_xyz(queries.select(*by, query_key, "lat", "lng").repartition(query_key)).where("_x is not null")
    r_cells = r.withColumn("_c", F.explode(_levels()))
    placed = r_cells.select(*by, "_c", "_rk", F.col("_x").alias("_bx"), F.col("_y").alias("_by"), F.col("_z").alias("_bz"))
    in_cell = W.partitionBy(*by, "_c").orderBy("_rk")
    sample = (
        placed.withColumn("_rn", F.row_number().over(in_cell)).where(F.col("_rn") <= 4 * need).drop("_rn")
    )
    # The sample is already grouped by cell, so telling the full cells needs no further shuffle.
    full = sample.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= need)
    top = F.struct(F.lit(TOP_LEVEL).alias("level"), *[F.lit(0).cast("long").alias(c) for c in "xyz"])
    own = (
        _keyed_join(q.select(*by, query_key, F.explode(_levels()).alias("_c")), full, [*by, "_c"])
        .groupBy(query_key, *by)
        .agg(F.min_by("_c", F.col("_c.level")).alias("_c"))
    )
    q_own = _keyed_join(q, own, [query_key, *by], "left").withColumn("_c", F.coalesce("_c", top))
    near = _keyed_join(q_own, sample, [*by, "_c"]).select(query_key, F.sqrt(_squared("_b")).alias("_d"))
    to_kth = W.partitionBy(query_key).orderBy("_d")
    kth = (
        near.withColumn("_rn", F.row_number().over(to_kth))
        .where(F.col("_rn") <= need)
        .groupBy(query_key)
        .agg(F.max("_d").alias("_d"), F.count(F.lit(1)).alias("_n"))
    )
    limit = 2 * 6371.0 if max_km is None else chord(max_km)
    # A hair above the bound keeps the k-th point itself inside after rounding.
    bound = F.when(F.col("_n") >= need, F.col("_d") * (1 + 1e-9) + 1e-6).otherwise(F.lit(2 * 6371.0))
    q_ball = _keyed_join(q, kth, [query_key]).withColumn("_radius", F.least(bound, F.lit(limit)))
    level = F.greatest(
        F.lit(0), F.least(F.lit(TOP_LEVEL), F.ceil(F.log2(F.col("_radius") / F.lit(FINEST_KM))).cast("int"))
    )
    size = F.lit(FINEST_KM) * F.pow(F.lit(2.0), F.col("_level"))
    cover = F.transform(
        _covering(F.col("_radius"), size, SHIFT_KM),
        lambda c: F.struct(F.col("_level").alias("level"), c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z")),
    )
    q_ball = q_ball.withColumn("_level", level)
    # At most TOP_LEVEL + 1 rows: references stand only in cells of a level that some ball is searched on.
    searched = F.broadcast(q_ball.select(F.col("_level").alias("_used")).distinct())
    q_cells = q_ball.withColumn("_c", F.explode(cover)).select(
        query_key, *by, "_c", "_radius", F.col("lat").alias("_qlat"), F.col("lng").alias("_qlng"),
        *[F.col(f"_{c}").alias(f"_q{c}") for c in "xyz"],
    )
    hits = (
        _keyed_join(q_cells, r_cells.join(searched, F.col("_c.level") == F.col("_used"), "left_semi"), [*by, "_c"])
        .withColumn("_chord", F.sqrt(_squared("_q")))
        .where(F.col("_chord") <= F.col("_radius"))
    )
    if exclude_self:
        hits = hits.where(F.col(query_key) != F.col("_rk"))
    order = W.partitionBy(query_key).orderBy("_chord", "_rk")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(
            query_key,
            F.col("_rk").alias(ref_key if ref_key != query_key else f"near_{ref_key}"),
            *[F.col(f"_v_{v}").alias(v) for v in values],
            haversine(F.col("_qlat"), F.col("_qlng"), F.col("_rlat"), F.col("_rlng")).alias("dist_km"),
            "rank",
        )
    )


def idw(
    neighbours: DataFrame, key: str, values: Sequence[str], floor_km: float = 0.5
) -> DataFrame:
    """Inverse-distance mean of neighbour values, the distance floored."""
    w = 1 / F.greatest(F.col("dist_km"), F.lit(floor_km))
    return neighbours.groupBy(key).agg(
        *[(F.sum(F.col(v) * w) / F.sum(F.when(F.col(v).isNotNull(), w))).alias(v) for v in values]
    )


def pooled_knn(
    queries: DataFrame,
    refs: DataFrame,
    query_key: str,
    ref_key: str,
    pool: str,
    k: int,
    values: Sequence[str],
    min_pool: int = 3,
) -> DataFrame:
    """kNN inside the query's own pool where that has ``min_pool`` rows, else among all."""
    sizes = refs.groupBy(pool).agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= min_pool)
    own = queries.join(sizes, pool, "left_semi")
    rest = queries.join(sizes, pool, "left_anti")
    inside = knn(own, refs, query_key, ref_key, k, values, by=[pool])
    return inside.unionByName(knn(rest, refs, query_key, ref_key, k, values))


def nearest_other(points: DataFrame, key: str, alone_km: float = 5.0) -> DataFrame:
    """Distance from each point to the closest other one; the default when there is none."""
    near = knn(points, points, key, key, 1, exclude_self=True).select(key, "dist_km")
    return points.select(key).join(near, key, "left").select(
        key, F.coalesce("dist_km", F.lit(alone_km)).alias("nn_km")
    )


def density(
    centres: DataFrame, pois: DataFrame, key: str, km: float, counts: Mapping[str, Column], digits: int
) -> DataFrame:
    """Counts of points around each centre by class, and their total per square km."""
    import math

    spots = places(pois, {n: F.count_if(c) for n, c in counts.items()})
    sites = centres.select("lat", "lng").distinct()
    found = pairs_within(sites, spots, km).groupBy("lat", "lng").agg(
        *[F.sum(f"b_{n}").alias(n) for n in counts]
    )
    out = centres.select(key, "lat", "lng").join(found, ["lat", "lng"], "left")
    filled = {n: F.coalesce(n, F.lit(0)).alias(n) for n in counts}
    area = math.pi * km**2
    total = sum((F.col(n) for n in counts), F.lit(0))
    return out.select(key, *filled.values()).withColumn(
        "per_km2", F.bround(total / F.lit(area), digits)
    )


def smooth(points: DataFrame, key: str, value: str, km: float = 20.0, floor_km: float = 0.1) -> DataFrame:
    """Inverse-distance mean over all points within ``km`` including the point itself.

    All points of a place share the result, so weights are summed per place pair.
    """
    spots = places(points.where(F.col(value).isNotNull()), {"_n": F.count(F.lit(1)), "_s": F.sum(value)})
    sums = sums_within(spots, km, lambda d: 1 / np.maximum(d, floor_km), {"_ws": "_s", "_w": "_n"})
    smoothed = sums.select("lat", "lng", (F.col("_ws") / F.col("_w")).alias("smoothed"))
    return points.select(key, "lat", "lng").join(smoothed, ["lat", "lng"]).select(key, "smoothed")


def morans_i(points: DataFrame, value: str, km: float = 25.0) -> DataFrame:
    """One row: Moran's I with row-normalised weights 1/(d+1)^2 within ``km``; 0 without pairs."""
    rows = points.where(F.col(value).isNotNull())
    mean = rows.agg(F.avg(value)).scalar()
    spots = places(
        rows.select("lat", "lng", (F.col(value) - mean).alias("_z")),
        {"_n": F.count(F.lit(1)), "_s": F.sum("_z"), "_q": F.sum(F.col("_z") * F.col("_z"))},
    )
    per_place = sums_within(spots, km, lambda d: 1 / ((d + 1) * (d + 1)), {"_w": "_n", "_ws": "_s"}, ["_s", "_q"])
    per_place = per_place.withColumn("_w", F.col("_w") - 1)
    # Each member's own pair has weight 1 and is taken out again.
    part = F.when(
        F.col("_w") > 1e-12, (F.col("_s") * F.col("_ws") - F.col("_q")) / (F.col("_w") + 1e-9)
    ).otherwise(0.0)
    return per_place.agg(
        F.coalesce(F.sum(part) / (F.sum("_q") + 1e-9), F.lit(0.0)).alias("morans_i")
    )
