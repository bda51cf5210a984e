import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placescope.operators import spatial


def hav(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    s = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(s)))


@pytest.fixture(scope="module")
def world():
    """A dense spot holding a third of the points, a town, and points across the globe and date line."""
    rng = np.random.default_rng(7)
    pts = [(12.5, 77.5)] * 100
    pts += [(12.5 + x, 77.5 + y) for x, y in rng.normal(0, 0.05, (100, 2))]
    pts += [(float(a), float(o)) for a, o in zip(rng.uniform(-89, 89, 90), rng.uniform(-180, 180, 90))]
    pts += [(89.9, 10.0), (-89.9, 50.0), (10.0, 179.99), (10.0, -179.99), (0.0, 0.0)]
    return [(i, float(la), float(lo), float(i % 17)) for i, (la, lo) in enumerate(pts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, lat double, lng double, v double")


def brute(queries, refs, k, skip_self=False, max_km=None):
    out = {}
    for q in queries:
        near = sorted(
            (round(hav(q[1:3], r[1:3]), 9), r[0])
            for r in refs
            if not (skip_self and r[0] == q[0]) and (max_km is None or hav(q[1:3], r[1:3]) <= max_km)
        )
        out[q[0]] = near[:k]
    return out


def collected(df, ref):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r["q"], []).append((r["dist_km"], r[ref]))
    return out


def assert_same(got, want):
    for q, near in want.items():
        mine = got.get(q, [])
        assert [k for _, k in mine] == [k for _, k in near]
        assert [d for d, _ in mine] == pytest.approx([d for d, _ in near], abs=1e-6)


def test_knn_equals_brute_force(spark, world):
    queries = [(1000 + i, la, lo, v) for i, la, lo, v in world[::7]]
    q = frame(spark, queries).withColumnRenamed("k", "q")
    got = collected(spatial.knn(q, frame(spark, world), "q", "k", 5), "k")
    assert_same(got, brute(queries, world, 5))


def test_knn_of_few_references_and_far_queries(spark, world):
    q = frame(spark, world[:3] + world[-5:]).withColumnRenamed("k", "q")
    refs = [(1, -33.0, 151.0, 1.0), (2, 51.5, 0.0, 2.0)]
    got = collected(spatial.knn(q, frame(spark, refs), "q", "k", 5), "k")
    assert_same(got, brute(world[:3] + world[-5:], refs, 5))


def test_knn_excludes_self_and_keeps_radius(spark, world):
    df = frame(spark, world)
    near = spatial.knn(df, df, "k", "k", 3, exclude_self=True).withColumnRenamed("k", "q")
    assert_same(collected(near, "near_k"), brute(world, world, 3, skip_self=True))
    q = df.withColumnRenamed("k", "q")
    got = collected(spatial.knn(q, df, "q", "k", 4, max_km=8), "k")
    want = brute(world, world, 4, max_km=8)
    assert_same(got, want)
    assert set(got) == {q for q, near in want.items() if near}


def test_nearest_other_alone_gets_default(spark):
    one = frame(spark, [(1, 10.0, 20.0, 0.0)])
    assert spatial.nearest_other(one, "k").first()["nn_km"] == 5.0


def test_pairs_split_hot_cells(spark, world, monkeypatch):
    monkeypatch.setattr(spatial, "PLACES_PER_SPLIT", 10)
    spots = frame(spark, world).select("lat", "lng").distinct()
    got = spatial.pairs_within(spots, spots, 15).count()
    pts = [(r["lat"], r["lng"]) for r in spots.collect()]
    assert got == sum(hav(a, b) <= 15 for a in pts for b in pts)


def test_smoother_and_density_equal_brute_force(spark, world):
    df = frame(spark, world)
    smooth = {r["k"]: r["smoothed"] for r in spatial.smooth(df, "k", "v").collect()}
    dense = {r["k"]: r["n"] for r in spatial.density(df, df, "k", 10, {"n": F.lit(True)}, 4).collect()}
    for k, la, lo, _ in world:
        chord = [(2 * 6371 * math.sin(hav((la, lo), r[1:3]) / 2 / 6371), r[3], hav((la, lo), r[1:3])) for r in world]
        w = [(1 / max(d, 0.1), v) for d, v, h in chord if h <= 20]
        assert smooth[k] == pytest.approx(sum(a * v for a, v in w) / sum(a for a, _ in w), rel=1e-6)
        assert dense[k] == sum(h <= 10 for *_, h in chord)


def test_pair_sums_split_both_sides_and_keep_odd_values_within_reach(spark, world, monkeypatch):
    """No pair becomes a row; a value that is not a number reaches its neighbours only."""
    monkeypatch.setattr(spatial, "PLACES_PER_SPLIT", 10)
    df = frame(spark, [*world, (9000, -45.0, 100.0, float("nan")), (9001, -45.01, 100.0, 1.0), (9002, None, 1.0, 1.0)])
    out = spatial.smooth(df, "k", "v")
    assert "FlatMapCoGroupsInArrow" in out._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["smoothed"] for r in out.collect()}
    assert 9002 not in got and {k for k, v in got.items() if math.isnan(v)} == {9000, 9001}
    for k, la, lo, _ in world[::9]:
        near = [(1 / max(2 * 6371 * math.sin(hav((la, lo), r[1:3]) / 2 / 6371), 0.1), r[3]) for r in world if hav((la, lo), r[1:3]) <= 20]
        assert got[k] == pytest.approx(sum(a * v for a, v in near) / sum(a for a, _ in near), rel=1e-6)


def test_morans_i(spark, world):
    df = frame(spark, world)
    z = np.array([r[3] for r in world]) - np.mean([r[3] for r in world])
    top = 0.0
    for i, a in enumerate(world):
        w = [(1 / (2 * 6371 * math.sin(hav(a[1:3], b[1:3]) / 2 / 6371) + 1) ** 2, z[j]) for j, b in enumerate(world) if j != i and hav(a[1:3], b[1:3]) <= 25]
        if w:
            top += z[i] * sum(x * y for x, y in w) / (sum(x for x, _ in w) + 1e-9)
    got = spatial.morans_i(df, "v").first()[0]
    assert got == pytest.approx(top / ((z**2).sum() + 1e-9), abs=1e-7)
    flat = df.withColumn("v", F.lit(3.0))
    assert spatial.morans_i(flat, "v").first()[0] == 0.0


def test_idw_stays_between_its_neighbours(spark, world):
    df = frame(spark, world)
    near = spatial.knn(df.withColumnRenamed("k", "q").drop("v"), df, "q", "k", 5, ["v"])
    out = spatial.idw(near, "q", ["v"]).join(near.groupBy("q").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "q")
    assert out.where("v < lo - 1e-9 or v > hi + 1e-9").count() == 0


def broadcasts(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "BroadcastExchange" in line], plan


def test_neighbour_search_broadcasts_only_the_searched_levels(spark, world, tmp_path):
    """Points of a packed file are planned as small; broadcast after the explode they stopped the driver."""
    frame(spark, world).write.parquet(str(tmp_path / "points"))
    df = spark.read.parquet(str(tmp_path / "points"))
    for out in (spatial.nearest_other(df, "k"), spatial.knn(df.withColumnRenamed("k", "q"), df, "q", "k", 8, ["v"], max_km=30)):
        found, plan = broadcasts(out.where("true"))
        assert plan.count("LeftSemi, BuildRight") == len(found) >= 1


def test_no_nested_loop_or_cartesian_plan(spark, world):
    df = frame(spark, world)
    for out in (spatial.knn(df.withColumnRenamed("k", "q"), df, "q", "k", 3), spatial.smooth(df, "k", "v")):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
