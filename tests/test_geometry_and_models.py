import math
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from placescope.operators import geometry, model

SQUARE = [[77.0, 12.0], [77.1, 12.0], [77.1, 12.1], [77.0, 12.1], [77.0, 12.0]]
FAR = [[79.0, 15.0], [79.5, 15.0], [79.5, 15.5], [79.0, 15.0]]
TINY = [[77.2, 12.0], [77.201, 12.0], [77.201, 12.001], [77.2, 12.0]]


def shape(spark, parts, lat=12.05, lng=77.05):
    return spark.createDataFrame([(1, lat, lng, parts)], "k int, lat double, lng double, parts array<array<array<array<double>>>>")


def test_ring_centroid_area_and_degenerate_rings(spark):
    df = shape(spark, [[SQUARE], [[[1.0, 2.0], [3.0, 4.0]]], [[[1.0, 1.0], [2.0, 2.0], [3.0, 3.0], [1.0, 1.0]]]])
    got = [r[0] for r in df.select(F.explode("parts").alias("p")).select(geometry.ring_centroid_area(F.col("p")[0])).collect()]
    assert got[0]["lng"] == pytest.approx(77.05) and got[0]["area"] == pytest.approx(0.01)
    assert (got[1]["lng"], got[1]["lat"], got[1]["area"]) == (2.0, 3.0, 0.0)
    assert (got[2]["lng"], got[2]["area"]) == (1.75, 0.0)


def test_far_part_goes_and_malformed_anchor_falls_back(spark):
    kept = geometry.drop_far_parts(shape(spark, [[FAR], [SQUARE], [TINY]]), "parts").first()["parts"]
    assert kept == [[SQUARE], [TINY]]
    nan = geometry.drop_far_parts(shape(spark, [[FAR], [SQUARE], [TINY]], lat=float("nan")), "parts").first()["parts"]
    assert nan == [[TINY]]
    single = geometry.drop_far_parts(shape(spark, [[FAR]]), "parts").first()["parts"]
    assert single == [[FAR]]


def test_reject_size_and_circle(spark):
    assert geometry.reject_far(shape(spark, [[FAR]]), "parts").first()["parts"] is None
    df = shape(spark, [[SQUARE]])
    sized = df.select(geometry.reasonable_size(F.col("parts"), F.lit(1.0)), geometry.reasonable_size(F.col("parts"), F.lit(9.0))).first()
    assert tuple(sized) == (False, False)
    ring = df.select(geometry.circle(F.col("lat"), F.col("lng"))).first()[0][0][0]
    assert len(ring) == 13 and ring[0] == [77.062, 12.05] and ring[3] == [77.05, 12.062]


def data(spark, n=400, d=4):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d))
    x = (x - x.mean(0)) / x.std(0)
    y = x @ np.arange(1, d + 1) + rng.normal(size=n)
    y = (y - y.mean()) / y.std()
    names = [f"f{i}" for i in range(d)]
    df = spark.createDataFrame([(i, float(y[i]), *map(float, x[i])) for i in range(n)], ["k", "target", *names])
    return df, x, y, names


def test_pca_ridge_equals_normal_equations(spark):
    df, x, y, names = data(spark)
    z, importance, explained = model.pca_ridge(df, "k", names, components=4)
    coef = np.linalg.solve(x.T @ x + np.eye(4), x.T @ y)
    got = np.array([r["z_linear"] for r in z.orderBy("k").collect()])
    assert np.abs(got - x @ coef).max() < 1e-8
    assert sum(importance.values()) == pytest.approx(1.0) and sum(explained) == pytest.approx(1.0)


def test_leave_one_out_equals_refits(spark):
    df, x, y, names = data(spark, 60)
    errors = []
    for i in range(60):
        keep = np.arange(60) != i
        xm, ym = x[keep].mean(0), y[keep].mean()
        coef = np.linalg.solve((x[keep] - xm).T @ (x[keep] - xm) + np.eye(4), (x[keep] - xm).T @ (y[keep] - ym))
        errors.append(y[i] - ym - (x[i] - xm) @ coef)
    # The free intercept makes the leverage formula exact for a ridge with unpenalised mean.
    assert model.ridge_loo_rmse(df, names) == pytest.approx(math.sqrt(np.mean(np.square(errors))), rel=2e-3)


def test_trees_beat_the_mean_and_importance_finds_the_strong_feature(spark):
    df, _, y, names = data(spark)
    z, fitted = model.boosted_trees(df, "k", names, iterations=15)
    rmse = z.join(df, "k").select(F.sqrt(F.avg((F.col("z_trees") - F.col("target")) ** 2))).first()[0]
    assert rmse < 0.8 * y.std()
    imp = {r["feature"]: r["importance"] for r in model.permutation_importance(fitted, df, "k", names).collect()}
    assert max(imp, key=imp.get) == "f3" and sum(imp.values()) == pytest.approx(1.0, abs=1e-3)


def test_isolation_forest_ranks_outliers_and_is_repeatable(spark):
    df, _, _, names = data(spark)
    odd = spark.createDataFrame([(9999, 0.0, 9.0, -9.0, 9.0, -9.0)], df.schema)
    scores = model.isolation_scores(df.unionByName(odd), "k", names, trees=40)
    rows = {r["k"]: r for r in scores.collect()}
    assert max(rows.values(), key=lambda r: r["anomaly_score"])["k"] == 9999 and rows[9999]["is_anomaly"]
    assert sum(r["is_anomaly"] for r in rows.values()) == pytest.approx(40, abs=2)
    again = model.isolation_scores(df.unionByName(odd), "k", names, trees=40)
    assert {r["k"]: r["anomaly_score"] for r in again.collect()} == {k: r["anomaly_score"] for k, r in rows.items()}


def test_credibility_and_blend(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0)], "k int, g string, z double")
    got = {r["k"]: r["z_adj"] for r in model.credibility(df, "g").collect()}
    alpha = 2 / 52
    assert got[1] == pytest.approx(alpha * -1 + (1 - alpha) * 1.0) and got[3] == 5.0
    lone = spark.createDataFrame([(1, 7.0)], "k int, v double")
    assert {r["z"] for r in model.regional_blend(df, lone, "k", "v").collect()} == {1.0, 3.0, 5.0}


def test_index_and_money_saturate_together(spark):
    df = spark.createDataFrame([(10 / 3,), (9.0,), (-9.0,)], "z_adj double").withColumn("anchor", F.lit(7000.0))
    r = model.index_and_money(df).collect()
    assert (r[0]["index_ml"], r[1]["index_ml"], r[2]["index_ml"]) == (200, 200, 40)
    assert r[0]["est_monthly_income_hh"] == r[1]["est_monthly_income_hh"]


def test_refit_uses_anchors_growth_and_the_drift_gate(spark):
    """Twins that differ in their anchor only get the same index and money in the ratio of the anchors."""
    from placescope.plans import refit

    rows = []
    for k in range(60):
        nation, twin = k % 3, k // 2 if k < 20 else k
        fixed = random.Random(twin)
        rows.append((k, f"n{k}", 10.0 + (twin % 7) / 10, 70.0 + (twin % 5) / 10, f"{twin % 4}", f"{twin % 2}", nation if k >= 20 else 1, fixed.random(), fixed.random() if twin % 3 else None, fixed.random()))
    table = spark.createDataFrame(rows, "k long, name string, lat double, lng double, fine string, coarse string, nation long, a double, b double, c double")
    own = spark.createDataFrame([(k, 5000.0 if k % 2 else 10000.0) for k in range(20)] + [(21, 0.0)], "k long, own_anchor double")
    regions = spark.createDataFrame([(0, 6000.0, 1.5), (1, None, -2.0)], "nation long, region_anchor double, region_growth double")
    anchored = {r.k: (r.own_anchor, r.region_anchor, r.region_growth) for r in refit.with_anchors(table, "k", own, regions).collect()}
    assert anchored[0] == (10000.0, None, -2.0) and anchored[21] == (0.0, 6000.0, 1.5) and anchored[20] == (None, None, None)
    before = spark.createDataFrame([(k, 100 if k else 300) for k in range(60)], "k long, index_ml int")
    done = refit.run(table, "k", ["a", "b", "c"], ("c",), rate="a", regional="b", tree_iterations=2, forest_trees=2, own_anchors=own, regions=regions, covered_region=1, previous=before)
    got = {r.k: r for r in done.scores.collect()}
    for k in range(0, 20, 2):
        one, two = got[k], got[k + 1]
        assert one.index_ml == two.index_ml and abs(one.est_monthly_spend_hh - 2 * two.est_monthly_spend_hh) <= 300 and one.est_monthly_spend_hh > two.est_monthly_spend_hh
    said = done.diagnostics.collect()
    figures = {r.item: r.json for r in said if r.section == "figure"}
    moved = {int(r.item) for r in said if r.section == "drift"}
    assert '"value":60.0' in figures["drift_rows"] and moved == {k for k in got if abs(got[k].index_ml - (100 if k else 300)) > 10} and "linear_region_growth" in figures


def test_refit_smooths_once_and_drift_reads_the_signals_once(spark, monkeypatch):
    """Figures over the smoothed rows are taken from a written table, not by smoothing again."""
    from placescope.operators import spatial
    from placescope.plans import models, refit

    rows = [(k, f"n{k}", 10.0 + k / 100, 70.0, f"{k % 4}", f"{k % 2}", k % 3, float(k), float(k * k % 17), float(k % 5), float(k % 7), float(k % 11)) for k in range(40)]
    table = spark.createDataFrame(rows, "entity long, name string, lat double, lng double, fine string, coarse string, nation long, balance double, spend double, discount double, urgent double, bulk double")
    smoothed, read = spark.sparkContext.accumulator(0), []
    plain, run = spatial.smooth, refit.run

    def counted(points, key, value):
        def each(batches):
            for batch in batches:
                smoothed.add(batch.num_rows)
                yield batch

        out = plain(points, key, value)
        return out.mapInArrow(each, out.schema)

    def signals(spark, sf):
        read.append(sf)
        return table

    monkeypatch.setattr(spatial, "smooth", counted)
    monkeypatch.setattr(models, "signal_table", signals)
    monkeypatch.setattr("placescope.plans.scoring.signal_table", signals)
    monkeypatch.setattr(refit, "run", lambda *a, **k: run(*a, tree_iterations=2, forest_trees=2, **k))
    moved = models.sc5_refit(spark, "here").collect()
    assert sorted(r.entity for r in moved) == list(range(40)) and all(r.delta == abs(r.new_value - r.old_value) for r in moved)
    assert read == ["here"] and smoothed.value == 40


def test_folds_are_fitted_side_by_side(spark, monkeypatch):
    """One fold after the other, the first would wait here in vain for the second."""
    both = threading.Barrier(2, timeout=60)
    fitted = model._trees

    class Together:
        def fit(self, rows):
            both.wait()
            return fitted(2).fit(rows)

    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 13).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("target"))
    monkeypatch.setattr(model, "_trees", lambda iterations: Together())
    assert 0 < model.cross_validated_rmse(df, "k", ["a"], folds=2) < 7
