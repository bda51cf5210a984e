import numpy as np
import pytest
from pyspark.sql import functions as F

from placescope.operators import quantile, score, stats
from placescope.operators.quantile import exact_quantiles


def hot_groups(spark, n=6000):
    """A third of all rows in one group, many ties in another."""
    k = F.col("id")
    group = F.when(k % 3 == 0, "hot").when(k % 3 == 1, F.concat(F.lit("g"), (k % 40).cast("string"))).otherwise("ties")
    value = F.when(group == "ties", k % 5).otherwise((k * 7919) % 10007 / 3.0)
    return spark.range(n).select(group.alias("g"), value.cast("double").alias("v"))


def check_quantiles(spark, df):
    probs = {"lo": 0.01, "mid": 0.5, "hi": 0.98}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(part["v"].quantile(p), abs=1e-9)
    overall = exact_quantiles(df, [], "v", {"p95": 0.95}).first()["p95"]
    assert overall == pytest.approx(pdf["v"].quantile(0.95), abs=1e-9)


def test_exact_quantiles_of_groups(spark):
    check_quantiles(spark, hot_groups(spark))


def test_exact_quantiles_with_a_coarse_sketch(spark, monkeypatch):
    # A coarse sketch makes the bracket cut most values off in every group.
    monkeypatch.setattr(quantile, "SKETCH_ACCURACY", 100)
    check_quantiles(spark, hot_groups(spark, 60_000))


def test_exact_quantiles_of_groups_of_every_small_size(spark):
    rows = [(n, float((k * 37) % 101) + k / 7) for n in range(1, 41) for k in range(n)]
    probs = {"a": 0.0, "b": 0.01, "c": 0.02, "d": 0.37, "e": 0.5, "f": 0.98, "g": 0.99, "h": 1.0}
    got = quantile.exact_quantiles(spark.createDataFrame(rows, "n int, v double"), ["n"], "v", probs).toPandas().set_index("n")
    for n in range(1, 41):
        want = [np.quantile([v for m, v in rows if m == n], q) for q in probs.values()]
        assert list(got.loc[n, list(probs)]) == pytest.approx(want)


def test_winsor_z_of_constant_and_null(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 5.0, 1.0), (3, 5.0, 3.0)], "k int, a double, b double")
    rows = {r["k"]: r for r in stats.winsor_z(df, ["a", "b"], 0.0, 1.0).collect()}
    assert [rows[k]["z_a"] for k in (1, 2, 3)] == [0.0, 0.0, 0.0]
    assert rows[1]["z_b"] is None and rows[3]["z_b"] == pytest.approx(1.0)


def test_group_z_falls_back_and_zeroes_single_members(spark):
    rows = [(i, "A|x", "A", float(i)) for i in range(6)] + [(10, "A|y", "A", 4.0), (11, "B|z", "B", 9.0)]
    df = spark.createDataFrame(rows, "k int, fine string, coarse string, v double")
    out = {r["k"]: r for r in stats.group_z(df, ["v"], "fine", "coarse", 5).collect()}
    fine = np.arange(6.0)
    assert out[0]["v"] == pytest.approx((0 - fine.mean()) / fine.std(ddof=1))
    assert out[10]["effective"] == "A" and out[10]["v"] == 0.0
    assert out[11]["v"] == 0.0


def test_band_scalar_edges(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0), ("c", 5.0), ("c", 5.0)], "g string, v double")
    out = {(r["g"], r["v"]): r["s"] for r in stats.band_scalar(df, "v", "g", 0.6, 1.4, "s", need_spread=True).collect()}
    assert out[("a", 1.0)] == pytest.approx(0.6) and out[("a", 3.0)] == pytest.approx(1.4)
    assert out[("a", None)] == 1.0 and out[("b", 2.0)] == 1.0 and out[("c", 5.0)] == 1.0


def test_rank_of_values_with_ties(spark):
    df = spark.range(5000).select("id", ((F.col("id") * 31) % 700).cast("double").alias("v"))
    pdf = stats.rank_of_values(df, "v").toPandas()
    want = pdf["v"].rank(method="max", ascending=False).astype(int)
    assert (pdf["rank"] == want).all()
    distinct = spark.range(20_000).select(((F.col("id") * 7919) % 20011).cast("double").alias("v"))
    pdf = stats.rank_of_values(distinct, "v").toPandas()
    assert (pdf["rank"] == pdf["v"].rank(method="max", ascending=False).astype(int)).all()


def test_composite_renormalises_weights_and_skips_empty_rows(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None), (2, 1.0, -1.0), (3, None, None)], "k int, z_a double, z_b double"
    )
    out = {r["k"]: r for r in score.composite(df, "k", {"a": 0.3, "b": 0.1}).collect()}
    assert out[1]["composite_z"] == 1.0 and out[1]["coverage"] == "1/2"
    assert out[2]["composite_z"] == pytest.approx(0.5) and out[2]["index"] == 115
    assert 3 not in out


def test_money_uses_the_rounded_composite(spark):
    r = score.money(spark.createDataFrame([(0.0,), (4.0,)], "composite_z double")).collect()
    base = 6996 * 4.1
    assert r[0]["est_monthly_spend_hh"] == round(base, -2)
    assert r[1]["est_monthly_income_hh"] == round(base * np.exp(2.2) / 0.45, -2)


def test_gates_skip_missing_keys(spark):
    gates = spark.createDataFrame([("g1", 1, 2), ("g2", 2, 1), ("g3", 1, 9)], "gate string, hi int, lo int")
    scores = spark.createDataFrame([(1, 120), (2, 90)], "k int, v int")
    got = {r["gate"]: r["status"] for r in score.ordering_gates(gates, scores, "k", "v").collect()}
    assert got == {"g1": "PASS", "g2": "FAIL", "g3": "SKIP"}
