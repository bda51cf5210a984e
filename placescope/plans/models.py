"""Queries of the model layer: features, models, blend, anomalies, credibility, full refit."""

from __future__ import annotations

from pyspark.sql import functions as F

from placescope.functions import estimates
from placescope.operators import model, rates, score, spatial, stats
from placescope.plans import refit, roles
from placescope.plans.catalog import Catalog
from placescope.plans.roles import LONG_SQL, SIGNAL_SQL, SIGNALS, Z_SQL
from placescope.plans.scoring import baseline, signal_table
from placescope.session import materialize

CATALOG = Catalog()

MATRIX_SQL = (
    LONG_SQL
    + """, b AS (SELECT signal, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi FROM long GROUP BY 1),
w AS (SELECT entity, signal, greatest(least(value, hi), lo) AS value FROM long JOIN b USING (signal)),
med AS (SELECT signal, median(value) AS med FROM w GROUP BY 1),
grid AS (SELECT e.entity, fine, coarse, m.signal, coalesce(w.value, med) AS value FROM entities e CROSS JOIN med m
  LEFT JOIN w ON w.entity = e.entity AND w.signal = m.signal),
sized AS (SELECT fine, count(*) AS n FROM entities GROUP BY 1),
eff AS (SELECT g.*, CASE WHEN n >= 10 THEN fine ELSE coarse END AS effective FROM grid g JOIN sized USING (fine)),
gz AS (SELECT signal, effective, count(*) AS n, avg(value) AS a, stddev_samp(value) AS d FROM eff WHERE signal IN ('urgent', 'bulk') GROUP BY 1, 2),
mixed AS (SELECT entity, fine, coarse, signal, CASE WHEN signal IN ('urgent', 'bulk')
  THEN CASE WHEN n < 2 THEN 0 ELSE (value - a) / CASE WHEN d > 1e-9 THEN d ELSE 1 END END ELSE value END AS value
  FROM eff LEFT JOIN gz USING (signal, effective)),
sc AS (SELECT signal, avg(value) AS a, stddev_pop(value) AS d FROM mixed GROUP BY 1),
matrix AS (SELECT entity, fine, coarse, signal, (value - a) / CASE WHEN d > 0 THEN d ELSE 1 END AS value FROM mixed JOIN sc USING (signal))"""
)


def matrix(spark, sf):
    """Standardised feature matrix, written once since every model reads it several times."""
    m = refit.features(signal_table(spark, sf), "entity", SIGNALS, ("urgent", "bulk"), min_size=10)
    return materialize(m, "matrix")


def with_target(spark, sf, m):
    t = model.target(signal_table(spark, sf), "entity", "balance", "fine", "coarse", min_size=10)
    return materialize(m.join(t, "entity"), "matrix-target")


@CATALOG.query(
    "sc8_feature_assembly",
    f"""WITH {SIGNAL_SQL}, g AS (SELECT nation, (sum(spend) / nullif(sum(balance), 0) - 1) * 100 AS growth FROM signals GROUP BY 1)
SELECT entity, round(balance, 2) AS balance, round(spend, 2) AS spend, round(discount, 10) AS discount, round(urgent, 2) AS urgent, round(bulk, 2) AS bulk,
  round(growth, 4) AS region_growth FROM signals LEFT JOIN g USING (nation)""",
)
def sc8(spark, sf):
    s = roles.signals(spark, sf)
    figures = s.groupBy("nation").agg(F.sum("balance").alias("base"), F.sum("spend").alias("latest"))
    figures = figures.withColumn("region_growth", F.round(estimates.growth_pct(F.nullif("base", F.lit(0.0)), F.col("latest")), 4))
    out = model.region_feature(s, "nation", figures, "region_growth")
    digits = {"discount": 10}
    return out.select("entity", *[F.round(c, digits.get(c, 2)).alias(c) for c in SIGNALS], "region_growth")


@CATALOG.query(
    "ml13_target",
    f"""WITH {SIGNAL_SQL}, s AS (SELECT fine, count(*) AS n FROM signals GROUP BY 1),
t AS (SELECT entity, coalesce(urgent, (SELECT median(urgent) FROM signals)) AS value, CASE WHEN n >= 10 THEN fine ELSE coarse END AS effective FROM signals JOIN s USING (fine)),
m AS (SELECT effective, count(*) AS n, avg(value) AS a, stddev_samp(value) AS d FROM t GROUP BY 1),
z AS (SELECT entity, CASE WHEN n < 2 THEN 0 ELSE (value - a) / CASE WHEN d > 1e-9 THEN d ELSE 1 END END AS z FROM t JOIN m USING (effective))
SELECT entity, round((z - avg(z) OVER ()) / stddev_pop(z) OVER (), 6) AS target FROM z""",
)
def ml13(spark, sf):
    t = model.target(signal_table(spark, sf), "entity", "urgent", "fine", "coarse", min_size=10)
    return t.withColumn("target", F.round("target", 6))


@CATALOG.query(
    "sc8_standardised_matrix",
    f"WITH {MATRIX_SQL} SELECT entity, signal, round(value, 6) AS value FROM matrix",
)
def sc8_matrix(spark, sf):
    m = refit.features(signal_table(spark, sf), "entity", SIGNALS, ("urgent", "bulk"), min_size=10)
    return stats.to_long(m, "entity", SIGNALS).withColumn("value", F.round("value", 6))


@CATALOG.query("ml1_pca_ridge")
def ml1(spark, sf):
    z, _, _ = model.pca_ridge(with_target(spark, sf, matrix(spark, sf)), "entity", SIGNALS)
    return z.withColumn("z_linear", F.round("z_linear", 6))


@CATALOG.query("ml2_boosted_trees")
def ml2(spark, sf):
    z, _ = model.boosted_trees(with_target(spark, sf, matrix(spark, sf)), "entity", SIGNALS)
    return z.withColumn("z_trees", F.round("z_trees", 6))


@CATALOG.query("ml3_cross_validation")
def ml3(spark, sf):
    """Held-out errors: k folds for the trees, exact leave-one-out for ridge."""
    m = with_target(spark, sf, matrix(spark, sf))
    figures = [
        ("trees_cv_rmse", model.cross_validated_rmse(m, "entity", SIGNALS)),
        ("ridge_loo_rmse", model.ridge_loo_rmse(m, SIGNALS)),
    ]
    return spark.createDataFrame([(n, round(v, 6)) for n, v in figures], "figure string, rmse double")


@CATALOG.query("ml4_permutation_importance")
def ml4(spark, sf):
    m = with_target(spark, sf, matrix(spark, sf))
    _, trees = model.boosted_trees(m, "entity", SIGNALS)
    return model.permutation_importance(trees, m, "entity", SIGNALS)


@CATALOG.query(
    "ml6_ensemble",
    f"""WITH {Z_SQL}, p AS (SELECT entity, max(CASE WHEN signal = 'balance' THEN z END) AS a, max(CASE WHEN signal = 'spend' THEN z END) AS b,
  max(CASE WHEN signal = 'discount' THEN z END) AS c FROM zs GROUP BY 1),
e AS (SELECT entity, 0.45 * coalesce(a, 0) + 0.35 * coalesce(b, 0) + 0.20 * coalesce(c, 0) AS m FROM p)
SELECT entity, round((m - avg(m) OVER ()) / stddev_pop(m) OVER (), 6) AS z FROM e""",
)
def ml6(spark, sf):
    """Three signals stand in for the three model scores, a missing one as the mean; the check needs no model fit."""
    z = stats.winsor_z(signal_table(spark, sf), SIGNALS).fillna(0.0, ["z_balance", "z_spend", "z_discount"])
    named = z.select("entity", "z_balance", "z_spend", "z_discount").toDF(
        "entity", "z_linear", "z_trees", "z_spatial"
    )
    return model.ensemble(named).select("entity", F.round("z", 6).alias("z"))


@CATALOG.query(
    "ml7_regional_blend",
    f"""WITH {SIGNAL_SQL}, g AS (SELECT entity, (balance - avg(balance) OVER ()) / stddev_pop(balance) OVER () AS z, bulk, nation FROM signals),
r AS (SELECT avg(bulk) AS m, stddev_samp(bulk) AS s FROM g WHERE bulk IS NOT NULL AND nation = 7)
SELECT entity, round(CASE WHEN bulk IS NOT NULL AND nation = 7 THEN 0.7 * z + 0.3 * (bulk - m) / s ELSE z END, 6) AS z FROM g, r""",
)
def ml7(spark, sf):
    s = signal_table(spark, sf)
    z = stats.standardize(s.select("entity", F.col("balance").alias("z")), ["z"])
    regional = s.where("nation = 7").select("entity", "bulk")
    return model.regional_blend(z, regional, "entity", "bulk").select("entity", F.round("z", 6).alias("z"))


@CATALOG.query("ml8_isolation_forest")
def ml8(spark, sf):
    out = model.isolation_scores(matrix(spark, sf), "entity", SIGNALS)
    return out.withColumn("anomaly_score", F.round("anomaly_score", 4))


@CATALOG.query(
    "ml9_top_deviant",
    f"""WITH {MATRIX_SQL}, m AS (SELECT fine, signal, avg(value) AS a FROM matrix GROUP BY 1, 2),
d AS (SELECT entity, signal, abs(value - a) AS gap, list_position(['balance', 'spend', 'discount', 'urgent', 'bulk'], signal) AS o FROM matrix JOIN m USING (fine, signal))
SELECT entity, arg_max(signal, (gap, -o)) AS top_feature, round(max(gap), 3) AS deviation FROM d GROUP BY 1""",
)
def ml9(spark, sf):
    m = refit.features(signal_table(spark, sf), "entity", SIGNALS, ("urgent", "bulk"), min_size=10)
    long = stats.to_long(m, "entity", SIGNALS, keep=("fine",))
    return model.top_deviant(long, "entity", "fine", SIGNALS).withColumn("deviation", F.round("deviation", 3))


@CATALOG.query(
    "ml11_credibility",
    f"""WITH {SIGNAL_SQL}, g AS (SELECT entity, fine, nation, (balance - avg(balance) OVER ()) / stddev_pop(balance) OVER () AS z FROM signals),
s AS (SELECT fine, count(*) AS n, avg(z) AS m, stddev_pop(z) AS d FROM g GROUP BY 1),
a AS (SELECT entity, nation, CASE WHEN n < 2 THEN z ELSE n / (n + 50) * ((z - m) / CASE WHEN d > 0 THEN d ELSE 1 END) + (1 - n / (n + 50)) * z END AS z_adj FROM g JOIN s USING (fine)),
i AS (SELECT *, greatest(least(z_adj, 100 / 30.0::DOUBLE), -2) AS zc, CASE WHEN nation < 5 THEN 6500 + 100 * nation ELSE 7000 END AS anchor FROM a)
SELECT entity, round(z_adj, 6) AS z_adj, CAST(round_even(greatest(least(100 + 30 * z_adj, 200), 40), 0) AS INTEGER) AS index_ml,
  round_even(anchor * 4.1::DOUBLE * exp(0.55 * zc) / greatest(least(0.82 - 0.10 * zc, 0.85), 0.45), -2) AS est_monthly_income_hh,
  round_even(anchor * 4.1::DOUBLE * exp(0.55 * zc), -2) AS est_monthly_spend_hh FROM i""",
)
def ml11(spark, sf):
    s = roles.entities(spark, sf).select("entity", "fine", "nation", F.col("balance").alias("z"))
    adj = model.credibility(stats.standardize(s, ["z"]), "fine")
    own = F.when(F.col("nation") < 5, (6500 + 100 * F.col("nation")).cast("double"))
    out = model.index_and_money(adj.withColumn("anchor", model.anchor(own, F.lit(None).cast("double"))))
    return out.select(
        "entity", F.round("z_adj", 6).alias("z_adj"), "index_ml", "est_monthly_income_hh", "est_monthly_spend_hh"
    )


@CATALOG.query(
    "ml12_anchor_precedence",
    f"""WITH {SIGNAL_SQL}, r AS (SELECT nation, round(avg(urgent), 2) AS v FROM signals WHERE nation % 2 = 0 GROUP BY 1)
SELECT entity, coalesce(nullif(round(bulk, 2), 0), v, 7000) AS anchor FROM signals LEFT JOIN r USING (nation)""",
)
def ml12(spark, sf):
    s = roles.signals(spark, sf)
    by_region = s.where("nation % 2 = 0").groupBy("nation").agg(F.round(F.avg("urgent"), 2).alias("v"))
    joined = rates.attach(s, by_region, "nation")
    return joined.select("entity", model.anchor(F.round("bulk", 2), F.col("v")).alias("anchor"))


def own_anchors(s):
    """A figure of its own for each entity that has bulk returns."""
    return s.where("bulk is not null").select("entity", F.round(5000 + F.pmod(F.col("bulk"), F.lit(4000.0)), 2).alias("own_anchor"))


def region_figures(s):
    """Anchors of the even nations and the growth of each nation."""
    sums = s.groupBy("nation").agg(F.round(F.avg("balance"), 2).alias("b"), F.sum("balance").alias("base"), F.sum("spend").alias("latest"))
    growth = F.round(estimates.growth_pct(F.nullif("base", F.lit(0.0)), F.col("latest")), 4)
    return sums.select("nation", F.when(F.col("nation") % 2 == 0, F.col("b")).alias("region_anchor"), growth.alias("region_growth"))


@CATALOG.query(
    "ml14_anchored_money",
    f"""WITH {SIGNAL_SQL}, z0 AS (SELECT entity, fine, nation, bulk, (balance - avg(balance) OVER ()) / stddev_pop(balance) OVER () AS z FROM signals),
r AS (SELECT nation, round(avg(balance), 2) AS v FROM signals GROUP BY 1),
s AS (SELECT fine, count(*) AS n, avg(z) AS m, stddev_pop(z) AS d FROM z0 GROUP BY 1),
a AS (SELECT entity, CASE WHEN bulk IS NOT NULL THEN round(5000 + bulk % 4000, 2) WHEN nation % 2 = 0 THEN v ELSE 7000 END AS anchor,
  CASE WHEN n < 2 THEN z ELSE n / (n + 50) * ((z - m) / CASE WHEN d > 0 THEN d ELSE 1 END) + (1 - n / (n + 50)) * z END AS z_adj FROM z0 JOIN s USING (fine) JOIN r USING (nation)),
i AS (SELECT *, greatest(least(z_adj, 100 / 30.0::DOUBLE), -2) AS zc FROM a)
SELECT entity, anchor, CAST(round_even(greatest(least(100 + 30 * z_adj, 200), 40), 0) AS INTEGER) AS index_ml,
  round_even(anchor * 4.1::DOUBLE * exp(0.55 * zc) / greatest(least(0.82 - 0.10 * zc, 0.85), 0.45), -2) AS est_monthly_income_hh,
  round_even(anchor * 4.1::DOUBLE * exp(0.55 * zc), -2) AS est_monthly_spend_hh FROM i""",
)
def ml14_money(spark, sf):
    """The refit's money step: own anchors, then those of the region, then the default."""
    s = signal_table(spark, sf)
    rows = refit.with_anchors(s.select("entity", "fine", "nation", F.col("balance").alias("z")), "entity", own_anchors(s), region_figures(s))
    out = refit.money(model.credibility(stats.standardize(rows, ["z"]), "fine"))
    return out.select("entity", "anchor", "index_ml", "est_monthly_income_hh", "est_monthly_spend_hh")


def full_refit(s, before):
    """The refit of a written signal table, compared with the baseline composite of the same table."""
    return refit.run(
        s, "entity", SIGNALS, ("urgent", "bulk"), rate="balance", regional="bulk", min_size=10,
        own_anchors=own_anchors(s), regions=region_figures(s), covered_region=7,
        previous=before.select("entity", F.col("index").alias("index_ml")),
    )


@CATALOG.query("ml14_full_refit")
def ml14(spark, sf):
    """Signals to refitted scores, committed as a table version that keeps rows added meanwhile."""
    s = signal_table(spark, sf)
    return full_refit(s, baseline(s)).scores


@CATALOG.query("snk11_diagnostics")
def snk11(spark, sf):
    s = signal_table(spark, sf)
    return full_refit(s, baseline(s)).diagnostics


@CATALOG.query("ml5_smoothed_model_score")
def ml5_model(spark, sf):
    """The linear model's score smoothed over neighbours within 20 km."""
    z, _, _ = model.pca_ridge(with_target(spark, sf, matrix(spark, sf)), "entity", SIGNALS)
    points = roles.entities(spark, sf).select("entity", "lat", "lng").join(z, "entity")
    return spatial.smooth(points, "entity", "z_linear").withColumn("smoothed", F.round("smoothed", 6))


@CATALOG.query("sc5_refit_drift")
def sc5_refit(spark, sf):
    """Drift of the refitted index against the baseline composite."""
    s = signal_table(spark, sf)
    before = baseline(s)
    new = full_refit(s, before).scores.select("entity", F.col("index_ml").alias("index"))
    return score.drift(new, before.select("entity", "index"), "entity", "index")
