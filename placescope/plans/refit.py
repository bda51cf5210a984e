"""The full refit job: features, target, three models, blend, anomalies, money, gates, commit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from placescope.operators import model, score, spatial, stats, tables
from placescope.session import fresh_path, materialize
from placescope.sources import store


@dataclass
class Refit:
    scores: DataFrame
    diagnostics: DataFrame


def features(
    df: DataFrame, key: str, signals: Sequence[str], in_groups: Sequence[str], min_size: int = 5
) -> DataFrame:
    """Winsorised, imputed, partly group-normalised and standardised signals with their groups.

    The imputed matrix is written once, since the group figures read it several times.
    """
    rows = df.select(key, "fine", "coarse", *signals)
    filled = materialize(model.feature_matrix(rows, signals), "filled")
    grouped = stats.group_z(filled, in_groups, "fine", "coarse", min_size).drop("effective")
    return stats.standardize(grouped, signals)


def gate_pairs(df: DataFrame, key: str, by: str, group: str) -> DataFrame:
    """Per group the row with the highest and the lowest figure as an ordering gate."""
    ordered = F.struct(by, key)
    return df.where(F.col(by).isNotNull()).groupBy(F.col(group).alias("gate")).agg(
        F.max_by(key, ordered).alias("hi"), F.min_by(key, ordered).alias("lo")
    )


def with_anchors(df: DataFrame, key: str, own: DataFrame | None = None, regions: DataFrame | None = None) -> DataFrame:
    """Rows with ``own_anchor`` by key and ``region_anchor`` and ``region_growth`` by nation, null where none is given.

    ``own``: key and own_anchor, one row per key. ``regions``: nation and any of the two region figures,
    one row per nation.
    """
    for figures, on, names in ((own, key, ("own_anchor",)), (regions, "nation", ("region_anchor", "region_growth"))):
        have = [n for n in names if figures is not None and n in figures.columns]
        df = df.join(figures.select(on, *[F.col(n).cast("double").alias(n) for n in have]), on, "left") if have else df
        df = df.withColumns({n: F.lit(None).cast("double") for n in names if n not in have}) if len(have) < len(names) else df
    return df


def money(df: DataFrame) -> DataFrame:
    """Index and money of rows with z_adj and the columns of ``with_anchors``: the own anchor first, then the region's."""
    return model.index_and_money(df.withColumn("anchor", model.anchor(F.col("own_anchor"), F.col("region_anchor"))))


def drift_figures(moved: DataFrame) -> DataFrame:
    """Rows compared, rows beyond the limit and the greatest move, as (figure, value)."""
    one = moved.agg(F.count(F.lit(1)).alias("drift_rows"), F.count_if(F.col("status") == "WARN").alias("drift_over_limit"), F.max("delta").alias("drift_max"))
    names = ("drift_rows", "drift_over_limit", "drift_max")
    pairs = F.array(*[F.struct(F.lit(n).alias("figure"), F.col(n).cast("double").alias("value")) for n in names])
    return one.select(F.explode(pairs).alias("_p")).select("_p.figure", "_p.value")


def run(
    signals_table: DataFrame,
    key: str,
    signals: Sequence[str],
    in_groups: Sequence[str],
    rate: str,
    regional: str,
    min_size: int = 5,
    tree_iterations: int = 200,
    forest_trees: int = 100,
    table: str | None = None,
    own_anchors: DataFrame | None = None,
    regions: DataFrame | None = None,
    covered_region: int | None = None,
    previous: DataFrame | None = None,
) -> Refit:
    """Refit all scores.

    ``signals_table``: key, name, lat, lng, fine, coarse, nation and the signals. ``own_anchors`` and
    ``regions`` are as for ``with_anchors``; a region growth becomes one more feature. The sparse signal
    ``regional`` is blended into the rows of nation ``covered_region``, or wherever it is present.
    ``previous`` (key, index_ml) is what the drift gate compares with; without it the stored table is.
    Each layer is written once to the shared folder: later layers read a table instead of replaying the
    plan, and a lost executor costs one layer at most.
    """
    spark = signals_table.sparkSession
    rows = signals_table.select(key, "name", "lat", "lng", "fine", "coarse", "nation", *signals)
    base = materialize(with_anchors(rows, key, own_anchors, regions), "signals")
    if rate in signals:
        goal = model.target(base, key, rate, "fine", "coarse", min_size)
    else:
        anchored = base.withColumn("anchor", F.nullif(model.anchor(F.col("own_anchor"), F.col("region_anchor")), F.lit(0.0)))
        goal = model.anchor_target(anchored, key, "anchor")
    if regions is not None and "region_growth" in regions.columns:
        signals = [*signals, "region_growth"]
    matrix = materialize(features(base, key, signals, in_groups, min_size).join(goal, key), "matrix")

    z_linear, linear_importance, explained = model.pca_ridge(matrix, key, signals)
    z_trees, trees = model.boosted_trees(matrix, key, signals, tree_iterations)
    points = base.select(key, "name", "lat", "lng", "fine", "nation", "own_anchor", "region_anchor")
    models = materialize(points.join(z_linear, key).join(z_trees, key), "models")
    z_spatial = spatial.smooth(models, key, "z_linear").withColumnRenamed("smoothed", "z_spatial")
    # Written before its figures are taken: they would each sum over all pairs of places again.
    blended = model.ensemble(materialize(models.join(z_spatial, key), "smoothed"))
    covered = base.where(F.lit(True) if covered_region is None else F.col("nation") == covered_region).select(key, F.col(regional).alias("_income"))
    blended = materialize(model.regional_blend(blended, covered, key, "_income"), "blend")

    anomalies = model.isolation_scores(matrix, key, signals, trees=forest_trees)
    deviant = model.top_deviant(
        stats.to_long(matrix, key, signals, keep=("fine",)), key, "fine", signals
    )
    anomalies = materialize(anomalies.join(deviant, key), "anomalies")

    scores = money(model.credibility(blended, "fine")).select(
        key, "name", "lat", "lng", "index_ml", "est_monthly_income_hh", "est_monthly_spend_hh"
    )
    folder = table or fresh_path(spark, "scores")
    stored = store.read_current(spark, folder)
    result = scores if stored is None else tables.preserve_added(scores, stored, key)
    committed = store.commit(result, folder)

    gates = score.ordering_gates(gate_pairs(base, key, rate, "nation"), committed, key, "index_ml")
    figures = [(f"explained_{i + 1}", v) for i, v in enumerate(explained)]
    figures += [("ridge_loo_rmse", model.ridge_loo_rmse(matrix, signals))]
    figures += [(f"linear_{f}", w) for f, w in linear_importance.items()]
    figure_rows = spark.createDataFrame(figures, "figure string, value double").unionByName(
        spatial.morans_i(blended, "z").select(F.lit("morans_i").alias("figure"), F.col("morans_i").alias("value"))
    )
    moved = None
    if previous is not None or stored is not None:
        moved = score.drift(committed, previous if previous is not None else stored, key, "index_ml")
        figure_rows = figure_rows.unionByName(drift_figures(moved))
    importances = model.permutation_importance(trees, matrix, key, signals)
    diagnostics = tables.diagnostics(importances, figure_rows, gates, anomalies, moved=moved)
    return Refit(committed, diagnostics)
