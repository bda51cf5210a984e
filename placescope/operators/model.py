"""Feature matrix, the three models, their blend, anomalies and credibility weighting."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.util import inheritable_thread_target

from placescope.operators import score, stats
from placescope.operators.quantile import exact_quantiles

ENSEMBLE_WEIGHTS = {"z_linear": 0.45, "z_trees": 0.35, "z_spatial": 0.20}
REGIONAL_WEIGHT = 0.3
CREDIBILITY_ROWS = 50
DEFAULT_ANCHOR = 7000.0


# ---- features ----------------------------------------------------------------------------------


def feature_matrix(
    df: DataFrame, signals: Sequence[str], lo: float = 0.02, hi: float = 0.98
) -> DataFrame:
    """Winsorised signals, missing ones filled with the median of the winsorised column."""
    return stats.impute_median(stats.winsorize(df, signals, lo, hi), signals)


def target(df: DataFrame, key: str, rate: str, fine: str, coarse: str, min_size: int = 5) -> DataFrame:
    """Median-filled rate, normalised in its group and standardised over all rows, as ``target``."""
    filled = stats.impute_median(df.select(key, fine, coarse, rate), [rate])
    z = stats.group_z(filled, [rate], fine, coarse, min_size)
    return stats.standardize(z.withColumnRenamed(rate, "target"), ["target"]).select(key, "target")


def anchor_target(df: DataFrame, key: str, anchor: str) -> DataFrame:
    """Fallback target where no rate signal exists: the standardised anchor."""
    filled = df.select(key, F.coalesce(anchor, F.lit(DEFAULT_ANCHOR)).alias("target"))
    return stats.standardize(filled, ["target"])


def region_feature(df: DataFrame, region: str, figures: DataFrame, value: str) -> DataFrame:
    """Append a region-level figure to every row of the region."""
    return df.join(figures.select(region, value), region, "left")


def _vector(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


# ---- linear model ------------------------------------------------------------------------------


def fit_ridge(df: DataFrame, features: str, label: str, alpha: float):
    """Ridge minimising SSE + alpha |w|^2 with a free intercept.

    The library divides the loss by n and scales the penalty by the label deviation, so alpha / n
    is exact for a label of unit deviation, which the standardised target has.
    """
    n = df.count()
    return LinearRegression(
        featuresCol=features, labelCol=label, regParam=alpha / n, elasticNetParam=0.0,
        standardization=False, solver="normal",
    ).fit(df)


def pca_ridge(
    df: DataFrame, key: str, features: Sequence[str], label: str = "target", components: int = 5, alpha: float = 1.0
) -> tuple[DataFrame, dict[str, float], list[float]]:
    """Components of the standardised features, then ridge on them.

    Returns predictions (key, z_linear), normalised importances |loading x coefficient| and the
    explained variance ratios.
    """
    vectors = _vector(df.select(key, label, *features), features)
    k = min(components, len(features))
    pca = PCA(k=k, inputCol="features", outputCol="pc").fit(vectors)
    projected = pca.transform(vectors)
    model = fit_ridge(projected, "pc", label, alpha)
    loadings = np.array(pca.pc.toArray())
    weight = np.abs(loadings * model.coefficients.toArray()[None, :]).sum(axis=1)
    importances = {f: float(w) for f, w in zip(features, weight / weight.sum())}
    z = model.transform(projected).select(key, F.col("prediction").alias("z_linear"))
    return z, importances, [float(v) for v in pca.explainedVariance]


def ridge_loo_rmse(df: DataFrame, features: Sequence[str], label: str = "target", alpha: float = 1.0) -> float:
    """Leave-one-out RMSE of ridge in one pass over the rows, by the leverage of each row.

    Only the d x d moment matrix reaches the driver.
    """
    d = len(features)
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(features)]
    cross = [
        F.sum(F.col(features[i]) * F.col(features[j])).alias(f"c{i}_{j}") for i in range(d) for j in range(i, d)
    ]
    with_y = [F.sum(F.col(f) * F.col(label)).alias(f"y{i}") for i, f in enumerate(features)]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("y"), *sums, *cross, *with_y).first()
    n, ybar = row["n"], row["y"] / row["n"]
    mean = np.array([row[f"s{i}"] for i in range(d)]) / n
    gram = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
    gram = gram - n * np.outer(mean, mean)
    xy = np.array([row[f"y{i}"] for i in range(d)]) - n * mean * ybar
    inverse = np.linalg.inv(gram + alpha * np.eye(d))
    coef = inverse @ xy
    centred = [F.col(f) - float(m) for f, m in zip(features, mean)]
    leverage = F.lit(1.0 / n)
    for i in range(d):
        for j in range(d):
            leverage = leverage + centred[i] * centred[j] * float(inverse[i][j])
    fitted = F.lit(float(ybar))
    for c, w in zip(centred, coef):
        fitted = fitted + c * float(w)
    error = (F.col(label) - fitted) / (1 - leverage)
    return math.sqrt(df.agg(F.avg(error * error)).first()[0])


# ---- tree model --------------------------------------------------------------------------------


def _trees(iterations: int) -> GBTRegressor:
    return GBTRegressor(
        featuresCol="features", labelCol="target", maxIter=iterations, maxDepth=3, stepSize=0.05,
        minInstancesPerNode=2, seed=42,
    )


def boosted_trees(df: DataFrame, key: str, features: Sequence[str], iterations: int = 200):
    """Boosted regression trees on the target: predictions (key, z_trees) and the fitted model."""
    vectors = _vector(df.select(key, "target", *features), features)
    model = _trees(iterations).fit(vectors)
    return model.transform(vectors).select(key, F.col("prediction").alias("z_trees")), model


def cross_validated_rmse(df: DataFrame, key: str, features: Sequence[str], folds: int = 5, iterations: int = 200) -> float:
    """RMSE over held-out folds; every row is held out once, folds follow a hash of the key.

    The fits run side by side: each is a long row of short jobs that leave most cores waiting.
    """
    vectors = _vector(df.select(key, "target", *features), features).withColumn(
        "_fold", F.pmod(F.xxhash64(key, F.lit(42)), F.lit(folds))
    )

    def held_out(i: int) -> DataFrame:
        model = _trees(iterations).fit(vectors.where(F.col("_fold") != i))
        held = model.transform(vectors.where(F.col("_fold") == i))
        return held.select(((F.col("target") - F.col("prediction")) ** 2).alias("e"))

    with ThreadPool(folds) as pool:
        parts = pool.map(inheritable_thread_target(df.sparkSession)(held_out), range(folds), chunksize=1)
    errors = parts[0]
    for p in parts[1:]:
        errors = errors.unionByName(p)
    return math.sqrt(errors.agg(F.avg("e")).first()[0])


def permutation_importance(
    model, df: DataFrame, key: str, features: Sequence[str], rows_per_bucket: int = 20_000
) -> DataFrame:
    """Rise of the squared error when one feature comes from a random other row, normalised to 1.

    All rows stand in the order of a hash of their key and each takes the features of the next one,
    the last those of the first: a random permutation of the whole table. Stretches of that order
    are dealt to tasks with the first row of the next stretch, so their number changes nothing.
    All features are scored in one pass; falls count as 0.
    """
    n = df.count()
    stretches = max(1, n // rows_per_bucket)
    rows = df.select(key, "target", F.array(*features).alias("_x"), F.xxhash64(key, F.lit(1)).alias("_h"))
    width = F.lit(float(2**64) / stretches)
    rows = rows.withColumn("_b", F.least(F.floor((F.col("_h").cast("double") + 2.0**63) / width), F.lit(stretches - 1)))
    order = W.partitionBy("_b").orderBy("_h", key)
    firsts = rows.groupBy("_b").agg(F.min_by("_x", F.struct("_h", key)).alias("_f"))
    # One row per stretch: the first features of the next stretch that has rows, wrapping around.
    following = W.orderBy("_b")
    heads = firsts.select(
        "_b", F.coalesce(F.lead("_f").over(following), F.first("_f").over(following.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_f")
    )
    paired = rows.withColumn("_next", F.lead("_x").over(order)).join(heads, "_b").withColumn("_d", F.coalesce("_next", "_f"))
    swapped = [F.struct(F.lit("").alias("feature"), F.col("_x").alias("x"))]
    for i, f in enumerate(features):
        mixed = F.array(*[F.col("_d")[j] if j == i else F.col("_x")[j] for j in range(len(features))])
        swapped.append(F.struct(F.lit(f).alias("feature"), mixed.alias("x")))
    cases = paired.select("target", F.explode(F.array(*swapped)).alias("_c")).select(
        "target", "_c.feature", *[F.col("_c.x")[i].alias(f) for i, f in enumerate(features)]
    )
    scored = model.transform(_vector(cases, features))
    errors = scored.groupBy("feature").agg(F.avg((F.col("target") - F.col("prediction")) ** 2).alias("e"))
    base = errors.where("feature = ''").select("e").scalar()
    rise = errors.where("feature <> ''").withColumn("rise", F.greatest(F.lit(0.0), F.col("e") - base))
    total = rise.agg(F.sum("rise")).scalar()
    return rise.select(
        "feature", F.bround(F.col("rise") / F.when(total > 0, total).otherwise(1.0), 4).alias("importance")
    )


# ---- blend -------------------------------------------------------------------------------------


def ensemble(df: DataFrame, weights: Mapping[str, float] = ENSEMBLE_WEIGHTS, out: str = "z") -> DataFrame:
    """Weighted sum of model scores, standardised again."""
    mixed = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return stats.standardize(df.withColumn(out, mixed), [out])


def regional_blend(df: DataFrame, regional: DataFrame, key: str, value: str, z: str = "z") -> DataFrame:
    """Mix the z of a sparse regional signal into the rows it covers, if it covers two or more."""
    rows = regional.where(F.col(value).isNotNull()).join(df.select(key), key, "left_semi")
    figures = rows.agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("s"))
    )
    one = F.col("_one")
    spread = F.when(one["s"] > 0, one["s"]).otherwise(1.0)
    joined = stats.with_figures(df.join(rows.select(key, F.col(value).alias("_v")), key, "left"), figures)
    mixed = (1 - REGIONAL_WEIGHT) * F.col(z) + REGIONAL_WEIGHT * (F.col("_v") - one["m"]) / spread
    use = F.col("_v").isNotNull() & (one["n"] >= 2)
    return joined.withColumn(z, F.when(use, mixed).otherwise(F.col(z))).drop("_v", "_one")


def credibility(df: DataFrame, group: str, z: str = "z", out: str = "z_adj") -> DataFrame:
    """Pull the group z toward the global one: weight n / (n + 50) on the group; lone rows keep z."""
    figures = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(z).alias("_m"), F.stddev_pop(z).alias("_s")
    )
    alpha = F.col("_n") / (F.col("_n") + CREDIBILITY_ROWS)
    in_group = (F.col(z) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    mixed = F.when(F.col("_n") < 2, F.col(z)).otherwise(alpha * in_group + (1 - alpha) * F.col(z))
    return df.join(figures, group).withColumn(out, mixed).drop("_n", "_m", "_s")


def anchor(own: Column, by_region: Column) -> Column:
    """Own anchor, else the region's, else the default; a zero counts as missing."""
    return F.coalesce(F.nullif(own, F.lit(0.0)), by_region, F.lit(DEFAULT_ANCHOR))


def index_and_money(df: DataFrame, z: str = "z_adj", anchor_column: str = "anchor") -> DataFrame:
    """Index from z, and money that saturates where the index does."""
    capped = stats.clip(F.col(z), F.lit(-2.0), F.lit(100 / 30))
    spend = F.col(anchor_column) * F.lit(score.HOUSEHOLD_SIZE) * score.lift(capped)
    return df.withColumns(
        {
            "index_ml": score.index_of(F.col(z)),
            "est_monthly_income_hh": F.bround(spend / score.spend_share(capped), -2),
            "est_monthly_spend_hh": F.bround(spend, -2),
        }
    )


# ---- anomalies ---------------------------------------------------------------------------------


def top_deviant(long: DataFrame, key: str, group: str, features: Sequence[str]) -> DataFrame:
    """The feature farthest from its group mean per row, earlier features first on ties."""
    means = long.groupBy(group, "signal").agg(F.avg("value").alias("_m"))
    order = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("signal"))
    gap = F.abs(F.col("value") - F.col("_m"))
    best = F.max(F.struct(gap.alias("gap"), (-order).alias("o"), F.col("signal")))
    return (
        long.join(means, [group, "signal"])
        .groupBy(key)
        .agg(best.alias("_b"))
        .select(key, F.col("_b.signal").alias("top_feature"), F.col("_b.gap").alias("deviation"))
    )


def _path_normaliser(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


_NODE_SCHEMA = "tree int, node int, feature int, cut double, depth double"


def _grow(sample_rows: int):
    """Random splits of a row sample, as nodes of a binary heap; leaves carry their path length."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(tree)
        pdf = pdf.sort_values("order")
        x = np.array(pdf["x"].tolist())
        x = x[rng.choice(len(x), min(sample_rows, len(x)), replace=False)]
        limit = math.ceil(math.log2(max(len(x), 2)))
        out, todo = [], [(0, x, 0)]
        while todo:
            node, part, depth = todo.pop()
            lo, hi = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(hi > lo)
            if depth >= limit or len(part) <= 1 or len(usable) == 0:
                out.append((tree, node, -1, 0.0, depth + _path_normaliser(len(part))))
                continue
            f = int(rng.choice(usable))
            cut = float(rng.uniform(lo[f], hi[f]))
            if cut >= hi[f]:  # neighbouring floats: rounding may reach the upper end
                cut = float(lo[f])
            left = part[:, f] <= cut
            out.append((tree, node, f, cut, float(depth)))
            todo += [(2 * node + 1, part[left], depth + 1), (2 * node + 2, part[~left], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "depth"])

    return grow


def isolation_scores(
    df: DataFrame, key: str, features: Sequence[str], trees: int = 100, sample_rows: int = 256, contamination: float = 0.1
) -> DataFrame:
    """Isolation-forest score per row and a flag for the top share.

    Each tree draws its own ``sample_rows`` rows from the whole table: those whose hash of key and
    tree is smallest. Rows far from any tree's limit drop out before the shuffle, which so moves about
    eight times the samples. The collected nodes depend on the parameters only. All rows are scored.
    """
    x = F.array(*[F.col(f).cast("double") for f in features])
    seen = df.count()
    limit = min(2**63 - 1, int(8 * sample_rows / max(seen, 1) * 2.0**63))
    draw = lambda t: F.xxhash64(key, t).bitwiseAND(F.lit(2**63 - 1))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) <= limit)
    dealt = df.select(key, x.alias("x"), F.explode(drawn).alias("tree")).select("x", "tree", draw(F.col("tree")).alias("order"))
    place = F.row_number().over(W.partitionBy("tree").orderBy("order"))
    dealt = dealt.withColumn("_place", place).where(F.col("_place") <= sample_rows).drop("_place")
    nodes = dealt.groupBy("tree").applyInPandas(_grow(sample_rows), _NODE_SCHEMA).collect()
    size = max((r["node"] for r in nodes), default=0) + 1
    feature = np.full((trees, size), -1, dtype=np.int32)
    cut, depth = np.zeros((trees, size)), np.zeros((trees, size))
    for r in nodes:
        feature[r["tree"], r["node"]] = r["feature"]
        cut[r["tree"], r["node"]], depth[r["tree"], r["node"]] = r["cut"], r["depth"]
    norm = _path_normaliser(min(sample_rows, seen)) or 1.0
    forest = df.sparkSession.sparkContext.broadcast((feature, cut, depth))

    @F.pandas_udf("double")
    def scores(vectors: pd.Series) -> pd.Series:
        feature, cut, depth = forest.value
        data = np.array(vectors.tolist())
        if len(data) == 0:
            return pd.Series([], dtype="float64")
        total = np.zeros(len(data))
        rows = np.arange(len(data))
        for t in range(feature.shape[0]):
            at = np.zeros(len(data), dtype=np.int64)
            while True:
                f = feature[t, at]
                inner = f >= 0
                if not inner.any():
                    break
                right = data[rows, np.maximum(f, 0)] > cut[t, at]
                at = np.where(inner, 2 * at + 1 + right, at)
            total += depth[t, at]
        return pd.Series(np.exp2(-total / feature.shape[0] / norm))

    return flag_top(df.select(key, scores(x).alias("anomaly_score")), contamination)


def flag_top(scored: DataFrame, contamination: float) -> DataFrame:
    """Flag rows above the (1 - contamination) quantile of the score."""
    limit = exact_quantiles(scored, [], "anomaly_score", {"q": 1 - contamination}).scalar()
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > limit)

