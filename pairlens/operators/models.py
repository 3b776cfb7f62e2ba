"""Probability models for a rare 0/1 outcome.

Every family is fitted on ``row_id, label, features[, weight]`` and returns a scorer, a
function from such a frame to the same rows with a probability ``p``.  The fits are
``pyspark.ml`` estimators, so the data stays distributed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, StandardScaler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import exact_quantiles
from ..functions.arrays import matrix
from ..session import materialize
from .adaboost import fit_stumps, stump_scorer
from .batch_logit import fit_logits, linear_probability, prepared
from .densities import fit_kernel_bayes
from .splines import hinge_columns, search_splines

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Family:
    """A model family: how to fit one setting, and the settings worth trying."""

    name: str
    fit: Callable[[DataFrame, Mapping, int], Scorer]
    grid: tuple[Mapping, ...] = field(default=({},))
    #: For logits: the penalty ``(alpha, lambda)`` of a setting, so that many can be fitted in one pass.
    penalty: Callable[[Mapping], tuple[float, float]] | None = None


def _weighted(estimator, train: DataFrame):
    return estimator.setWeightCol("weight") if "weight" in train.columns else estimator


def _probability(col: str = "probability") -> Column:
    return F.element_at(vector_to_array(F.col(col)), 2)


def _ml_scorer(model) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns]
        return model.transform(df).withColumn("p", _probability()).select(*keep, "p")

    return score


def _estimator_family(
    name: str, build: Callable[[Mapping, int], object], grid: Sequence[Mapping] = ({},), penalty: Callable[[Mapping], tuple[float, float]] | None = None
) -> Family:
    def fit(train: DataFrame, params: Mapping, seed: int) -> Scorer:
        return _ml_scorer(_weighted(build(params, seed), train).fit(train))

    return Family(name, fit, tuple(grid), penalty)


# --- base rate -------------------------------------------------------------------------


def _fit_null(train: DataFrame, params: Mapping, seed: int) -> Scorer:
    w = F.col("weight") if "weight" in train.columns else F.lit(1.0)
    rate = train.agg(F.sum(F.col("label") * w) / F.sum(w)).first()[0]
    return lambda df: df.withColumn("p", F.lit(float(rate)))


# --- preprocessing ---------------------------------------------------------------------


def preprocess(
    train: DataFrame, center: bool = True, scale: bool = True, pca_variance: float | None = 0.95
) -> Callable[[DataFrame], DataFrame]:
    """Centre, scale and rotate: keep the leading components up to a share of the variance.

    Fitted on ``train``, where a ``weight`` makes a row count as that many equal rows; the
    returned function transforms any frame.
    """
    train = _repeat_rows(train)
    scaler = StandardScaler(inputCol="features", outputCol="__scaled", withMean=center, withStd=scale).fit(train)
    if pca_variance is None:
        return lambda df: scaler.transform(df).drop("features").withColumnRenamed("__scaled", "features")
    size = len(scaler.mean)
    rotation = PCA(k=size, inputCol="__scaled", outputCol="__rotated").fit(scaler.transform(train))
    share = np.cumsum(rotation.explainedVariance.toArray())
    k = int(min(np.searchsorted(share, pca_variance - 1e-12) + 1, size))
    cut = VectorSlicer(inputCol="__rotated", outputCol="__cut", indices=list(range(k)))

    def apply(df: DataFrame) -> DataFrame:
        out = cut.transform(rotation.transform(scaler.transform(df)))
        return out.drop("features", "__scaled", "__rotated").withColumnRenamed("__cut", "features")

    return apply


def _on_transformed(change: Callable[[DataFrame], DataFrame], scorer: Scorer) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        raw = df.withColumn("__raw", F.col("features"))
        scored = scorer(change(raw))
        return scored.withColumn("features", F.col("__raw")).select(*df.columns, "p")

    return score


# --- splines ---------------------------------------------------------------------------


def feature_knots(train: DataFrame, n_knots: int) -> dict[int, list[float]]:
    """Inner quantile knots of every feature; a feature's equal knots are used once."""
    cells = _repeat_rows(train).select(F.posexplode(vector_to_array("features")).alias("feature", "value"))
    probs = {f"k{i}": i / (n_knots + 1) for i in range(1, n_knots + 1)}
    # One row per feature.
    rows = exact_quantiles(cells, "value", probs, ["feature"]).collect()
    return {r["feature"]: sorted({float(r[k]) for k in probs}) for r in rows}


def hinge_vector(knots: Mapping[int, Sequence[float]]) -> Callable[[DataFrame], DataFrame]:
    """Append max(0, x - k) and max(0, k - x) for every knot to the feature vector."""

    def apply(df: DataFrame) -> DataFrame:
        x = F.col("__x")
        new = []
        for j, ks in sorted(knots.items()):
            for k in ks:
                v = F.element_at(x, j + 1)
                new += [F.greatest(v - F.lit(k), F.lit(0.0)), F.greatest(F.lit(k) - v, F.lit(0.0))]
        wide = df.withColumn("__x", vector_to_array("features"))
        return wide.withColumn("features", array_to_vector(F.concat(x, F.array(*new)))).drop("__x")

    return apply


def _fit_splines(train: DataFrame, params: Mapping, seed: int) -> Scorer:
    widen = hinge_vector(feature_knots(train, params.get("n_knots", 3)))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=params.get("reg", 0.001), maxIter=100)
    wide = widen(train)
    return _on_transformed(widen, _ml_scorer(_weighted(lasso, train).fit(wide)))


# --- radial support vector machine ------------------------------------------------------


def fourier_cosines(size: int, n: int, gamma: float, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """Random cosines of the rows of a matrix; their inner products approximate exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(scale=np.sqrt(2 * gamma), size=(size, n))
    b = rng.uniform(0, 2 * np.pi, size=n)
    return lambda x: np.sqrt(2 / n) * np.cos(x @ w + b)


def fourier_features(size: int, n: int, gamma: float, seed: int) -> Callable[[DataFrame], DataFrame]:
    """Random cosine features whose inner product approximates exp(-gamma |x - y|^2)."""
    cosines = fourier_cosines(size, n, gamma, seed)

    def project(x: pa.Array) -> pa.Array:
        z = cosines(matrix(x)) if len(x) else np.empty((0, n))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, n), pa.int32()), pa.array(z.ravel()))

    project = F.arrow_udf(project, T.ArrayType(T.DoubleType()))
    return lambda df: df.withColumn("features", array_to_vector(project(vector_to_array("features"))))


def _fit_svm(train: DataFrame, params: Mapping, seed: int) -> Scorer:
    scale = preprocess(train, pca_variance=None)
    size = train.select(F.size(vector_to_array("features"))).first()[0]
    space = (size, params.get("n_features", 100), params.get("gamma", 1.0 / size), seed)
    base = F.col("weight") if "weight" in train.columns else F.lit(1.0)
    counts = {r[0]: r[1] for r in train.groupBy("label").agg(F.sum(base)).collect()}  # two classes
    heavy = params.get("positive_weight", counts.get(0.0, 1.0) / (counts.get(1.0) or 1.0))
    weighted = train.withColumn("__w", base * F.when(F.col("label") == 1, F.lit(float(heavy))).otherwise(1.0))
    svm = LinearSVC(weightCol="__w", regParam=params.get("reg", 0.01), maxIter=50).fit(fourier_features(*space)(scale(weighted)))
    cosines, normal, offset = fourier_cosines(*space), svm.coefficients.toArray(), svm.intercept

    def margin(x: pa.Array) -> pa.Array:
        return pa.array(cosines(matrix(x)) @ normal + offset if len(x) else np.empty(0))

    # The cosines of a row are used where they are made; only its margin leaves the task.
    margin = F.arrow_udf(margin, T.DoubleType())
    platt = LogisticRegression(featuresCol="__margin", maxIter=50)
    calibrated = _weighted(platt, train).fit(scale(train).withColumn("__margin", array_to_vector(F.array(margin(vector_to_array("features"))))))
    slope, start = float(calibrated.coefficients[0]), float(calibrated.intercept)
    return _on_transformed(scale, lambda df: df.withColumn("p", linear_probability(F.array(margin(vector_to_array("features"))), [slope], start)))


# --- neural networks ---------------------------------------------------------------------


def _repeat_rows(train: DataFrame) -> DataFrame:
    """Steps without a weight column get repeated rows instead; a fractional weight has no such rows and is refused."""
    if "weight" not in train.columns:
        return train
    whole = F.when(F.col("weight") == F.floor("weight"), F.col("weight").cast("int"))
    copies = F.coalesce(whole, F.raise_error(F.lit("weights must be whole numbers for this family")).cast("int"))
    return train.withColumn("__c", F.explode(F.array_repeat(F.lit(1), copies))).drop("__c", "weight")


def _fit_networks(train: DataFrame, params: Mapping, seed: int, count: int) -> Scorer:
    rotate = preprocess(train)
    ready = rotate(_repeat_rows(train))
    size = ready.select(F.size(vector_to_array("features"))).first()[0]
    layers = [size, int(params.get("hidden", 5)), 2]
    nets = [
        MultilayerPerceptronClassifier(layers=layers, maxIter=params.get("max_iter", 60), seed=seed + i, solver="l-bfgs").fit(ready)
        for i in range(count)
    ]

    def score(df: DataFrame) -> DataFrame:
        out, names = df, []
        for i, net in enumerate(nets):
            net = net.copy().setProbabilityCol(f"__pr{i}").setRawPredictionCol("").setPredictionCol("")
            out = net.transform(out)
            names.append(f"__pr{i}")
        mean = sum((_probability(n) for n in names[1:]), _probability(names[0])) / len(names)
        return out.withColumn("p", mean).drop(*names)

    return _on_transformed(rotate, score)


# --- splines with chosen knots, discrete boosting ------------------------------------------


def _fit_adaptive_splines(train: DataFrame, params: Mapping, seed: int) -> Scorer:
    """A logit on the hinges that a search by least squares chose."""
    found = search_splines(train, feature_knots(train, int(params.get("candidates", 15))), int(params.get("terms", 21)))
    if not found.hinges:
        return _fit_null(train, params, seed)
    rows = prepared(hinge_columns(train, found.hinges), weight="weight" if "weight" in train.columns else None)
    fits = fit_logits(materialize(rows, "hinges", rebalance=True), penalties=[(0.0, 1e-6)], max_scans=40)

    def score(df: DataFrame) -> DataFrame:
        wide = hinge_columns(df, found.hinges, "__hinges")
        return wide.withColumn("p", linear_probability("__hinges", fits.coef[0], fits.intercept[0])).drop("__hinges")

    return score


def _fit_discrete_boosting(train: DataFrame, params: Mapping, seed: int) -> Scorer:
    return stump_scorer(fit_stumps(train, feature_knots(train, int(params.get("candidates", 31))), int(params.get("rounds", 50))))


# --- registry ----------------------------------------------------------------------------

# The elastic-net grid (6 mixing values by 4 penalties).
ALPHAS = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
LAMBDAS = (0.00001, 0.0001, 0.001, 0.01)

NULL = Family("null", _fit_null)
LOGIT = _estimator_family("logit", lambda p, s: LogisticRegression(regParam=0.0, maxIter=100), penalty=lambda p: (0.0, 0.0))
BOOSTED_LOGIT = _estimator_family(
    "boosted_logit",
    lambda p, s: GBTClassifier(maxDepth=1, maxIter=p.get("rounds", 20), stepSize=0.3, seed=s),
    [{"rounds": r} for r in (10, 20, 30)],
)
ELASTIC_NET = _estimator_family(
    "elastic_net",
    lambda p, s: LogisticRegression(
        elasticNetParam=p.get("alpha", 0.5), regParam=p.get("lambda", 0.001), standardization=True, maxIter=100
    ),
    [{"alpha": a, "lambda": l} for a, l in product(ALPHAS, LAMBDAS)],
    lambda p: (p.get("alpha", 0.5), p.get("lambda", 0.001)),
)
NAIVE_BAYES = _estimator_family("naive_bayes", lambda p, s: NaiveBayes(modelType="gaussian"))
SPLINES = Family("splines", _fit_splines, tuple({"n_knots": k, "reg": r} for k in (2, 3) for r in (0.001, 0.01)))
TREE = _estimator_family(
    "tree",
    lambda p, s: DecisionTreeClassifier(maxDepth=p.get("depth", 3), minInstancesPerNode=p.get("min_rows", 5), seed=s),
    [{"depth": d} for d in (1, 2, 3, 4, 6)],
)
FOREST = _estimator_family(
    "forest",
    lambda p, s: RandomForestClassifier(
        numTrees=p.get("trees", 30), maxDepth=p.get("depth", 6), featureSubsetStrategy=str(p.get("features", "sqrt")), seed=s
    ),
    [{"features": f} for f in (0.2, 0.4, 0.6, 0.8, "sqrt")],
)
BOOSTED_TREES = _estimator_family(
    "boosted_trees",
    lambda p, s: GBTClassifier(maxDepth=p.get("depth", 3), maxIter=p.get("rounds", 15), stepSize=0.1, seed=s),
    [{"depth": d, "rounds": r} for d, r in ((2, 10), (2, 20), (3, 10), (3, 20), (4, 10))],
)
RADIAL_SVM = Family("radial_svm", _fit_svm, tuple({"reg": r} for r in (0.001, 0.01, 0.1, 0.3, 1.0)))
AVERAGED_NETS = Family(
    "averaged_nets", lambda t, p, s: _fit_networks(t, p, s, p.get("nets", 3)), tuple({"hidden": h} for h in (1, 3, 5, 7, 9))
)
PERCEPTRON = Family("perceptron", lambda t, p, s: _fit_networks(t, p, s, 1), tuple({"hidden": h} for h in (1, 3, 5, 7, 9)))
KERNEL_BAYES = Family("kernel_bayes", fit_kernel_bayes, tuple({"adjust": a} for a in (1.0, 2.0)))
ADAPTIVE_SPLINES = Family("adaptive_splines", _fit_adaptive_splines, tuple({"terms": t} for t in (5, 11, 21)))
DISCRETE_BOOSTING = Family("discrete_boosting", _fit_discrete_boosting, tuple({"rounds": r} for r in (10, 50)))

FAMILIES: dict[str, Family] = {
    f.name: f
    for f in (
        NULL,
        LOGIT,
        BOOSTED_LOGIT,
        ELASTIC_NET,
        NAIVE_BAYES,
        SPLINES,
        TREE,
        FOREST,
        BOOSTED_TREES,
        RADIAL_SVM,
        AVERAGED_NETS,
        PERCEPTRON,
        KERNEL_BAYES,
        ADAPTIVE_SPLINES,
        DISCRETE_BOOSTING,
    )
}


def fit_predict(
    train: DataFrame, new: DataFrame, family: Family | str, params: Mapping | None = None, seed: int = 555
) -> DataFrame:
    """Fit on ``train``, predict ``new``: ``row_id, label, model, p``."""
    fam = FAMILIES[family] if isinstance(family, str) else family
    scorer = fam.fit(train, params if params is not None else fam.grid[0], seed)
    return scorer(new).select("row_id", "label", F.lit(fam.name).alias("model"), "p")


def fit_many(
    train: DataFrame, new: DataFrame, families: Sequence[str], params: Mapping[str, Mapping] | None = None, seed: int = 555
) -> tuple[DataFrame, dict[str, float]]:
    """Predictions of several families as one long table, and the seconds each fit took."""
    out, seconds = None, {}
    for name in families:
        began = time.perf_counter()
        preds = fit_predict(train, new, name, (params or {}).get(name), seed)
        seconds[name] = time.perf_counter() - began
        out = preds if out is None else out.unionByName(preds)
    return out, seconds


def class_moments(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """Prior, mean and variance per class and feature: what Gaussian naive Bayes estimates."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.var_pop(c).alias(f"{c}_var")]
    # One row, so a scalar subquery.
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(label).agg(*aggs).withColumn("prior", F.col("n") / total)
