"""Classifiers, scoring, cross-validated search and feature importance with MLlib."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions.fixed import FOLDS, SEED
from riskframe.operators.boosting import Boosted, Settings, Table, binned, grow
from riskframe.operators.evaluate import class_balance, ranking_metrics
from riskframe.operators.encode import with_class_weight
from riskframe.operators.joins import zip_arrays

# --- fixed values: model settings -----------------------------------------------------
BASELINE_BOOSTING = {"n_estimators": 200, "learning_rate": 0.1, "max_depth": 5, "subsample": 0.8, "colsample_bytree": 0.8}
LEAFWISE_BOOSTING = {
    "n_estimators": 850, "learning_rate": 0.04030011759052641, "num_leaves": 57, "max_depth": 11, "min_child_samples": 100,
    "subsample": 0.65, "colsample_bytree": 0.75, "reg_alpha": 0.0015859761672988419, "reg_lambda": 0.012904080278929704,
}
FOREST = {"n_estimators": 200, "max_depth": 10, "min_samples_leaf": 5}
L1_LOGISTIC = {"C": 0.1, "max_iter": 1000, "tolerance": 1e-4}

# --- fixed values: search spaces ------------------------------------------------------
RANDOM_SEARCH_DRAWS = 60
RANDOM_SEARCH_SPACE = {
    "n_estimators": [100, 200, 300, 400, 500, 600],
    "learning_rate": [0.01, 0.02, 0.05, 0.1],
    "max_depth": [4, 5, 6, 7, 8, 9, 10],
    "min_child_weight": [1, 3, 5, 7, 9],
    "gamma": [0.0, 0.1, 0.2, 0.3, 0.4, 0.5],
    "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "colsample_bytree": [0.6, 0.7, 0.8, 0.9, 1.0],
    "reg_alpha": [0, 0.001, 0.005, 0.01, 0.05, 0.1],
    "reg_lambda": [0.1, 0.5, 1, 1.5, 2, 3, 5],
}
GUIDED_SEARCH_DRAWS = 50
GUIDED_SEARCH_RANGES = {
    "n_estimators": ("int", 100, 1000, 50),
    "learning_rate": ("log", 0.005, 0.1),
    "num_leaves": ("int", 20, 150, 1),
    "max_depth": ("int", 3, 12, 1),
    "min_child_samples": ("int", 5, 100, 1),
    "subsample": ("step", 0.6, 1.0, 0.05),
    "colsample_bytree": ("step", 0.5, 1.0, 0.05),
    "reg_alpha": ("log", 1e-8, 1.0),
    "reg_lambda": ("log", 1e-8, 1.0),
}

#: Binned bytes of a partition of MLlib's trees.
TASK_BYTES = 128 << 20

#: Parameters with a counterpart in GBTClassifier. MLlib has no leaf limit and no L1/L2 term for trees, and a least
#: gain per row, not of a node; the searches therefore fit the boosters of `operators/boosting.py`, which have all of them.
_BOOSTING_PARAMS = {
    "n_estimators": "maxIter", "learning_rate": "stepSize", "max_depth": "maxDepth",
    "min_child_weight": "minInstancesPerNode", "min_child_samples": "minInstancesPerNode", "gamma": "minInfoGain", "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy",
}


def weighted(df: DataFrame, label: str, scheme: str = "positive", name: str = "weight") -> DataFrame:
    """Add a row weight: ``positive`` weighs positives by negatives/positives, ``balanced``
    weighs both classes by n / (2 n_class)."""
    row = class_balance(df, label).first()
    if scheme == "balanced":
        weights = {0: row["balanced_weight_0"], 1: row["balanced_weight_1"]}
    else:
        weights = {0: 1.0, 1: row["positive_weight"]}
    return with_class_weight(df, label, weights, name)


def _boosting_values(params: Mapping[str, object]) -> dict[str, object]:
    values = {_BOOSTING_PARAMS[k]: v for k, v in params.items() if k in _BOOSTING_PARAMS}
    if "featureSubsetStrategy" in values:
        share = float(values["featureSubsetStrategy"])
        values["featureSubsetStrategy"] = "all" if share >= 1 else str(share)
    return values


def boosting(
    params: Mapping[str, object] = BASELINE_BOOSTING, label: str = "label", weight: str | None = "weight",
    validation: str | None = None, tolerance: float = 0.01, seed: int = SEED,
) -> GBTClassifier:
    """Boosted trees. ``validation`` names a boolean column: training then stops early, once the
    loss on those rows no longer improves by ``tolerance``."""
    model = GBTClassifier(labelCol=label, seed=seed, validationTol=tolerance, **_boosting_values(params))
    if weight:
        model = model.setWeightCol(weight)
    if validation:
        model = model.setValidationIndicatorCol(validation)
    return model


def bounded(df: DataFrame, features: str = "features", task_bytes: int | None = None) -> DataFrame:
    """Training rows for MLlib's trees in partitions of at most about ``task_bytes`` (TASK_BYTES). They hold one
    integer per feature and row, whatever the vector's zeros, and read a partition as a whole; a scan of sparse
    vectors in files would put millions of rows into one. Rows that come in enough partitions stay as they are."""
    first = df.select(features).filter(F.col(features).isNotNull()).first()
    if first is None:
        return df
    parts = -(-df.count() * 4 * len(first[0]) // (task_bytes or TASK_BYTES))
    return df.repartition(parts) if parts > df.rdd.getNumPartitions() else df


def forest(params: Mapping[str, object] = FOREST, label: str = "label", weight: str = "weight", seed: int = SEED) -> RandomForestClassifier:
    return RandomForestClassifier(
        labelCol=label, weightCol=weight, seed=seed, numTrees=params["n_estimators"],
        maxDepth=params["max_depth"], minInstancesPerNode=params["min_samples_leaf"],
    )


def l1_logistic(total_weight: float, params: Mapping[str, object] = L1_LOGISTIC, label: str = "label", weight: str = "weight") -> LogisticRegression:
    """L1-penalised logistic regression; the inverse strength C becomes MLlib's per-weight
    penalty 1 / (C x total weight)."""
    return LogisticRegression(
        labelCol=label, weightCol=weight, elasticNetParam=1.0, standardization=False,
        regParam=1.0 / (params["C"] * total_weight), maxIter=params["max_iter"],
        tol=params["tolerance"],
    )


def score(model: Model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows (keep..., score, prediction): probability of class 1 and the predicted class."""
    return model.transform(df).select(
        *keep, vector_to_array("probability")[1].alias("score"), F.col("prediction").cast("int").alias("prediction")
    )


class AveragePrecision(Evaluator):
    """Average precision of the probability column, as the exact step sum."""

    @keyword_only
    def __init__(self, *, label: str = "label", probability: str = "probability"):
        super().__init__()
        self.label, self.probability = label, probability

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.select(self.label, vector_to_array(self.probability)[1].alias("score"))
        return float(ranking_metrics(scored, self.label, "score").first()["average_precision"])

    def isLargerBetter(self) -> bool:
        return True


def random_draws(space: Mapping[str, Sequence], n: int, seed: int = SEED) -> list[dict]:
    """n different draws from a grid of listed values (all of them if there are fewer)."""
    rng, seen, draws = random.Random(seed), set(), []
    size = math.prod(len(v) for v in space.values())
    while len(draws) < min(n, size):
        draw = {k: rng.choice(list(v)) for k, v in space.items()}
        if tuple(draw.values()) not in seen:
            seen.add(tuple(draw.values()))
            draws.append(draw)
    return draws


def range_draws(ranges: Mapping[str, tuple], n: int, seed: int = SEED) -> list[dict]:
    """n seeded draws from ranges: ``int`` and ``step`` on a lattice, ``log`` log-uniform."""
    rng = random.Random(seed)

    def one(kind: str, low: float, high: float, step: float = 0.0):
        if kind == "log":
            return math.exp(rng.uniform(math.log(low), math.log(high)))
        value = low + step * rng.randint(0, round((high - low) / step))
        return int(value) if kind == "int" else round(value, 10)

    return [{k: one(*spec) for k, spec in ranges.items()} for _ in range(n)]


def _settings(estimator: GBTClassifier, draw: Mapping[str, object], seed: int) -> Settings:
    """All parameters of a draw; those it does not name are the estimator's. Leaf-wise trees have the least
    hessian of a child that their published booster has."""
    share = estimator.getFeatureSubsetStrategy()
    base = {
        "n_estimators": estimator.getMaxIter(), "learning_rate": estimator.getStepSize(), "max_depth": estimator.getMaxDepth(),
        "min_child_samples": estimator.getMinInstancesPerNode(), "subsample": estimator.getSubsamplingRate(),
        "colsample_bytree": 1.0 if share in ("all", "auto") else float(share),
    }
    return Settings.of({**base, **({"min_child_weight": 1e-3} if draw.get("num_leaves") else {}), **draw}, seed=seed)


@dataclass
class Searched:
    """Mean and deviation of each draw's scores over the folds, and the best draw fitted on all rows."""

    avgMetrics: list[float]
    stdMetrics: list[float]
    bestModel: Boosted


def _fold_scores(table: Table, settings: Sequence[Settings], train: DataFrame, label: str, fold: str, at_a_time: int) -> list[float]:
    """Average precision of each model on the fold it has not seen. A task that holds all rows finds it itself; in
    rounds few models are grown at a time, as each adds to the work of every task."""
    if table.packed is not None:
        return [m.exact or 0.0 for m in grow(table, settings)]
    out = []
    for at in range(0, len(settings), at_a_time):
        for model in grow(table, settings[at:at + at_a_time]):
            scored = model.score(train.filter(F.col(fold) == model.settings.fold), [label])
            out.append(float(ranking_metrics(scored, label, "score").first()["average_precision"] or 0.0))
    return out


def search(
    train: DataFrame, draws: Sequence[Mapping[str, object]], estimator: GBTClassifier,
    fold: str = "fold", folds: int = FOLDS, label: str = "label", parallelism: int = 4,
    keys: Sequence[str] | None = None,
) -> Searched:
    """Cross-validate every draw on the given folds, score by average precision, refit the best on all rows.
    Each draw is fitted with all its parameters; ``estimator`` gives the others, the weight column and the seed.
    Rows are binned once for all fits and told apart for sampling by ``keys`` (else by all other columns). Of a table that
    is too large for one task ``parallelism`` draws are fitted side by side.
    Write the training rows to a table first: binning reads them several times."""
    weight = estimator.getWeightCol() if estimator.isDefined("weightCol") else None
    features, seed = estimator.getFeaturesCol(), estimator.getSeed()
    keys = list(keys or [c for c in train.columns if c not in (label, weight, features, fold)])
    each = [_settings(estimator, draw, seed) for draw in draws]
    table = binned(train, keys, label, weight, features, fold)
    try:
        held_out = [replace(s, fold=i) for s in each for i in range(folds)]
        scores = np.array(_fold_scores(table, held_out, train, label, fold, parallelism * folds)).reshape(len(each), folds)
        means = scores.mean(axis=1)
        best = grow(table, [each[int(means.argmax())]])[0]
    finally:
        table.drop()
    return Searched(means.tolist(), scores.std(axis=1).tolist(), best)


def search_table(spark: SparkSession, draws: Sequence[Mapping[str, object]], fitted: Searched) -> DataFrame:
    """One row per draw: its parameters as text and the mean and deviation over the folds."""
    rows = [(i, str(dict(d)), float(m), float(s)) for i, (d, m, s) in enumerate(zip(draws, fitted.avgMetrics, fitted.stdMetrics))]
    return spark.createDataFrame(rows, "draw int, params string, mean_score double, std_score double")


def fold_scores(train: DataFrame, estimator: Estimator, keep: Sequence[str], fold: str = "fold", folds: int = FOLDS) -> DataFrame:
    """Out-of-fold scores: each row is scored by a model that has not seen its fold."""
    parts = []
    for i in range(folds):
        model = estimator.fit(train.filter(F.col(fold) != i))
        parts.append(score(model, train.filter(F.col(fold) == i), [*keep, fold]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _named(spark: SparkSession, names: Sequence[str], values: Sequence[float], value_name: str) -> DataFrame:
    row = spark.createDataFrame([(list(names), [float(v) for v in values])], "names array<string>, vals array<double>")
    return zip_arrays(row, "names", "vals", value_name)


def importances(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    """Rows (position, name, importance)."""
    return _named(spark, names, model.featureImportances.toArray(), "importance")


def coefficients(spark: SparkSession, model: Model, names: Sequence[str]) -> DataFrame:
    """Rows (position, name, coefficient)."""
    return _named(spark, names, model.coefficients.toArray(), "coefficient")
