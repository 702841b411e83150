"""Evaluation of scored rows: confusion counts, curves, thresholds, model comparison.

The input is any table with a 0/1 label and a score. ``by`` evaluates several models or
groups at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.bins import curve_f1, number_array, predicted, ratio, threshold_grid, with_position
from riskframe.functions.fixed import GRID_POINTS
from riskframe.operators.ranks import prefix_sums

CLASS_NAMES = {0: "Not Canceled (0)", 1: "Canceled (1)"}


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Class counts, the weight of a positive row (negatives / positives, 1 without positives)
    and the balanced weights n / (2 n_class)."""
    positives, negatives = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    rows = positives + negatives
    return df.agg(
        negatives.alias("negatives"), positives.alias("positives"),
        F.when(positives > 0, negatives / positives).otherwise(F.lit(1.0)).alias("positive_weight"),
        ratio(rows, 2 * negatives).alias("balanced_weight_0"),
        ratio(rows, 2 * positives).alias("balanced_weight_1"),
    )


def confusion(scored: DataFrame, label: str, prediction: Column | str, by: Sequence[str] = ()) -> DataFrame:
    """One row (per group) with tn, fp, fn, tp, in one pass."""
    y, p = F.col(label), F.col(prediction) if isinstance(prediction, str) else prediction
    cells = [
        F.count_if((y == actual) & (p == predicted_class)).alias(name)
        for name, actual, predicted_class in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ]
    return scored.groupBy(*by).agg(*cells) if by else scored.agg(*cells)


def confusion_cells(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The confusion counts as four rows (actual, predicted, n); empty cells are 0."""
    cells = F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(name).alias("n"))
        for name, a, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ])
    return matrix.select(*by, F.explode(cells).alias("cell")).select(*by, "cell.*")


def with_metrics(matrix: DataFrame) -> DataFrame:
    """Add accuracy, precision, recall and f1 of the positive class (0 when undefined)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return matrix.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn),
    })


def class_report(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-class precision, recall, f1 and support, with accuracy, macro and weighted averages."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    total = tp + fp + fn + tn

    def line(name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), p.cast("double").alias("precision"),
            r.cast("double").alias("recall"), f.cast("double").alias("f1_score"), support.alias("support"),
        )

    p0, r0, f0, n0 = ratio(tn, tn + fn), ratio(tn, tn + fp), ratio(2 * tn, 2 * tn + fn + fp), tn + fp
    p1, r1, f1_, n1 = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(2 * tp, 2 * tp + fp + fn), tp + fn
    accuracy = ratio(tp + tn, total)
    macro = [(a + b) / 2 for a, b in ((p0, p1), (r0, r1), (f0, f1_))]
    weighted = [ratio(a * n0 + b * n1, total) for a, b in ((p0, p1), (r0, r1), (f0, f1_))]
    lines = F.array(
        line(CLASS_NAMES[0], p0, r0, f0, n0), line(CLASS_NAMES[1], p1, r1, f1_, n1),
        line("accuracy", accuracy, accuracy, accuracy, total),
        line("macro avg", *macro, total), line("weighted avg", *weighted, total),
    )
    return matrix.select(*by, F.explode(lines).alias("line")).select(*by, "line.*")


def score_counts(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score: ties are one row from here on."""
    valid = scored.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return valid.groupBy(*by, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def cumulative_counts(
    scored: DataFrame, label: str, score: str, by: Sequence[str] = (),
    following: dict[str, str] | None = None,
) -> DataFrame:
    """Rows (by..., score, pos, neg, tp, fp, positives, negatives): counts at score >= s.

    Running sums go by chunks of the score (`ranks.prefix_sums`), so nothing is sorted whole.
    """
    counts = score_counts(scored, label, score, by)
    return prefix_sums(
        counts, "score", {"pos": "tp", "neg": "fp"}, {"pos": "positives", "neg": "negatives"},
        by, descending=True, following=following,
    )


def ranking_metrics(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC and average precision (the step sum), exact with ties."""
    curve = cumulative_counts(scored, label, score, by)
    pos, neg, tp, fp = (F.col(c).cast("double") for c in ("pos", "neg", "tp", "fp"))
    sums = [
        F.sum(neg * (tp - pos + pos / 2)).alias("__area"),
        F.sum(pos * tp / (tp + fp)).alias("__steps"),
        F.max("positives").alias("positives"), F.max("negatives").alias("negatives"),
    ]
    total = curve.groupBy(*by).agg(*sums) if by else curve.agg(*sums)
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return total.select(
        *by, "positives", "negatives",
        F.try_divide("__area", p * n).alias("roc_auc"),
        ratio("__steps", p).alias("average_precision"),
    )


def roc_points(
    scored: DataFrame, label: str, score: str, by: Sequence[str] = (), corners_only: bool = False
) -> DataFrame:
    """ROC curve: (threshold, fpr, tpr) per distinct score, and the origin at +infinity.
    ``corners_only`` leaves out inner points whose step equals the next one."""
    curve = cumulative_counts(
        scored, label, score, by, {"pos": "next_pos", "neg": "next_neg"} if corners_only else None
    )
    if corners_only:
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        turns = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
        curve = curve.filter(first | F.col("next_pos").isNull() | turns)
    points = curve.select(
        *by, F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), "negatives").alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), "positives").alias("tpr"),
    )
    origin = [F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")]
    start = (
        scored.select(*by).distinct().select(*by, *origin) if by
        else scored.sparkSession.range(1).select(*origin)
    )
    return points.unionByName(start)


def pr_points(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision-recall curve: (threshold, precision, recall) per distinct score, and the final
    point (1, 0), which has no threshold."""
    tp, fp = F.col("tp"), F.col("fp")
    points = cumulative_counts(scored, label, score, by).select(
        *by, F.col("score").alias("threshold"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, "positives", 1.0).alias("recall"),
    )
    end = [F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")]
    last = (
        scored.select(*by).distinct().select(*by, *end) if by
        else scored.sparkSession.range(1).select(*end)
    )
    return points.unionByName(last)


def threshold_sweep(scored: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and f1 at each point of the threshold grid.

    Each score is placed in the grid once; counts per grid cell (at most 92 per group) are then
    summed from above. Scores and thresholds are never paired.
    """
    grid = number_array(threshold_grid())
    rows = scored.filter(F.col(score).isNotNull()).select(
        *by, F.col(label).alias("y"), F.col(score).cast("double").alias("s")
    )
    placed = with_position(rows, {"cell": ("s", grid)}, GRID_POINTS)
    cells = placed.groupBy(*by, "cell").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
    )
    per_group = cells.groupBy(*by).agg(F.collect_list(F.struct("cell", "pos", "neg")).alias("cells")) if by \
        else cells.agg(F.collect_list(F.struct("cell", "pos", "neg")).alias("cells"))
    steps = per_group.select(*by, "cells", F.posexplode(grid).alias("step", "threshold"))

    def at_least(field: str) -> Column:
        return F.aggregate(
            "cells", F.lit(0).cast("long"),
            lambda acc, c: acc + F.when(c["cell"] > F.col("step"), c[field]).otherwise(F.lit(0)),
        )

    total = F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + c["pos"])
    tp, fp = F.col("tp"), F.col("fp")
    counted = steps.select(
        *by, "step", "threshold", at_least("pos").alias("tp"), at_least("neg").alias("fp"), total.alias("p")
    )
    precision, recall = ratio(tp, tp + fp), ratio(tp, "p")
    return counted.select(
        *by, "step", "threshold", precision.alias("precision"), recall.alias("recall"),
        ratio(2 * tp, tp + fp + F.col("p")).alias("f1_score"),
    )


def every_kth(sweep: DataFrame, k: int = 10) -> DataFrame:
    """Every k-th row of a sweep, by its step number."""
    return sweep.filter(F.col("step") % k == 0)


def best_of_sweep(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The grid row with the highest f1, the lowest threshold among equals."""
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1_score"), F.struct("f1_score", -F.col("threshold")))
    grouped = sweep.groupBy(*by).agg(best.alias("best")) if by else sweep.agg(best.alias("best"))
    return grouped.select(*by, "best.*")


def best_of_curve(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The curve point with the highest f1 (guarded against zero), the lowest threshold first."""
    scored = points.filter(F.col("threshold").isNotNull()).withColumn(
        "f1_score", curve_f1(F.col("precision"), F.col("recall"))
    )
    return best_of_sweep(scored, by)


def chosen_threshold(curve_best: DataFrame, sweep_best: DataFrame, default: float = 0.5) -> DataFrame:
    """One row: the curve optimum if it lies in (0, 1), else the sweep optimum, else 0.5."""
    def valid(t: Column) -> Column:
        return F.when((t > 0) & (t < 1), t)

    sweep_t = sweep_best.select("threshold").scalar()
    return curve_best.agg(F.max("threshold").alias("curve_threshold")).select(
        "curve_threshold", sweep_t.alias("sweep_threshold"),
        F.coalesce(valid(F.col("curve_threshold")), valid(sweep_t), F.lit(default)).alias("threshold"),
    )


def evaluate(
    scored: DataFrame, label: str, score: str, threshold: Column | float = 0.5,
    by: Sequence[str] = (), prediction: Column | None = None,
) -> DataFrame:
    """All metrics of a scored table: confusion counts, class metrics, ROC AUC and average
    precision. A given 0/1 ``prediction`` replaces score >= threshold."""
    decision = predicted(score, threshold) if prediction is None else prediction
    classes = with_metrics(confusion(scored, label, decision, by))
    ranking = ranking_metrics(scored, label, score, by).select(*by, "roc_auc", "average_precision")
    if by:
        return classes.join(ranking, list(by), "left")
    pair = ranking.select(F.struct("roc_auc", "average_precision").alias("r")).scalar()
    return classes.withColumns({"roc_auc": pair["roc_auc"], "average_precision": pair["average_precision"]})


def mean_fold_score(fold_scores: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean over folds of a per-fold score."""
    return fold_scores.groupBy(*by).agg(F.avg(score).alias("mean_score"), F.count(score).alias("folds"))


def scores_per_fold(scored: DataFrame, label: str, score: str, fold: str = "fold") -> DataFrame:
    """Average precision and ROC AUC of each fold of out-of-fold scores."""
    return ranking_metrics(scored, label, score, [fold])


def top_features(importances: DataFrame, value: str = "importance", k: int = 20, absolute: bool = False) -> DataFrame:
    """The k names with the largest (absolute) value; ``positive`` tells the sign."""
    size = F.abs(F.col(value)) if absolute else F.col(value)
    top = importances.orderBy(size.desc(), "name").limit(k)
    return top.withColumn("positive", F.col(value) > 0) if absolute else top


