import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import evaluate as ev, ranks
from riskframe.functions.bins import threshold_grid


def scored(spark, rows):
    return spark.createDataFrame(rows, "label int, score double, g string")


def sample(spark, n=400, seed=2, digits=2):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    s = np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1).round(digits)
    return y, s, scored(spark, [(int(a), float(b), "ab"[i % 2]) for i, (a, b) in enumerate(zip(y, s))]).repartition(5)


def brute(y, s):
    """AUC by pairs, average precision by distinct thresholds."""
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap, seen = 0.0, 0
    for t in sorted(set(s), reverse=True):
        tp, fp = int(((s >= t) & (y == 1)).sum()), int(((s >= t) & (y == 0)).sum())
        ap += (tp - seen) / len(pos) * tp / (tp + fp)
        seen = tp
    return auc, ap


@pytest.mark.parametrize("small", [50_000, 5])
def test_ranking_metrics_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(ranks, "SMALL_ROWS", small)
    y, s, df = sample(spark, digits=3)
    auc, ap = brute(y, s)
    row = ev.ranking_metrics(df, "label", "score").first()
    assert row["roc_auc"] == pytest.approx(auc, abs=1e-12) and row["average_precision"] == pytest.approx(ap, abs=1e-12)
    mirrored = ev.ranking_metrics(df.withColumn("score", 1 - F.col("score")), "label", "score").first()
    assert row["roc_auc"] + mirrored["roc_auc"] == pytest.approx(1.0)
    for r in ev.ranking_metrics(df, "label", "score", ["g"]).collect():
        part = np.arange(len(y)) % 2 == (r["g"] == "b")
        auc, ap = brute(y[part], s[part])
        assert r["roc_auc"] == pytest.approx(auc) and r["average_precision"] == pytest.approx(ap)


def test_known_small_case(spark):
    df = scored(spark, [(0, 0.1, "x"), (0, 0.4, "x"), (1, 0.35, "x"), (1, 0.8, "x")])
    row = ev.ranking_metrics(df, "label", "score").first()
    assert row["roc_auc"] == 0.75 and row["average_precision"] == pytest.approx(0.8333333)


def test_one_class_only(spark):
    row = ev.ranking_metrics(scored(spark, [(0, 0.1, "x"), (0, 0.4, "x")]), "label", "score").first()
    assert row["roc_auc"] is None and row["average_precision"] == 0.0


@pytest.mark.parametrize("cells, want", [
    ((8682, 3969, 914, 2215), (0.6906, 0.3582, 0.7079, 0.4757)),
    ((8853, 3798, 917, 2212), (None, 0.3681, 0.7069, 0.4841)),
    ((12512, 139, 2818, 311), (0.8126, 0.6911, 0.0994, 0.1738)),
])
def test_published_confusion_counts_give_published_metrics(spark, cells, want):
    matrix = spark.createDataFrame([cells], "tn long, fp long, fn long, tp long")
    row = ev.with_metrics(matrix).first()
    for name, value in zip(("accuracy", "precision", "recall", "f1_score"), want):
        assert value is None or round(row[name], 4) == value


def test_class_report_of_published_counts(spark):
    matrix = spark.createDataFrame([(8682, 3969, 914, 2215)], "tn long, fp long, fn long, tp long")
    got = {r["class"]: [round(r[c], 2) for c in ("precision", "recall", "f1_score")] + [r["support"]] for r in ev.class_report(matrix).collect()}
    assert got == {
        "Not Canceled (0)": [0.9, 0.69, 0.78, 12651], "Canceled (1)": [0.36, 0.71, 0.48, 3129],
        "accuracy": [0.69, 0.69, 0.69, 15780], "macro avg": [0.63, 0.7, 0.63, 15780],
        "weighted avg": [0.8, 0.69, 0.72, 15780],
    }


def test_zero_division_is_zero(spark):
    row = ev.with_metrics(spark.createDataFrame([(5, 0, 0, 0)], "tn long, fp long, fn long, tp long")).first()
    assert (row["precision"], row["recall"], row["f1_score"], row["accuracy"]) == (0.0, 0.0, 0.0, 1.0)


def test_class_weight_of_published_counts(spark):
    df = spark.createDataFrame([(0, 37953), (1, 9387)], "y int, n int").selectExpr("explode(sequence(1, n))", "y")
    assert ev.class_balance(df, "y").first()["positive_weight"] == 4.043144774688399


def test_sweep_equals_brute_force(spark):
    y, s, df = sample(spark)
    rows = ev.threshold_sweep(df, "label", "score").orderBy("step").collect()
    assert [r["threshold"] for r in rows] == threshold_grid()
    for r in rows:
        p = s >= r["threshold"]
        tp, fp, fn = (p & (y == 1)).sum(), (p & (y == 0)).sum(), (~p & (y == 1)).sum()
        assert r["precision"] == pytest.approx(tp / (tp + fp) if tp + fp else 0)
        assert r["recall"] == pytest.approx(tp / (tp + fn))
    best = ev.best_of_sweep(ev.threshold_sweep(df, "label", "score")).first()
    top = max(r["f1_score"] for r in rows)
    assert best["threshold"] == min(r["threshold"] for r in rows if r["f1_score"] == top)
    assert [r["step"] for r in ev.every_kth(ev.threshold_sweep(df, "label", "score")).orderBy("step").collect()] == list(range(0, 91, 10))


def test_curve_optimum_and_end_point(spark):
    y, s, df = sample(spark)
    points = ev.pr_points(df, "label", "score")
    assert [tuple(r) for r in points.filter("threshold is null").collect()] == [(None, 1.0, 0.0)]
    best = ev.best_of_curve(points).first()
    f1 = lambda t: 2 * ((s >= t) & (y == 1)).sum() / ((s >= t).sum() + (y == 1).sum())
    assert f1(best["threshold"]) == pytest.approx(max(f1(t) for t in set(s)))


def test_threshold_choice_falls_back(spark):
    def choose(curve, sweep):
        a = spark.createDataFrame([(curve,)], "threshold double")
        b = spark.createDataFrame([(sweep,)], "threshold double")
        return ev.chosen_threshold(a, b).first()["threshold"]
    assert choose(0.4, 0.3) == 0.4 and choose(1.0, 0.3) == 0.3 and choose(0.0, 1.0) == 0.5 and choose(None, None) == 0.5


def test_roc_corners_keep_the_area(spark):
    y, s, df = sample(spark)
    full = sorted((r["fpr"], r["tpr"]) for r in ev.roc_points(df, "label", "score").collect())
    few = sorted((r["fpr"], r["tpr"]) for r in ev.roc_points(df, "label", "score", corners_only=True).collect())
    area = lambda p: float(np.trapezoid([b for _, b in p], [a for a, _ in p]))
    assert len(few) < len(full) and set(few) <= set(full)
    assert area(few) == pytest.approx(area(full)) == pytest.approx(brute(y, s)[0])


def test_nulls_are_not_scored(spark):
    df = scored(spark, [(1, 0.9, "x"), (0, 0.1, "x"), (None, 0.5, "x"), (1, None, "x")])
    row = ev.ranking_metrics(df, "label", "score").first()
    assert (row["positives"], row["negatives"], row["roc_auc"]) == (1, 1, 1.0)


def test_top_features_by_size(spark):
    df = spark.createDataFrame([("a", -3.0), ("b", 2.0), ("c", 0.1)], "name string, coefficient double")
    got = ev.top_features(df, "coefficient", 2, absolute=True).collect()
    assert [(r["name"], r["positive"]) for r in got] == [("a", False), ("b", True)]
