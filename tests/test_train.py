import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riskframe.operators import boosting as bo, evaluate as ev, train as tr
from riskframe.operators.stratify import stratified_folds
from riskframe.plans import catalog_models as cm
from riskframe.sources import sinks

SMALL = {"n_estimators": 5, "learning_rate": 0.3, "max_depth": 3, "subsample": 1.0, "colsample_bytree": 1.0}


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        y = int(rng.random() < 0.25)
        rows.append((i, y, Vectors.dense(rng.normal(2 * y), rng.normal(), rng.normal(-y))))
    df = spark.createDataFrame(rows, ["id", "label", "features"]).repartition(4).cache()
    return stratified_folds(df, "label", ["id"]).cache()


def auc(scored):
    return ev.ranking_metrics(scored, "label", "score").first()["roc_auc"]


def test_models_learn_and_are_saved(spark, data, tmp_path):
    weighted = tr.weighted(data, "label")
    assert weighted.filter("label = 1").first()["weight"] > 1
    model = tr.boosting(SMALL).fit(weighted)
    scored = tr.score(model, data, ["id", "label"])
    assert auc(scored) > 0.9 and set(scored.columns) == {"id", "label", "score", "prediction"}
    loaded = GBTClassificationModel.load(sinks.save_model(model, str(tmp_path / "m")))
    assert auc(tr.score(loaded, data, ["id", "label"])) == auc(scored)
    names = tr.importances(spark, model, ["a", "b", "c"])
    assert ev.top_features(names, k=1).first()["name"] == "a"


def test_balanced_forest_and_logistic(spark, data):
    weighted = tr.weighted(data, "label", "balanced")
    total = weighted.agg(F.sum("weight")).first()[0]
    assert total == pytest.approx(600)
    forest = tr.forest({"n_estimators": 5, "max_depth": 4, "min_samples_leaf": 5}).fit(weighted)
    assert auc(tr.score(forest, data, ["label"])) > 0.9
    logistic = tr.l1_logistic(total).fit(weighted)
    assert auc(tr.score(logistic, data, ["label"])) > 0.9
    top = ev.top_features(tr.coefficients(spark, logistic, ["a", "b", "c"]), "coefficient", absolute=True).collect()
    assert top[0]["name"] == "a" and top[0]["positive"]


def test_early_stopping_grows_no_more_trees(data):
    settings = {**SMALL, "n_estimators": 30}
    weighted = tr.weighted(data, "label").withColumn("held_out", F.col("fold") == 0)
    model = tr.boosting(settings, validation="held_out", tolerance=0.05).fit(weighted)
    assert model.getNumTrees < 30


def test_evaluator_is_average_precision(data):
    model = tr.boosting(SMALL, weight=None).fit(data)
    scored = tr.score(model, data, ["label"])
    want = ev.ranking_metrics(scored, "label", "score").first()["average_precision"]
    evaluator = tr.AveragePrecision()
    assert evaluator.evaluate(model.transform(data)) == pytest.approx(want) and evaluator.isLargerBetter()


def test_search_keeps_the_best_draw(spark, data):
    draws = [{**SMALL, "n_estimators": 1, "max_depth": 1}, {**SMALL, "n_estimators": 5}]
    fitted = tr.search(tr.weighted(data, "label"), draws, tr.boosting(SMALL), parallelism=2)
    table = tr.search_table(spark, draws, fitted).orderBy("draw").collect()
    assert table[1]["mean_score"] > table[0]["mean_score"]
    assert fitted.bestModel.getNumTrees == 5


def test_fold_scores_cover_every_row_once(data):
    scored = tr.fold_scores(tr.weighted(data, "label"), tr.boosting(SMALL), ["id", "label"])
    assert scored.count() == 600 == scored.select("id").distinct().count()
    per_fold = ev.scores_per_fold(scored, "label", "score")
    mean = ev.mean_fold_score(per_fold, "roc_auc").first()
    assert mean["folds"] == 3 and mean["mean_score"] > 0.85


def test_draws_are_repeatable_and_in_range():
    a = tr.random_draws(tr.RANDOM_SEARCH_SPACE, 60)
    assert a == tr.random_draws(tr.RANDOM_SEARCH_SPACE, 60) and len({str(d) for d in a}) == 60
    assert all(v in tr.RANDOM_SEARCH_SPACE[k] for d in a for k, v in d.items())
    assert len(tr.random_draws({"x": [1, 2]}, 9)) == 2
    for d in tr.range_draws(tr.GUIDED_SEARCH_RANGES, 50):
        assert d["n_estimators"] % 50 == 0 and 100 <= d["n_estimators"] <= 1000
        assert 0.005 <= d["learning_rate"] <= 0.1 and 0.6 <= d["subsample"] <= 1.0


def test_training_rows_of_trees_come_in_bounded_partitions(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(1000, numPartitions=2).select("id", array_to_vector(F.array_repeat(F.lit(0.0), 50)).alias("features"))
    assert tr.bounded(df).rdd.getNumPartitions() == 2  # small: as they come
    parts = tr.bounded(df, task_bytes=20_000)
    sizes = parts.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) <= 150
    assert parts.select("id").distinct().count() == 1000
    assert tr.bounded(df.filter("id < 0")).count() == 0


def test_search_applies_all_parameters_of_a_draw(spark, data, monkeypatch):
    weighted = tr.weighted(data, "label")
    draw = {**SMALL, "n_estimators": 3, "gamma": 0.5}  # of a node's whole gain; per row it would leave no split
    changes = {"gamma": 500.0, "reg_alpha": 50.0, "reg_lambda": 90.0, "min_child_weight": 60.0, "num_leaves": 2, "min_child_samples": 150}
    draws = [draw, *[{**draw, k: v} for k, v in changes.items()]]
    fitted = tr.search(weighted, draws, tr.boosting(SMALL), keys=["id"])
    assert all(t.leaves > 2 for t in fitted.bestModel.trees) and len(fitted.avgMetrics) == len(draws)
    assert len({round(m, 9) for m in fitted.avgMetrics}) == len(draws)
    monkeypatch.setattr(bo, "LOCAL_BYTES", 0)  # in rounds, scored by a job each
    again = tr.search(weighted, draws[:2], tr.boosting(SMALL), keys=["id"])
    assert again.avgMetrics == pytest.approx(fitted.avgMetrics[:2]) and again.stdMetrics == pytest.approx(fitted.stdMetrics[:2])


def _searched(monkeypatch, data, query):
    """The draws that a query searches."""
    class Few:
        def __init__(self, *_):
            self.train = tr.weighted(data.drop("fold").withColumnRenamed("id", "plan_id"), "label")

    seen = []
    monkeypatch.setattr(cm, "_Data", Few)
    monkeypatch.setattr(tr, "search", lambda train, draws, *a, **k: seen.extend(draws) or tr.Searched([0.5] * len(draws), [0.0] * len(draws), None))
    assert query(data.sparkSession, "").count() == len(seen)
    return seen


def test_random_search_tries_all_published_draws(data, monkeypatch):
    assert _searched(monkeypatch, data, cm.search_best) == tr.random_draws(tr.RANDOM_SEARCH_SPACE, tr.RANDOM_SEARCH_DRAWS)


def test_range_search_tries_all_published_draws(data, monkeypatch):
    assert _searched(monkeypatch, data, cm.search_ranges) == tr.range_draws(tr.GUIDED_SEARCH_RANGES, tr.GUIDED_SEARCH_DRAWS)
