import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import boosting as bo, guided, train as tr

RANGES = tr.GUIDED_SEARCH_RANGES


def objective(p):
    """Best at a learning rate of 0.03 and 60 leaves; the other parameters do not matter."""
    return -abs(math.log(p["learning_rate"] / 0.03)) - abs(p["num_leaves"] - 60) / 40


def test_later_draws_follow_earlier_scores():
    found = guided.maximise(objective, RANGES, tr.GUIDED_SEARCH_DRAWS)
    assert len(found.trials) == 50
    scores = [s for _, s in found.trials]
    assert np.mean(scores[-20:]) > np.mean(scores[:10]) + 0.3
    assert found.best[1] == max(scores)
    again = guided.maximise(objective, RANGES, tr.GUIDED_SEARCH_DRAWS)
    assert again.trials == found.trials
    turned = guided.maximise(lambda p: -objective(p), RANGES, 20)
    assert [p for p, _ in turned.trials[:10]] == [p for p, _ in found.trials[:10]]
    assert turned.trials[12][0] != found.trials[12][0]


def test_draws_stay_in_their_ranges():
    for params, _ in guided.maximise(objective, RANGES, 40, seed=3).trials:
        for name, (kind, low, high, *step) in RANGES.items():
            assert low <= params[name] <= high
            if kind != "log":
                steps = (params[name] - low) / step[0]
                assert steps == pytest.approx(round(steps))
            assert isinstance(params[name], int) == (kind == "int")


def test_density_is_one_over_its_range():
    d = guided.Density([1.0, 1.5, 4.0], 0.0, 5.0)
    x = np.linspace(0, 5, 4001)
    area = np.exp(d.log(x)).mean() * 5 / math.sqrt(2 * math.pi)
    assert area == pytest.approx(1, abs=1e-3)
    drawn = d.draw(np.random.default_rng(1), 500)
    assert drawn.min() >= 0 and drawn.max() <= 5


def test_search_over_folds(spark):
    rng = np.random.default_rng(0)
    rows = [(i, int(y), 1.0, i % 3, [float(rng.normal(2 * y)), float(rng.normal())]) for i, y in enumerate(rng.random(240) < 0.3)]
    data = spark.createDataFrame(rows, "id long, label int, weight double, fold int, features array<double>").repartition(2)
    ranges = {"n_estimators": ("int", 2, 3, 1), "learning_rate": ("log", 0.05, 0.5), "num_leaves": ("int", 2, 4, 1)}
    found = guided.search(data, ranges, 4, ["id"], patience=1, startup=2, max_depth=2)
    table = guided.trial_table(spark, found)
    assert table.count() == 4
    assert table.agg(F.min("score")).first()[0] > 0.5


def test_rows_are_binned_once_for_all_trials(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(guided, "binned", lambda *a, **k: calls.append(1) or bo.binned(*a, **k))
    rows = [(i, i % 2, 1.0, i % 3, [float(i % 2), float(i % 7)]) for i in range(60)]
    train = spark.createDataFrame(rows, "id long, label int, weight double, fold int, features array<double>")
    found = guided.search(train, {"n_estimators": ("int", 1, 2, 1)}, 2, ["id"])
    assert len(found.trials) == 2 and len(calls) == 1
