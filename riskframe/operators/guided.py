"""Guided search: a tree-structured density sampler that learns from earlier trials.

After some random trials the scores are cut into the best few and the rest. For each parameter two densities
are estimated, one of the values of the best trials and one of the others: a mixture of truncated normals, one
per value and one for the whole range, on a log scale where the range asks for it. Candidates are drawn
from the first density, and the one where it exceeds the second most is tried next.

The sampler looks only at its own list of trials (a few numbers each), so it runs on the driver; what a trial
costs, fitting and scoring on folds, runs on Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from riskframe.functions.fixed import FOLDS, SEED
from riskframe.operators.boosting import Settings, binned, grow

#: Random trials first, candidates per draw, share and most of the trials that count as good.
STARTUP, CANDIDATES, GOOD_SHARE, GOOD_MOST = 10, 24, 0.1, 25
Range = tuple  # ("int" | "step", low, high, step) or ("log", low, high)


def _cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(x / math.sqrt(2)))


class Density:
    """Mixture over [low, high]: a normal around each value, as wide as the gap to its farther neighbour, and
    one over the whole range."""

    def __init__(self, values: Sequence[float], low: float, high: float):
        self.low, self.high = low, high
        span = high - low or 1.0
        values = np.asarray([*values, (low + high) / 2], dtype=float)
        order = np.argsort(values, kind="stable")
        ranked = np.concatenate([[low], values[order], [high]])
        width = np.empty(len(values))
        width[order] = np.maximum(ranked[1:-1] - ranked[:-2], ranked[2:] - ranked[1:-1])
        self.mean, self.width = values, np.clip(width, span / min(100, len(values) + 1), span)
        self.width[-1] = span
        self.mass = _cdf((high - self.mean) / self.width) - _cdf((low - self.mean) / self.width)

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        which = rng.integers(len(self.mean), size=n)
        out = rng.normal(self.mean[which], self.width[which])
        while (bad := (out < self.low) | (out > self.high)).any():
            out[bad] = rng.normal(self.mean[which[bad]], self.width[which[bad]])
        return out

    def log(self, x: np.ndarray) -> np.ndarray:
        z = (x[:, None] - self.mean) / self.width
        return np.log((np.exp(-z * z / 2) / (self.width * self.mass)).mean(axis=1) + 1e-300)


@dataclass
class Sampler:
    """``suggest`` gives the next parameters, ``tell`` takes their score (larger is better)."""

    ranges: Mapping[str, Range]
    seed: int = SEED
    startup: int = STARTUP
    trials: list[tuple[dict, float]] = field(default_factory=list)

    @staticmethod
    def _scaled(spec: Range, value: float) -> float:
        return math.log(value) if spec[0] == "log" else float(value)

    @staticmethod
    def _value(spec: Range, x: float):
        if spec[0] == "log":
            return min(max(math.exp(x), spec[1]), spec[2])
        kind, low, high, step = spec
        value = low + step * min(max(round((x - low) / step), 0), round((high - low) / step))
        return int(value) if kind == "int" else round(value, 10)

    def suggest(self) -> dict:
        rng = np.random.default_rng([self.seed, len(self.trials)])
        ranked = sorted(range(len(self.trials)), key=lambda i: (-self.trials[i][1], i))
        good = min(math.ceil(GOOD_SHARE * len(ranked)), GOOD_MOST)
        out = {}
        for name, spec in self.ranges.items():
            # a lattice reaches half a step beyond its ends, so that these are as likely as the others
            half = 0.0 if spec[0] == "log" else spec[3] / 2
            low, high = self._scaled(spec, spec[1]) - half, self._scaled(spec, spec[2]) + half
            if len(self.trials) < self.startup:
                out[name] = self._value(spec, rng.uniform(low, high))
                continue
            seen = [self._scaled(spec, self.trials[i][0][name]) for i in ranked]
            best, rest = Density(seen[:good], low, high), Density(seen[good:], low, high)
            drawn = best.draw(rng, CANDIDATES)
            out[name] = self._value(spec, float(drawn[np.argmax(best.log(drawn) - rest.log(drawn))]))
        return out

    def tell(self, params: Mapping[str, object], score: float) -> None:
        self.trials.append((dict(params), float(score)))

    @property
    def best(self) -> tuple[dict, float]:
        return max(self.trials, key=lambda t: t[1])


def maximise(score: Callable[[dict], float], ranges: Mapping[str, Range], trials: int, seed: int = SEED, startup: int = STARTUP) -> Sampler:
    sampler = Sampler(ranges, seed, startup)
    for _ in range(trials):
        params = sampler.suggest()
        sampler.tell(params, score(params))
    return sampler


def search(
    train: DataFrame, ranges: Mapping[str, Range], trials: int, keys: Sequence[str], fold: str = "fold", folds: int = FOLDS,
    patience: int | None = 10, seed: int = SEED, startup: int = STARTUP, **fixed: object,
) -> Sampler:
    """Guided search over boosted trees: a trial's score is the mean over the folds of the average precision
    of the best round, training of each fold stopping ``patience`` trees after it. The folds of a trial are
    fitted side by side; rows are binned once for all trials. ``fixed`` holds settings that are not searched."""
    table = binned(train, keys, fold=fold)

    def score(params: dict) -> float:
        settings = [Settings.of(params, fold=i, patience=patience, seed=seed, **fixed) for i in range(folds)]
        models = grow(table, settings)
        return float(np.mean([m.history[m.best - 1] if m.history else 0.0 for m in models]))

    try:
        return maximise(score, ranges, trials, seed, startup)
    finally:
        table.drop()


def trial_table(spark: SparkSession, sampler: Sampler) -> DataFrame:
    """trial, params, score of every trial."""
    rows = [(i, str(p), s) for i, (p, s) in enumerate(sampler.trials)]
    return spark.createDataFrame(rows, "trial int, params string, score double")
