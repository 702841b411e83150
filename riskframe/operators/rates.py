"""Smoothed target rates per category, as fit and transform."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.fixed import FOLDS, NULL_TEXT
from riskframe.operators.joins import attach, hot_keys_of
from riskframe.operators.projection import melt
from riskframe.operators.stratify import stratified_folds
from riskframe.session import settle

CLASSES = 2


def smoothed(positives: Column, rows: Column, alpha: float = 1) -> Column:
    """(positives + alpha) / (rows + 2 alpha)."""
    return (positives + F.lit(alpha)) / (rows + F.lit(CLASSES * alpha))


def _known(category: Column) -> Column:
    """Category text; a null and the text of a null are no category."""
    text = category.cast("string")
    return F.when(text != NULL_TEXT, text)


@dataclass
class SmoothedRates:
    """Fitted rates: ``table`` has rows (rate_name, category, positives, rows)."""

    columns: Mapping[str, str]
    alpha: float
    table: DataFrame
    small: bool
    overall: Mapping[str, tuple[int, int]]

    def _global(self, rate_name: str) -> float:
        positives, rows = self.overall.get(rate_name, (0, 0))
        return (positives + self.alpha) / (rows + CLASSES * self.alpha)

    def transform(self, df: DataFrame) -> DataFrame:
        """Add one column per rate; an unknown category gets the global smoothed rate. Each rate is
        one join; hot categories of all of them are found in one pass."""
        hot = {} if self.small else hot_keys_of(df, {n: [_known(F.col(c))] for n, c in self.columns.items()})
        for rate_name, column in self.columns.items():
            rates = self.table.filter(F.col("rate_name") == rate_name).select(
                F.col("category").alias("__category"),
                smoothed(F.col("positives"), F.col("rows"), self.alpha).alias(rate_name),
            )
            df = attach(df.withColumn("__category", _known(F.col(column))), rates, ["__category"], self.small, hot.get(rate_name))
            df = df.withColumn(rate_name, F.coalesce(F.col(rate_name), F.lit(self._global(rate_name))))
        return df.drop("__category")


def _tally(df: DataFrame, columns: Mapping[str, str], target: str, extra: list[str]) -> DataFrame:
    """Positives and rows per category for all columns in one pass; partial aggregation keeps
    a hot category to one row per task."""
    labelled = df.filter(F.col(target).isNotNull()).withColumn("__y", F.col(target).cast("int"))
    categories = {name: _known(F.col(c)) for name, c in columns.items()}
    return (
        melt(labelled, categories, "rate_name", [*extra, "__y"], "category")
        .filter(F.col("category").isNotNull())
        .groupBy(*extra, "rate_name", "category")
        .agg(F.sum("__y").alias("positives"), F.count("*").alias("rows"))
    )


def fit_smoothed_rates(
    df: DataFrame, columns: Mapping[str, str], target: str, alpha: float = 1
) -> SmoothedRates:
    """Fit on ``df``, where ``columns`` maps the rate's name to its category column. Fitted on
    a whole table the rates see every label, as in the original analysis; fit on the training
    part, or use `out_of_fold_rates`, to keep labels out of their own features."""
    table, small = settle(_tally(df, columns, target, []))
    overall = table.groupBy("rate_name").agg(F.sum("positives").alias("p"), F.sum("rows").alias("n"))
    totals = {r["rate_name"]: (r["p"], r["n"]) for r in overall.collect()}  # one row per rate
    return SmoothedRates(dict(columns), alpha, table, small, totals)


def out_of_fold_rates(
    df: DataFrame, columns: Mapping[str, str], target: str, key: list[str],
    alpha: float = 1, folds: int = FOLDS, fold: Column | None = None,
) -> DataFrame:
    """Rates in which a row's own fold does not take part. ``fold`` gives each row's fold (0 to
    folds - 1); by default folds are stratified."""
    folded = stratified_folds(df, target, key, folds, name="__fold") if fold is None else df.withColumn("__fold", fold.cast("int"))
    table, small = settle(_tally(folded, columns, target, ["__fold"]))
    every = table.groupBy("rate_name", "category").agg(
        F.sum("positives").alias("p"), F.sum("rows").alias("n")
    )
    totals = table.groupBy("rate_name", "__fold").agg(F.sum("positives").alias("p"), F.sum("rows").alias("n")).collect()
    out = folded
    known = {n: [_known(F.col(c))] for n, c in columns.items()}
    hot = {} if small else hot_keys_of(folded, known)
    hot_own = {} if small else hot_keys_of(folded, {n: ["__fold", *k] for n, k in known.items()})
    for rate_name, column in columns.items():
        own = table.filter(F.col("rate_name") == rate_name).select("__fold", F.col("category").alias("__category"), "positives", "rows")
        rest = every.filter(F.col("rate_name") == rate_name).select(F.col("category").alias("__category"), "p", "n")
        out = out.withColumn("__category", _known(F.col(column)))
        out = attach(out, rest, ["__category"], small, hot.get(rate_name))
        out = attach(out, own, ["__fold", "__category"], small, hot_own.get(rate_name))
        positives = F.col("p") - F.coalesce("positives", F.lit(0))
        rows = F.col("n") - F.coalesce("rows", F.lit(0))
        fallback = F
        for fold in range(folds):
            p = sum(t["p"] for t in totals if t["rate_name"] == rate_name and t["__fold"] != fold)
            n = sum(t["n"] for t in totals if t["rate_name"] == rate_name and t["__fold"] != fold)
            fallback = fallback.when(F.col("__fold") == fold, F.lit((p + alpha) / (n + CLASSES * alpha)))
        rate = F.when(rows > 0, smoothed(positives, rows, alpha))
        out = out.withColumn(rate_name, F.coalesce(rate, fallback)).drop("p", "n", "positives", "rows")
    return out.drop("__category", "__fold")
