"""From an engineered table to a feature vector: imputation, scaling, one-hot encoding."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.functions.clean import nan_to_null
from riskframe.functions.fixed import (
    CATEGORICAL_FEATURES, INFREQUENT_SUFFIX, MIN_CATEGORY_ROWS, NOT_FEATURES, NUMERIC_FEATURES,
)
from riskframe.operators.joins import attach, hot_keys_of
from riskframe.operators.projection import melt
from riskframe.operators.ranks import medians
from riskframe import session
from riskframe.session import settle


@dataclass(frozen=True)
class FeatureSpec:
    """Which columns are numeric features, categorical features and no features at all."""

    numeric: Sequence[str] = field(default_factory=lambda: list(NUMERIC_FEATURES))
    categorical: Sequence[str] = field(default_factory=lambda: list(CATEGORICAL_FEATURES))
    dropped: Sequence[str] = field(default_factory=lambda: list(NOT_FEATURES))
    label: str = "was_canceled"
    key: str = "plan_id"

    def within(self, df: DataFrame) -> FeatureSpec:
        """The spec limited to columns that exist; numeric ones must have a numeric type."""
        numeric_types = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
        kinds = dict(df.dtypes)
        is_numeric = lambda c: kinds.get(c, "").startswith(numeric_types)
        return FeatureSpec(
            [c for c in self.numeric if is_numeric(c) and c not in self.dropped],
            [c for c in self.categorical if c in kinds and c not in self.dropped],
            [c for c in self.dropped if c in kinds], self.label, self.key,
        )

    def select(self, df: DataFrame) -> DataFrame:
        return df.select(self.key, self.label, *self.numeric, *self.categorical)


def scaling_params(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: median, then mean and population standard deviation of the imputed values
    (1 where there is no spread). One row per column; an all-null column has a null median."""
    middle, _ = settle(medians(train, columns))
    row = middle.first() or {}
    filled = {str(i): F.coalesce(nan_to_null(c), F.lit(row[c])) for i, c in enumerate(columns)}
    place = F.col("position").cast("int")
    names, middles = F.array(*[F.lit(c) for c in columns]), F.array(*[F.lit(row[c]).cast("double") for c in columns])
    spread = F.stddev_pop("value")
    return (
        melt(train, filled, "position").groupBy("position")
        .agg(F.avg("value").alias("mean"), F.when(spread == 0, 1.0).otherwise(spread).alias("scale"))
        .select(place.alias("position"), F.get(names, place).alias("column"), F.get(middles, place).alias("median"), "mean", "scale")
    )


def vocabulary(
    train: DataFrame, columns: Sequence[str], min_rows: int = MIN_CATEGORY_ROWS
) -> DataFrame:
    """One-hot slots: rows (column, category, name, rare, slot), slots from 0 per column.

    Categories with fewer than ``min_rows`` rows share the column's last slot. All columns are
    counted in one pass. The slot order needs the *names* per column sorted: they are the
    width of the model, not of the data.
    """
    counts = (
        melt(train, {c: F.col(c).cast("string") for c in columns}, "column", value="category")
        .filter(F.col("category").isNotNull())
        .groupBy("column", "category").agg(F.count("*").alias("n"))
    )
    counts, _ = settle(counts)  # read twice below
    rare = F.col("n") < min_rows
    own = F.concat_ws("_", "column", "category")
    shared = F.concat(F.col("column"), F.lit(INFREQUENT_SUFFIX))
    named = counts.withColumns({"rare": rare, "name": F.when(rare, shared).otherwise(own)})
    order = Window.partitionBy("column").orderBy("rare", "category")
    frequent = named.filter(~rare).withColumn("slot", F.row_number().over(order) - 1)
    width = frequent.groupBy("column").agg(F.count("*").cast("int").alias("slot"))
    sparse = named.filter(rare).join(F.broadcast(width), "column", "left").withColumn(  # a row per column
        "slot", F.coalesce("slot", F.lit(0))
    )
    return frequent.unionByName(sparse).select("column", "category", "n", "name", "rare", "slot")


def feature_names(vocab: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Vector positions: rows (position, name); numeric first, then slots by column order."""
    slots = vocab.select("column", "slot", "name").distinct()
    place = F.create_map(*[F.lit(x) for i, c in enumerate(categorical) for x in (c, i)])
    order = Window.orderBy(F.element_at(place, F.col("column")), "slot")  # over model slots only
    coded = slots.select((F.row_number().over(order) - 1 + len(numeric)).alias("position"), "name")
    spark = vocab.sparkSession
    plain = spark.createDataFrame(list(enumerate(numeric)), "position int, name string")
    return plain.unionByName(coded)


def names_or_generic(names: Sequence[str], width: int) -> list[str]:
    """The names if there are as many as vector slots, generic ones otherwise."""
    return list(names) if len(names) == width else [f"feat_{i}" for i in range(width)]


def one_hot_long(df: DataFrame, key: str, columns: Sequence[str], vocab: DataFrame) -> DataFrame:
    """Encoding in long form: one row (key, column, name) per known category of a row."""
    long = melt(df, {c: F.col(c).cast("string") for c in columns}, "column", [key], "category")
    known = attach(long, vocab.select("column", "category", "name"), ["column", "category"], how="inner")
    return known.select(key, "column", "name")


@dataclass
class Preprocessor:
    """Fitted column transformer. ``params`` and ``vocab`` are ordinary tables and can be
    written and read like any other (see `sources.sinks`)."""

    numeric: list[str]
    categorical: list[str]
    params: DataFrame
    vocab: DataFrame
    small: bool
    drop_empty: bool = True

    @cached_property
    def _params(self) -> dict[str, dict]:
        return {r["column"]: r.asDict() for r in self.params.collect()}  # a row per column

    @property
    def kept_numeric(self) -> list[str]:
        """Numeric columns in the vector; one without any training value has no median."""
        return [c for c in self.numeric if not self.drop_empty or self._params[c]["median"] is not None]

    @cached_property
    def widths(self) -> dict[str, int]:
        """Slots per categorical column."""
        rows = self.vocab.groupBy("column").agg((F.max("slot") + 1).alias("width")).collect()
        found = {r["column"]: r["width"] for r in rows}
        return {c: found[c] for c in self.categorical if c in found}

    @cached_property
    def small_columns(self) -> set[str]:
        """Categorical columns whose own labels are few and short; each column decides for itself."""
        size = F.sum(F.octet_length("category") + 16)
        rows = self.vocab.groupBy("column").agg(F.count("*").alias("n"), size.alias("b")).collect()
        return {r["column"] for r in rows if r["n"] <= session.SMALL_ROWS and r["b"] <= session.SMALL_BYTES}

    def names(self) -> DataFrame:
        return feature_names(self.vocab, self.kept_numeric, self.categorical)

    def scaled(self, df: DataFrame) -> DataFrame:
        """Numeric columns imputed and scaled, in place."""
        params = self._params

        def scale(c: str) -> Column:
            p = params[c]
            value = F.coalesce(nan_to_null(c), F.lit(p["median"]), F.lit(0.0))
            return (value - F.lit(p["mean"] or 0.0)) / F.lit(p["scale"] or 1.0)

        return df.withColumns({c: scale(c) for c in self.kept_numeric})

    def _with_slots(self, df: DataFrame) -> DataFrame:
        """Add the slot of each category; an unknown or missing one gets the number of slots."""
        columns = list(self.widths)
        if not columns:
            return df
        large = [c for c in columns if c not in self.small_columns]
        hot = hot_keys_of(df, {c: [F.col(c).cast("string")] for c in large})
        for column in large:  # one join each; hot categories of all of them were found in one pass
            slots = self.vocab.filter(F.col("column") == column).select(
                F.col("category").alias("__category"), F.col("slot").alias(f"__slot_{column}")
            )
            df = attach(df.withColumn("__category", F.col(column).cast("string")), slots, ["__category"], False, hot[column])
            df = df.withColumn(f"__slot_{column}", F.coalesce(f"__slot_{column}", F.lit(self.widths[column])).cast("double")).drop("__category")
        columns = [c for c in columns if c not in large]
        if not columns:
            return df
        # a small vocabulary is a set of label lists: frequent categories first, in slot order,
        # then the rare ones, which share the next slot
        labels: dict[str, list[str]] = {c: [] for c in columns}
        frequent = dict.fromkeys(columns, 0)
        wanted = self.vocab.filter(F.col("column").isin(columns)).orderBy("column", "slot", "category")
        for row in wanted.collect():
            labels[row["column"]].append(row["category"])
            frequent[row["column"]] += not row["rare"]
        indexer = StringIndexerModel.from_arrays_of_labels(
            [labels[c] for c in columns], [f"__text_{c}" for c in columns],
            [f"__index_{c}" for c in columns], handleInvalid="keep",
        )
        indexed = indexer.transform(df.withColumns({f"__text_{c}": F.col(c).cast("string") for c in columns}))
        slots = {
            f"__slot_{c}": F.when(F.col(f"__index_{c}") >= len(labels[c]), F.lit(float(self.widths[c]))).otherwise(
                F.least(F.col(f"__index_{c}"), F.lit(float(frequent[c])))
            )
            for c in columns
        }
        return indexed.withColumns(slots).drop(*[f"__text_{c}" for c in columns], *[f"__index_{c}" for c in columns])

    def transform(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Rows (keep..., features): sparse vector, numeric features first."""
        out = self._with_slots(self.scaled(df))
        hot = list(self.widths)
        for column, width in self.widths.items():
            # the number of slots travels as column metadata, so the encoder needs no data pass;
            # the extra last slot stands for unknown and is left out by dropLast
            meta = {"ml_attr": {"type": "nominal", "num_vals": width + 1, "name": column}}
            out = out.withMetadata(f"__slot_{column}", meta)
        if hot:
            encoder = OneHotEncoder(
                inputCols=[f"__slot_{c}" for c in hot], outputCols=[f"__hot_{c}" for c in hot], dropLast=True
            )
            out = encoder.fit(out).transform(out)
        assembler = VectorAssembler(
            inputCols=self.kept_numeric + [f"__hot_{c}" for c in hot], outputCol="features"
        )
        return assembler.transform(out).select(*keep, "features")


def fit_preprocessor(
    train: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
    min_rows: int = MIN_CATEGORY_ROWS, drop_empty: bool = True,
) -> Preprocessor:
    """Fit medians, scales and one-hot slots on the training rows only."""
    params, _ = settle(scaling_params(train, numeric))
    vocab, small = settle(vocabulary(train, categorical, min_rows))
    return Preprocessor(list(numeric), list(categorical), params, vocab, small, drop_empty)


def with_class_weight(df: DataFrame, label: str, weights: dict[int, float], name: str = "weight") -> DataFrame:
    expr = F
    for value, weight in weights.items():
        expr = expr.when(F.col(label) == value, F.lit(float(weight)))
    return df.withColumn(name, expr.otherwise(F.lit(1.0)))


def params_json(params: dict) -> str:
    return json.dumps(params, sort_keys=True)
