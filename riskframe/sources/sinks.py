"""Sinks for engineered tables, matrices, sweeps, metrics, models and fitted tables."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.operators.encode import Preprocessor
from riskframe.session import set_for_now

#: Folders a writing task has open files in at once; beyond that Spark sorts the rest of its rows.
OPEN_FILES = 16


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()) -> str:
    writer = df.write.mode(mode)
    if not partition_by:
        writer.parquet(path)
        return path
    # a task keeps a file open per folder; otherwise it would sort its rows, wide as they are, and spill them
    with set_for_now(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", OPEN_FILES):
        writer.partitionBy(*partition_by).parquet(path)
    return path


def write_matrix(df: DataFrame, path: str, part: str = "is_test") -> str:
    """Feature vectors with key and label, one folder per part, so that reading the training
    rows touches no test file."""
    return write_table(df, path, partition_by=[part] if part in df.columns else [])


def read_matrix(spark: SparkSession, path: str, test: bool | None = None, part: str = "is_test") -> DataFrame:
    df = spark.read.parquet(path)
    return df if test is None else df.filter(F.col(part) == F.lit(test)).drop(part)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_metrics(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def write_params(spark: SparkSession, params: Mapping[str, object], path: str) -> str:
    """Best parameters as one JSON row."""
    row = spark.createDataFrame([(json.dumps(dict(params), sort_keys=True),)], "value string")
    row.write.mode("overwrite").text(path)
    return path


def read_params(spark: SparkSession, path: str) -> dict[str, object]:
    return json.loads(spark.read.text(path).first()["value"])


def save_model(model: MLWritable, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def save_preprocessor(fitted: Preprocessor, path: str) -> str:
    """Fitted tables as Parquet, column lists as JSON."""
    write_table(fitted.params, f"{path}/params")
    write_table(fitted.vocab, f"{path}/vocab")
    lists = {"numeric": fitted.numeric, "categorical": fitted.categorical,
             "small": fitted.small, "drop_empty": fitted.drop_empty}
    write_params(fitted.params.sparkSession, lists, f"{path}/columns")
    return path


def load_preprocessor(spark: SparkSession, path: str) -> Preprocessor:
    lists = read_params(spark, f"{path}/columns")
    return Preprocessor(
        params=spark.read.parquet(f"{path}/params"), vocab=spark.read.parquet(f"{path}/vocab"), **lists
    )
