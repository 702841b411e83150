"""Scans: tables by name, first available table, schema checks."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType,
)

from riskframe.functions.fixed import LAB_COLUMNS


def _struct(text: Sequence[str] = (), numbers: Sequence[str] = (), times: Sequence[str] = (), longs: Sequence[str] = ()) -> StructType:
    fields = [(n, StringType()) for n in text] + [(n, TimestampNTZType()) for n in times]
    fields += [(n, DoubleType()) for n in numbers] + [(n, LongType()) for n in longs]
    return StructType([StructField(n, t, True) for n, t in fields])


PLANS = _struct(
    text=[
        "plan_id", "patient_id", "room", "anesthesia", "procedure_code", "surgery_site", "department",
        "bmi", "medications", "diagnoses", "city", "gender", "payer", "marital_status",
        "distance_km", "performed_plan_no",
    ],
    times=["request_date", "surgery_date"], numbers=["age", *LAB_COLUMNS], longs=["wait_days_source"],
)
CANCEL_LOG = _struct(text=["plan_id"], times=["cancel_date", "planned_date_at_cancel"])
CITY_DIM = _struct(text=["city", "cluster"])
HOLIDAYS = StructType([StructField("holiday_date", DateType())])
SCORED = StructType([
    StructField("key", StringType()), StructField("label", LongType()), StructField("score", DoubleType()),
])


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: StructType | None = None, **options: object
) -> DataFrame:
    """One table as Parquet, ORC, CSV or JSON. Give a schema for CSV and JSON: without one,
    text columns stay text instead of being guessed."""
    reader = spark.read.format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", True))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def read_tables(spark: SparkSession, directory: str, names: Sequence[str], fmt: str = "parquet") -> dict[str, DataFrame]:
    """Several tables of one folder, e.g. the facts and their event log."""
    return {n: read_table(spark, f"{directory}/{n}.{fmt}", fmt) for n in names}


def read_first_of(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """The first of several paths that can be read: a named table, or its stand-in."""
    failures = []
    for path in paths:
        try:
            return read_table(spark, path, fmt)
        except AnalysisException as error:
            failures.append(f"{path}: {error.getCondition()}")
    raise FileNotFoundError("; ".join(failures))


def require_columns(df: DataFrame, columns: Sequence[str], name: str = "table") -> DataFrame:
    """The table itself, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks columns {missing}; it has {df.columns}")
    return df


def holiday_table(spark: SparkSession, days: Sequence[date]) -> DataFrame:
    """A holiday calendar from a list of dates."""
    return spark.createDataFrame([(d,) for d in days], HOLIDAYS)


