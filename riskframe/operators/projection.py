"""Column selection, renaming, previews."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType, StringType

from riskframe.functions.text import is_blank


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by dictionary; names that are absent are ignored."""
    return df.withColumnsRenamed(dict(names))


def existing(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def select_existing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*existing(df, columns))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def non_numeric_columns(df: DataFrame) -> list[str]:
    numeric = set(numeric_columns(df))
    return [c for c in df.columns if c not in numeric]


def first_texts(df: DataFrame, column: str, key: str, n: int = 5) -> DataFrame:
    """The first non-blank texts in key order."""
    return df.filter(~is_blank(column)).select(key, column).orderBy(key).limit(n)


def preview(df: DataFrame, columns: Sequence[str], key: str, n: int = 5) -> DataFrame:
    """Selected columns of the first rows in key order."""
    return select_existing(df, columns).orderBy(F.col(key)).limit(n)


def melt(
    df: DataFrame, values: Mapping[str, Column], name: str, by: Sequence[str] = (), value: str = "value"
) -> DataFrame:
    """Several expressions of one type as rows (by..., name, value), one per expression and row.
    The rows are expanded in place, for an aggregation to shrink them again before a shuffle."""
    named = {f"__melt_{k}": expr for k, expr in values.items()}
    wide = df.select(*by, *[expr.alias(k) for k, expr in named.items()])
    return wide.unpivot(list(by), list(named), "__name", value).select(
        *by, F.substring("__name", 8, 1_000).alias(name), value
    )
