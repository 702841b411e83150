"""Cleaning expressions: coercion, null tokens, replacement, clipping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.fixed import MISSING, NULL_TEXT, NULL_TEXT_NULLABLE, WHITE_SPACE

_NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing white space, Unicode spaces and tabs included."""
    return F.trim(_col(c), F.lit(WHITE_SPACE))


def key_text(c: Column | str, null_token: str = NULL_TEXT) -> Column:
    """Text form of a key: null becomes ``null_token``, the rest is stripped."""
    return strip(F.coalesce(_col(c).cast("string"), F.lit(null_token)))


def text_or(c: Column | str, null_token: str = NULL_TEXT) -> Column:
    """Text form without stripping: null becomes ``null_token``."""
    return F.coalesce(_col(c).cast("string"), F.lit(null_token))


def to_number(c: Column | str) -> Column:
    """Text to double; whatever is not a number (NaN included) is null."""
    text = _col(c).cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def nan_to_null(c: Column | str) -> Column:
    """A numeric column as double in which NaN counts as missing."""
    value = _col(c).cast("double")
    return F.when(~F.isnan(value), value)


def present(df: DataFrame, c: str) -> Column:
    """A column in its own type in which NaN counts as missing and -0.0 is 0.0."""
    value = F.col(f"`{c}`")
    if dict(df.dtypes)[c] not in ("float", "double"):
        return value
    return F.when(~F.isnan(value), value + F.lit(0.0).cast(dict(df.dtypes)[c]))


def to_timestamp(c: Column | str) -> Column:
    """Coerce to a zone-free timestamp; unreadable text is null."""
    return _col(c).try_cast("timestamp_ntz")


def flag_to_int(c: Column | str) -> Column:
    return _col(c).cast("boolean").cast("int")


def flag_or_false(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("boolean"), F.lit(False))


def fill(c: Column | str, value: object) -> Column:
    return F.coalesce(_col(c), value if isinstance(value, Column) else F.lit(value))


def category(c: Column | str, missing: str = MISSING) -> Column:
    """Category text for modelling: null and the literal null texts become ``missing``."""
    text = _col(c).cast("string")
    nulls = [NULL_TEXT, NULL_TEXT_NULLABLE]
    return F.when(text.isNull() | text.isin(nulls), F.lit(missing)).otherwise(text)


def replace_values(c: Column | str, values: Sequence[object], replacement: object) -> Column:
    col = _col(c)
    return F.when(col.isin(list(values)), F.lit(replacement)).otherwise(col)


def clip(c: Column | str, low: float, high: float) -> Column:
    """Limit to [low, high]; null stays null."""
    col = _col(c)
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def outside(c: Column | str, low: float, high: float) -> Column:
    """True where a present value lies outside [low, high]."""
    col = _col(c)
    return col.isNotNull() & ((col < low) | (col > high))


def masked(mask: Column, value: object, c: Column | str) -> Column:
    """``value`` where ``mask`` holds, the column elsewhere."""
    return F.when(mask, value if isinstance(value, Column) else F.lit(value)).otherwise(_col(c))
