"""Text expressions: list counts, composite keys, report fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskframe.functions.clean import _col, strip, text_or
from riskframe.functions.fixed import NULL_TEXT


def is_blank(c: Column | str) -> Column:
    col = _col(c)
    return col.isNull() | (strip(col) == "")


def count_items(c: Column | str) -> Column:
    """Number of comma-separated items; blank text has none, empty segments count."""
    col = _col(c)
    commas = F.length(col) - F.length(F.replace(col, F.lit(","), F.lit("")))
    return F.when(is_blank(col), F.lit(0)).otherwise(commas + 1).cast("long")


def joined(*cols: Column | str, sep: str = "_", null_token: str = NULL_TEXT) -> Column:
    """Columns as one text with a separator; nulls are spelled out, never skipped."""
    parts: list[Column] = []
    for c in cols:
        if parts:
            parts.append(F.lit(sep))
        parts.append(text_or(c, null_token))
    return F.concat(*parts)


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"(?U)\s+", " ")


def mark_trailing_number(c: Column | str) -> Column:
    """Separate a number at the end of the text with an underscore."""
    return F.regexp_replace(_col(c), r"(?U)\s*(\d+)$", "_$1")


def site_room(site: Column | str, room: Column | str) -> Column:
    """Composite place name: joined, spaces collapsed, trailing number marked."""
    return mark_trailing_number(strip(collapse_spaces(joined(site, room))))


def slug(c: Column | str) -> Column:
    """Lower-case name with underscores, as used in column and file names."""
    return F.lower(F.replace(_col(c), F.lit(" "), F.lit("_")))


def captured_number(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First capture of ``pattern`` as double; null where the pattern is absent."""
    return F.nullif(F.regexp_extract(_col(c), pattern, group), F.lit("")).try_cast("double")


def section(c: Column | str, pattern: str, group: int = 1) -> Column:
    """Capture of a multi-line ``pattern``; null where it is absent."""
    return F.nullif(strip(F.regexp_extract(_col(c), pattern, group)), F.lit(""))
