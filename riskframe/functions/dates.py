"""Date expressions: elapsed days and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from riskframe.functions.clean import _col
from riskframe.functions.fixed import DAY_NAMES, SEASON_OF_MONTH, WEEKEND_DAYS


def elapsed_days(later: Column | str, earlier: Column | str) -> Column:
    """Whole days between two timestamps, floored: one hour back is day -1.

    Works on the interval itself, so neither the session zone nor daylight saving plays in.
    """
    gap = _col(later) - _col(earlier)
    whole = F.extract(F.lit("DAY"), gap)
    short = F.make_dt_interval(whole) > gap
    return (whole - F.when(short, F.lit(1)).otherwise(F.lit(0))).cast("long")


def day_name(c: Column | str) -> Column:
    """English name of the weekday."""
    return F.get(F.array(*[F.lit(d) for d in DAY_NAMES]), F.weekday(_col(c)))


def season(c: Column | str) -> Column:
    names = F.array(*[F.lit(SEASON_OF_MONTH[m]) for m in range(1, 13)])
    return F.get(names, F.month(_col(c)) - 1)


def is_weekend(c: Column | str) -> Column:
    """Friday or Saturday; false for a missing date."""
    days = [DAY_NAMES.index(d) for d in WEEKEND_DAYS]
    return F.coalesce(F.weekday(_col(c)).isin(days), F.lit(False))


def decade(c: Column | str) -> Column:
    """Lower bound of the ten-year band, floored also below zero."""
    return (F.floor(_col(c) / 10) * 10).cast("long")
