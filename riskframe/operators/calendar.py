"""Distance to the nearest holidays as an equi-join with a day calendar.

The calendar has one row per day between the first and the last holiday (some thousand rows,
whatever the size of the facts); days outside it follow from its two ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from riskframe.functions.clean import _col
from riskframe.functions.dates import is_weekend
from riskframe.functions.fixed import NEAR_HOLIDAY_DAYS, NO_HOLIDAY_DAYS
from riskframe.session import settle


def holiday_calendar(holidays: DataFrame, column: str = "holiday_date") -> DataFrame:
    """Rows (day, prev_holiday, next_holiday, after_holiday) from the first holiday to the day
    after the last."""
    order = Window.orderBy("day")  # over holidays only
    dates = holidays.select(F.col(column).cast("date").alias("day")).filter("day is not null").distinct()
    spans = dates.withColumn("following", F.lead("day").over(order))
    last_day = F.coalesce(F.date_sub("following", 1), F.date_add("day", 1))
    days = spans.select(
        F.col("day").alias("prev_holiday"), "following",
        F.explode(F.sequence("day", last_day)).alias("day"),
    )
    is_holiday = F.col("day") == F.col("prev_holiday")
    before = F.lag(is_holiday).over(order)
    return days.select(
        "day", "prev_holiday",
        F.when(is_holiday, F.col("day")).otherwise(F.col("following")).alias("next_holiday"),
        F.coalesce(before, F.lit(False)).alias("after_holiday"),
    )


def add_holiday_features(df: DataFrame, date: str, holidays: DataFrame) -> DataFrame:
    """Add days_to_next_holiday, days_from_prev_holiday, near_holiday and
    is_surgery_after_holiday_weekend for a date or timestamp column.

    A holiday on the day itself counts as distance 0 on both sides. Without a date, or without
    a holiday on that side, the distance is 999. With no holidays at all the flags are false.
    """
    calendar, small = settle(holiday_calendar(holidays))
    ends = calendar.agg(
        F.struct(F.min("day").alias("first"), F.max("prev_holiday").alias("last")).alias("ends")
    ).scalar()
    if small:
        calendar = F.broadcast(calendar)
    day = F.to_date(_col(date))
    joined = df.withColumn("__day", day).join(
        calendar.withColumnRenamed("day", "__calendar_day"),
        F.col("__day") == F.col("__calendar_day"), "left",
    )
    here = F.col("__day")
    upcoming = F.coalesce(F.col("next_holiday"), F.when(here < ends["first"], ends["first"]))
    passed = F.coalesce(F.col("prev_holiday"), F.when(here > ends["last"], ends["last"]))
    to_next = F.coalesce(F.datediff(upcoming, here), F.lit(NO_HOLIDAY_DAYS))
    from_prev = F.coalesce(F.datediff(here, passed), F.lit(NO_HOLIDAY_DAYS))
    after = F.coalesce(F.col("after_holiday"), F.lit(False)) | (
        ends["first"].isNotNull() & is_weekend(F.date_sub(here, 1))
    )
    return joined.withColumns({
        "days_to_next_holiday": to_next.cast("double"),
        "days_from_prev_holiday": from_prev.cast("double"),
        "near_holiday": F.least(to_next, from_prev) <= NEAR_HOLIDAY_DAYS,
        "is_surgery_after_holiday_weekend": after,
    }).drop("__day", "__calendar_day", "prev_holiday", "next_holiday", "after_holiday")
