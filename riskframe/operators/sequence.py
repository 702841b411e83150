"""Order of events within a key: gaps to the previous event and running numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from riskframe.functions.dates import elapsed_days
from riskframe.operators.joins import HOT_ROWS, HOT_SHARE, hot_keys
from riskframe.operators.ranks import chunk_count, with_chunk


def with_sequence(
    events: DataFrame, keys: Sequence[str], time: str, tie: Sequence[str],
    share: float = HOT_SHARE, min_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add ``event_no`` (from 1), ``previous_time`` and ``days_since_last`` per key.

    Events without a time come last. Keys that hold a large share of the events are cut into
    chunks of time: the window works per (key, chunk), and the few chunk totals of those keys
    are carried forward. The ordered columns (time, tie) should be unique within a key.
    """
    hot = hot_keys(events, keys, share, min_rows)
    if hot:
        chunks = chunk_count(events)
        is_hot = F.xxhash64(*keys).isin(hot)
        events = with_chunk(events, time, "__chunk", chunks)
        events = events.withColumn("__chunk", F.when(
            is_hot, F.coalesce(F.col("__chunk"), F.lit(chunks))  # no time: after all chunks
        ).otherwise(F.lit(-1)))
    else:
        events = events.withColumn("__chunk", F.lit(-1))
    inside = Window.partitionBy(*keys, "__chunk").orderBy(
        F.col(time).asc_nulls_last(), *[F.col(t).asc_nulls_last() for t in tie]
    )
    numbered = events.withColumns({
        "__no": F.row_number().over(inside).cast("long"), "__before": F.lag(time).over(inside),
    })
    if hot:
        numbered = _carry(events.filter(F.col("__chunk") >= 0), numbered, keys, time)
    else:
        numbered = numbered.withColumnsRenamed({"__no": "event_no", "__before": "previous_time"})
    return numbered.withColumn("days_since_last", elapsed_days(time, "previous_time")).drop("__chunk")


def _carry(hot_events: DataFrame, numbered: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Add event counts and the last time of earlier chunks. The table of chunk totals has at
    most (hot keys) x (chunks) rows, both bounded, so it may be broadcast."""
    earlier = (
        Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    totals = (
        hot_events.groupBy(*keys, "__chunk").agg(F.count("*").alias("__n"), F.max(time).alias("__last"))
        .select(
            *[F.col(k).alias(f"__right_{k}") for k in keys],
            F.col("__chunk").alias("__right_chunk"),
            F.sum("__n").over(earlier).alias("__offset"),
            F.max("__last").over(earlier).alias("__carried"),
        )
    )
    match = F.col("__chunk") == F.col("__right_chunk")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__right_{k}"))
    joined = numbered.join(F.broadcast(totals), match, "left")
    first = F.col("__no") == 1
    return joined.withColumns({
        "event_no": F.col("__no") + F.coalesce("__offset", F.lit(0)),
        "previous_time": F.when(first, F.col("__carried")).otherwise(F.col("__before")),
    }).drop("__no", "__before", "__offset", "__carried", "__right_chunk", *[f"__right_{k}" for k in keys])


def events_per_key(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Highest event number, that is the number of events, per key."""
    return events.groupBy(*keys).agg(F.count("*").alias("events"))
