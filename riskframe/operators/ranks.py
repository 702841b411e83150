"""Exact order statistics and prefix sums over data that fits in no single task.

Both rest on chunks: ranges of the value that hold about equally many rows, cut at points from
an approximate-percentile sketch. A chunk is a pure function of the value, so it is the same
after a task is retried, and only within a chunk is anything sorted. The cut points steer how
the work is spread, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.functions.bins import number_array, with_position
from riskframe.functions.clean import nan_to_null
from riskframe.operators.projection import melt
from riskframe.session import SMALL_ROWS, parallelism, settle, stage


#: Sketches hold at most ten times as many entries per column, whatever the cluster.
MAX_CHUNKS = 512


def chunk_count(df: DataFrame) -> int:
    """Number of chunks: some per shuffle task, so that chunks shrink as the cluster grows, but no
    more than MAX_CHUNKS, since every task's sketch (10 entries per chunk) goes to one merge."""
    return min(MAX_CHUNKS, max(64, 4 * parallelism(df.sparkSession)))


def cut_points(column: Column, chunks: int) -> Column:
    """Ascending cut points of a column, as an aggregate."""
    shares = number_array([i / chunks for i in range(1, chunks)])
    return F.percentile_approx(column, shares, F.lit(10 * chunks))


def with_chunk(df: DataFrame, column: str, name: str, chunks: int, of: DataFrame | None = None) -> DataFrame:
    """Add the chunk number of a column; the cut points come from the rows of ``of`` (or df).

    They are settled first: computed once, they cannot differ between two passes.
    """
    source = df if of is None else of
    cuts, _ = settle(source.agg(cut_points(F.col(column), chunks).alias("cuts")))
    return with_position(df, {name: (column, cuts.scalar())}, chunks)


# --- order statistics: count per chunk, locate ranks, resolve -------------------------


def count_chunks(long: DataFrame, group: Sequence[str]) -> tuple[DataFrame, bool]:
    """Rows per group and chunk with the rows before it and the group's total, and whether that
    table is small. One pass; the result has at most groups x chunks rows."""
    counted, small = settle(long.groupBy(*group, "chunk").agg(F.count("*").alias("cnt")))
    running = Window.partitionBy(*group).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumns({
        "before": F.coalesce(F.sum("cnt").over(running), F.lit(0)),
        "n": F.sum("cnt").over(Window.partitionBy(*group)),
    }), small


def locate(counted: DataFrame, ranks: Column) -> DataFrame:
    """Chunks that hold a wanted rank. ``ranks`` is an array of structs (id, rank), ranks from 1."""
    inside = F.filter(ranks, lambda r: (r["rank"] > F.col("before")) & (r["rank"] <= F.col("before") + F.col("cnt")))
    return counted.withColumn("wanted", inside).filter(F.size("wanted") > 0).drop("cnt")


def resolve(long: DataFrame, group: Sequence[str], located: DataFrame, small: bool) -> DataFrame:
    """Values at the located ranks: rows (group..., id, rank, n, value). Only the values of the
    located chunks are shuffled, equal ones merged."""
    keys = [*group, "chunk"]
    targets = located.withColumnsRenamed({k: f"__{k}" for k in keys})
    match = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        match = same if match is None else match & same
    send = F.broadcast if small else (lambda d: d)
    in_order = Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    last, first = F.col("before") + F.col("upto"), F.col("before") + F.col("upto") - F.col("cnt")
    return (
        long.join(send(targets.select(*[f"__{k}" for k in keys])), match, "left_semi")
        .groupBy(*keys, "value").agg(F.count("*").alias("cnt"))
        .withColumn("upto", F.sum("cnt").over(in_order))
        .join(send(targets), match)
        .withColumn("hit", F.explode(F.filter("wanted", lambda r: (r["rank"] > first) & (r["rank"] <= last))))
        .select(*group, "hit.id", "hit.rank", "n", "value")
    )


def long_form(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Non-null numbers as rows (by..., column_no, value)."""
    long = melt(df, {str(i): nan_to_null(c) for i, c in enumerate(columns)}, "column_no", by)
    return long.withColumn("column_no", F.col("column_no").cast("int")).filter(F.col("value").isNotNull())


def quantiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation: rows (by..., column, share, value).

    Three narrow passes: sketch the cut points of each column, count the values per chunk, then
    sort the few chunks that hold a wanted rank.
    """
    chunks = chunk_count(df)
    # an array of cut points per column, in column order; null for a column without values
    sketch, _ = settle(df.agg(F.array(*[cut_points(nan_to_null(c), chunks) for c in columns]).alias("cuts")))
    cuts = F.get(sketch.scalar(), F.col("column_no"))
    long = with_position(long_form(df, columns, by), {"chunk": ("value", cuts)}, chunks)
    group = [*by, "column_no"]
    counted, small = count_chunks(long, group)
    located = locate(counted, _quantile_ranks(shares))
    return _interpolate(resolve(long, group, located, small), columns, shares, by)


def pick_from_counts(counts: DataFrame, group: Sequence[str], ranks: Column) -> DataFrame:
    """Values at the wanted ranks from rows (group..., value, cnt), few per group."""
    in_order = Window.partitionBy(*group).orderBy("value")
    counted = counts.withColumns({
        "upto": F.sum("cnt").over(in_order.rowsBetween(Window.unboundedPreceding, 0)),
        "n": F.sum("cnt").over(Window.partitionBy(*group)),
    })
    last, first = F.col("upto"), F.col("upto") - F.col("cnt")
    hits = F.filter(ranks, lambda r: (r["rank"] > first) & (r["rank"] <= last))
    return counted.withColumn("hit", F.explode(hits)).select(*group, "hit.id", "n", "value")


def _quantile_ranks(shares: Sequence[float]) -> Column:
    """For each share the ranks below and above its place among ``n`` values; ids 2i and 2i+1."""
    wanted = []
    for i, share in enumerate(shares):
        place = (F.col("n") - 1) * F.lit(float(share))
        for side, rank in ((0, F.floor(place)), (1, F.ceil(place))):
            wanted.append(F.struct(F.lit(2 * i + side).alias("id"), (rank + 1).cast("long").alias("rank")))
    return F.array(*wanted)


def _interpolate(picked: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("column_no"))
    share = F.get(F.array(*[F.lit(float(s)) for s in shares]), F.floor(F.col("id") / 2).cast("int"))
    low = F.min("value")
    place = (F.first("n") - 1) * F.col("share")
    return (
        picked.select(*by, name.alias("column"), share.alias("share"), "n", "value")
        .groupBy(*by, "column", "share")
        .agg((low + (F.max("value") - low) * (place - F.floor(place))).alias("value"))
    )


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median of each column (null for an empty column)."""
    found = quantiles(df, columns, [0.5])
    return found.agg(*[
        F.max(F.when(F.col("column") == c, F.col("value"))).alias(c) for c in columns
    ])


def median_of_counts(counts: DataFrame) -> DataFrame:
    """One row with the median of few different values, given as rows (value, cnt)."""
    rows = counts.filter("value is not null").withColumn("column_no", F.lit(0))
    picked = pick_from_counts(rows, ["column_no"], _quantile_ranks([0.5]))
    return _interpolate(picked, ["median"], [0.5], []).select(F.col("value").alias("median"))


# --- prefix sums ----------------------------------------------------------------------


def prefix_sums(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    totals: dict[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    following: dict[str, str] | None = None,
) -> DataFrame:
    """Running sums by an order column that is unique within ``by``, without one big sort.

    ``sums`` maps a value column to the name of its running total (own row included),
    ``totals`` to the name of its overall total, ``following`` to the name of its value in the
    next row. ``df`` is an aggregate; it is written to the shared folder once and read from
    there. What a chunk needs to know of the others comes from a table with one row per chunk
    and group; a table that is small as a whole is one chunk.
    """
    following = following or {}
    df = stage(df)
    if df.count() <= SMALL_ROWS:
        placed = df.withColumn("__chunk", F.lit(0))
    else:
        placed = with_chunk(df, order, "__chunk", chunk_count(df))
    sort = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    first_by = F.max_by if descending else F.min_by

    per_chunk = placed.groupBy(*by, "__chunk").agg(
        *[F.sum(v).alias(f"__t_{v}") for v in {**sums, **totals}],
        *[first_by(v, order).alias(f"__f_{v}") for v in following],
    )
    over_chunks = Window.partitionBy(*by).orderBy(sort("__chunk"))
    earlier = over_chunks.rowsBetween(Window.unboundedPreceding, -1)
    others = per_chunk.select(
        *by, "__chunk",
        *[F.coalesce(F.sum(f"__t_{v}").over(earlier), F.lit(0)).alias(f"__o_{v}") for v in sums],
        *[F.sum(f"__t_{v}").over(Window.partitionBy(*by)).alias(name) for v, name in totals.items()],
        *[F.lead(f"__f_{v}").over(over_chunks).alias(f"__n_{v}") for v in following],
    )
    if not by:
        others = F.broadcast(others)  # at most one row per chunk
    in_order = Window.partitionBy(*by, "__chunk").orderBy(sort(order))
    upto = in_order.rowsBetween(Window.unboundedPreceding, 0)
    within = placed.withColumns({
        **{f"__s_{v}": F.sum(v).over(upto) for v in sums},
        **{f"__l_{v}": F.lead(v).over(in_order) for v in following},
    })
    joined = within.join(others, [*by, "__chunk"], "left")
    return joined.select(
        *df.columns, *totals.values(),
        *[(F.col(f"__o_{v}") + F.col(f"__s_{v}")).alias(name) for v, name in sums.items()],
        *[F.coalesce(f"__l_{v}", f"__n_{v}").alias(name) for v, name in following.items()],
    )
