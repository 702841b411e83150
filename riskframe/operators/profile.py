"""Profiles of a table: shape, duplicates, missing values, descriptive statistics, rates.

Each profile reads the table once for all its columns and returns a table in long form. NaN counts as
missing everywhere, and 0.0 and -0.0 are one value.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.functions.bins import ratio
from riskframe.functions.clean import flag_or_false, nan_to_null, outside, present
from riskframe.functions.fixed import MISSING
from riskframe.operators.joins import attach
from riskframe.operators.projection import melt
from riskframe.operators.ranks import quantiles
from riskframe.session import settle

QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


def unfold(df: DataFrame, columns: Sequence[str], stats: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """A wide aggregate with columns ``stat__column`` as rows (by..., column, stats...)."""
    cells = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{s}__{c}`").alias(s) for s in stats])
        for c in columns
    ]
    return df.select(*by, F.explode(F.array(*cells)).alias("cell")).select(*by, "cell.*")


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("columns"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Non-null distinct values per column: rows (column, n_distinct)."""
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(present(df, c)).alias(f"n_distinct__{c}") for c in columns])
        return unfold(wide, columns, ["n_distinct"])
    return (
        melt(df, {c: present(df, c).cast("string") for c in columns}, "column").distinct()
        .groupBy("column").agg(F.count("value").alias("n_distinct"))
    )


def log_counts(log: DataFrame, key: str) -> DataFrame:
    return log.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("distinct_keys"))


def row_groups(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("copies"))


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Rows, distinct rows, rows a de-duplication removes, rows in duplicate groups."""
    copies = F.col("copies")
    total = F.coalesce(F.sum("copies"), F.lit(0))
    return row_groups(df).agg(
        total.alias("rows"),
        F.count("*").alias("distinct_rows"),
        (total - F.count("*")).alias("removed_rows"),
        F.coalesce(F.sum(F.when(copies > 1, copies)), F.lit(0)).alias("duplicate_members"),
    )


def duplicate_groups(df: DataFrame) -> DataFrame:
    """Each row that occurs more than once, one time, with its number of copies."""
    return row_groups(df).filter("copies > 1")


def duplicate_members(df: DataFrame) -> DataFrame:
    """Every row that has an identical twin. Nulls count as equal."""
    groups, small = settle(duplicate_groups(df).drop("copies"))
    return attach(df, groups, df.columns, small, null_safe=True, how="left_semi")


def multi_event_keys(log: DataFrame, key: str) -> DataFrame:
    """Keys with more than one distinct log row, with their number of distinct rows."""
    events = log.distinct().groupBy(key).agg(F.count("*").alias("events"))
    return events.filter((F.col("events") > 1) & F.col(key).isNotNull())


def multi_event_rows(log: DataFrame, key: str) -> DataFrame:
    """Distinct log rows of the keys that have more than one."""
    return attach(log.distinct(), multi_event_keys(log, key).select(key), [key], how="left_semi")


def multi_event_summary(log: DataFrame, key: str) -> DataFrame:
    return multi_event_keys(log, key).agg(
        F.count("*").alias("keys"), F.coalesce(F.sum("events"), F.lit(0)).alias("rows")
    )


def example_events(log: DataFrame, key: str, order: Sequence[str], keys: int = 3) -> DataFrame:
    """All distinct rows of the first few multi-event keys, ordered."""
    first = multi_event_keys(log, key).select(key).orderBy(key).limit(keys)
    return attach(log.distinct(), first, [key], how="left_semi").orderBy(key, *order)


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with missing values: count and percentage, highest first."""
    columns = list(columns or df.columns)
    missing = {c: F.count_if(present(df, c).isNull()) for c in columns}
    wide = df.agg(
        *[m.alias(f"missing__{c}") for c, m in missing.items()],
        *[(100 * ratio(m, F.count("*"))).alias(f"missing_pct__{c}") for c, m in missing.items()],
    )
    found = unfold(wide, columns, ["missing", "missing_pct"]).filter("missing > 0")
    return found.orderBy(F.col("missing_pct").desc(), "column")


def schema_profile(df: DataFrame) -> DataFrame:
    """Columns with type and number of non-null values."""
    wide = df.agg(
        *[F.lit(kind).alias(f"dtype__{c}") for c, kind in df.dtypes],
        *[F.count(present(df, c)).alias(f"non_null__{c}") for c in df.columns],
    )
    return unfold(wide, df.columns, ["dtype", "non_null"])


def all_null_after_coercion(df: DataFrame, coerced: Mapping[str, Column]) -> DataFrame:
    """Columns that lose every value when coerced: rows (column, before, after, became_empty)."""
    wide = df.agg(
        *[F.count(c).alias(f"before__{c}") for c in coerced],
        *[F.count(expr).alias(f"after__{c}") for c, expr in coerced.items()],
    )
    counts = unfold(wide, list(coerced), ["before", "after"])
    return counts.withColumn("became_empty", (F.col("before") > 0) & (F.col("after") == 0))


def target_rate(df: DataFrame, target: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"),
        F.sum(F.col(target).cast("int")).alias("positives"),
        F.avg(F.col(target).cast("int")).alias("rate"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Non-null values by descending count."""
    counts = df.select(present(df, column).alias(column)).dropna().groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), column)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Non-null values with count and share of the non-null rows."""
    total = df.select(F.count(present(df, column))).scalar()
    counts = value_counts(df, column)
    return counts.withColumn("share", F.col("n") / total)


def imbalance_ratio(df: DataFrame, target: str) -> DataFrame:
    """Smallest class over largest class."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    return counts.agg(
        F.min("n").alias("smallest"), F.max("n").alias("largest"),
        ratio(F.min("n"), F.max("n")).alias("imbalance"),
    )


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (n-1), min, exact quartiles and max per column and group, long form."""
    stats = {
        "count": lambda v: F.count(v).cast("double"), "mean": F.avg, "std": F.stddev_samp,
        "min": F.min, "max": F.max,
    }
    wide = df.groupBy(*by).agg(*[
        stat(nan_to_null(c)).alias(f"{name}__{c}") for name, stat in stats.items() for c in columns
    ])
    group = [*by, "column"]
    moments = unfold(wide, columns, list(stats), by).unpivot(group, list(stats), "stat", "value")
    names = F.create_map(*[F.lit(x) for name, s in QUARTILES.items() for x in (float(s), name)])
    quartiles = quantiles(df, columns, list(QUARTILES.values()), by).select(
        *group, F.element_at(names, F.col("share")).alias("stat"), "value"
    )
    return moments.unionByName(quartiles)


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, maximum and mean per column."""
    stats = {"min": F.min, "max": F.max, "mean": F.avg}
    wide = df.agg(*[
        stat(nan_to_null(c)).alias(f"{name}__{c}") for name, stat in stats.items() for c in columns
    ])
    return unfold(wide, columns, list(stats))


def rate_by_category(
    df: DataFrame, column: str, target: str, missing: str | None = None
) -> DataFrame:
    """Target rate and rows per category, most frequent first. Nulls form their own group,
    under the name ``missing`` where one is given."""
    value = F.col(column) if missing is None else F.coalesce(F.col(column), F.lit(missing))
    return (
        df.groupBy(value.alias(column))
        .agg(F.avg(F.col(target).cast("int")).alias("rate"), F.count(target).alias("n"))
        .orderBy(F.col("n").desc(), F.col("rate").desc(), column)
    )


def rate_by_flag(df: DataFrame, flags: Sequence[str], target: str) -> DataFrame:
    """Target rate and rows for both values of several flags; a missing flag counts as false."""
    rows = df.withColumn("__y", F.col(target).cast("int"))
    long = melt(rows, {f: flag_or_false(f) for f in flags}, "flag", ["__y"])
    return long.groupBy("flag", "value").agg(F.avg("__y").alias("rate"), F.count("__y").alias("n"))


def rate_profile(
    df: DataFrame, columns: Sequence[str], target: str,
    full_up_to: int = 50, top: int = 20, high_cardinality: Sequence[str] = (), high_top: int = 15,
) -> DataFrame:
    """Rate by value for many columns: all values of a column with few, the most frequent of a
    column with many. Columns named in ``high_cardinality`` are shown in full only up to
    ``high_top`` values.

    A per-column top-k needs at most ``max(full_up_to, top)`` rows per column; the rank filter
    is applied before the shuffle, so no task sees all values of a column.
    """
    rows = df.withColumn("__y", F.col(target).cast("int"))
    values = {c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING)) for c in columns}
    rates = (
        melt(rows, values, "column", ["__y"]).groupBy("column", "value")
        .agg(F.avg("__y").alias("rate"), F.count("*").alias("n"))
    )
    rates, _ = settle(rates)  # read twice below
    sizes = F.broadcast(rates.groupBy("column").agg(F.count("*").alias("n_distinct")))  # one row per column
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("rate").desc(), "value")
    ranked = rates.withColumn("place", F.row_number().over(order))
    shown = ranked.filter(F.col("place") <= max(full_up_to, top, high_top))
    special = F.col("column").isin(list(high_cardinality)) if high_cardinality else F.lit(False)
    limit = (
        F.when(special & (F.col("n_distinct") > high_top), F.lit(high_top))
        .when(~special & (F.col("n_distinct") > full_up_to), F.lit(top))
        .otherwise(F.col("n_distinct"))
    )
    return shown.join(sizes, "column").filter(F.col("place") <= limit)


def out_of_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.agg(
        F.count(column).alias("present"), F.count_if(outside(column, low, high)).alias("out_of_range")
    )


def cohort_compare(df: DataFrame, member: Column, metrics: Mapping[str, Column]) -> DataFrame:
    """Mean of each metric among cohort members and over all rows."""
    wide = df.agg(
        *[F.avg(F.when(member, m)).alias(f"cohort__{name}") for name, m in metrics.items()],
        *[F.avg(m).alias(f"overall__{name}") for name, m in metrics.items()],
    )
    return unfold(wide, list(metrics), ["cohort", "overall"]).withColumnRenamed("column", "metric")


def readiness(df: DataFrame, dimension: str) -> DataFrame:
    """One row: rows, columns, columns with nulls, the worst of them, range of a dimension."""
    missing = [F.struct(F.count_if(present(df, c).isNull()).alias("missing"), F.lit(c).alias("name")) for c in df.columns]
    facts = df.agg(
        F.count("*").alias("rows"), F.array(*missing).alias("missing"),
        F.min(present(df, dimension)).alias("dimension_min"), F.max(present(df, dimension)).alias("dimension_max"),
    )
    incomplete = F.filter("missing", lambda m: m["missing"] > 0)
    worst = F.element_at(F.array_sort(incomplete, lambda a, b: (
        F.when(a["missing"] > b["missing"], -1).when(a["missing"] < b["missing"], 1)
        .when(a["name"] < b["name"], -1).otherwise(1)
    )), 1)
    return facts.select(
        "rows", F.lit(len(df.columns)).alias("columns"),
        F.size(incomplete).alias("incomplete_columns"),
        F.when(F.size(incomplete) > 0, worst["name"]).alias("worst_column"),
        F.when(F.size(incomplete) > 0, 100 * worst["missing"] / F.col("rows")).alias("worst_pct"),
        "dimension_min", "dimension_max",
    )


def horizontal_present(columns: Sequence[str]) -> Column:
    """Number of present values among several columns of a row; NaN, also as text, is none."""
    total = F.lit(0)
    for c in columns:
        total = total + F.coalesce(F.col(c).cast("string") != "NaN", F.lit(False)).cast("int")
    return total.cast("long")


def mark_best(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """For each metric add a boolean: does the row hold its maximum?"""
    top = df.agg(F.struct(*[F.max(m).alias(m) for m in metrics]).alias("top")).scalar()
    return df.withColumns({f"best_{m}": F.coalesce(F.col(m) == top[m], F.lit(False)) for m in metrics})


