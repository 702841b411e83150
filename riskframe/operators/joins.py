"""Joins on keys that may be skewed, lookups, and key-set operations.

A side is broadcast only after its rows and bytes have been counted (`session.settle`). Beyond
that size the join shuffles, and the few keys that hold a large share of the left side are salted:
their left rows are dealt over several tasks, their right row is repeated for each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.clean import key_text
from riskframe.session import settle

#: A key is hot from this share of the rows on, provided it also has HOT_ROWS rows.
HOT_SHARE = 1 / 500
HOT_ROWS = 200_000
#: Tasks over which the rows of a hot key are dealt.
SALTS = 32
_TRACKED = 10_000
_CANDIDATES = 1_000


def hot_keys(
    df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE, min_rows: int | None = None
) -> list[int]:
    """Hashes of the keys that hold a large share of the rows; at most 1/share of them."""
    return hot_keys_of(df, {"": keys}, share, min_rows)[""]


def hot_keys_of(
    df: DataFrame, keys: Mapping[str, Sequence[str | Column]], share: float = HOT_SHARE, min_rows: int | None = None
) -> dict[str, list[int]]:
    """Hashes of the hot keys for several key lists, by name.

    One pass over the key columns with frequent-items sketches, without a shuffle. The
    answer only steers how rows travel, never what is computed.
    """
    if not keys:
        return {}
    hashes = df.select(*[F.xxhash64(*k).alias(f"h{i}") for i, k in enumerate(keys.values())])
    row = hashes.agg(
        F.count("*").alias("n"),
        *[F.expr(f"approx_top_k(h{i}, {_CANDIDATES}, {_TRACKED})").alias(f"top{i}") for i in range(len(keys))],
    ).first()
    floor = max(HOT_ROWS if min_rows is None else min_rows, share * row["n"])
    return {
        name: [item["item"] for item in row[f"top{i}"] or [] if item["count"] >= floor] for i, name in enumerate(keys)
    }


def attach(
    df: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    small: bool | None = None,
    hot: Sequence[int] | None = None,
    null_safe: bool = False,
    how: str = "left",
) -> DataFrame:
    """Join the rows of ``df`` to a table with one row per key (``how``: left, inner, left_semi,
    left_anti).

    ``small`` is what `settle` said about the table; None settles it here. A large table is
    joined by shuffle. The rows of hot keys (at most 1 / HOT_SHARE keys; ``hot`` gives their
    hashes if they are known) get one of SALTS salts from a hash of the row, so no task receives
    all of them; the table's row of such a key is repeated per salt. ``df`` is read once either way.
    """
    if small is None:
        table, small = settle(table)
    renamed = {k: f"__right_{k}" for k in keys}
    right = table.withColumnsRenamed(renamed)
    compare = Column.eqNullSafe if null_safe else Column.__eq__
    condition = reduce(Column.__and__, [compare(F.col(a), F.col(b)) for a, b in renamed.items()])

    def joined(left: DataFrame, part: DataFrame) -> DataFrame:
        return left.join(part, condition, how).drop(*renamed.values())

    if small:
        return joined(df, F.broadcast(right))
    left_types, right_types = dict(df.dtypes), dict(table.dtypes)
    if any(left_types[k] != right_types[k] for k in keys):
        return joined(df, right)  # hashes of different types cannot be compared
    hot = hot_keys(df, keys) if hot is None else list(hot)
    if not hot:
        return joined(df, right)
    spread = [F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t]
    left_salt = F.when(F.xxhash64(*keys).isin(hot), F.pmod(F.xxhash64(*spread), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    right_hot = F.xxhash64(*renamed.values()).isin(hot)
    salts = F.when(right_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    condition = condition & (F.col("__salt") == F.col("__right_salt"))
    return joined(df.withColumn("__salt", left_salt), right.withColumn("__right_salt", F.explode(salts))).drop("__salt", "__right_salt")


def key_set(log: DataFrame, key: str) -> DataFrame:
    """Distinct text keys of a log, as column ``__key``."""
    return log.select(key_text(key).alias("__key")).distinct()


def flag_members(
    df: DataFrame, key: str, log: DataFrame, log_key: str, name: str = "was_canceled"
) -> DataFrame:
    """Add a boolean: does the row's key occur in the log? Keys compare as text."""
    marked = key_set(log, log_key).withColumn(name, F.lit(True))
    keyed = df.withColumn("__key", key_text(key))
    return (
        attach(keyed, marked, ["__key"])
        .withColumn(name, F.coalesce(F.col(name), F.lit(False)))
        .drop("__key")
    )


def rows_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in a derived key set."""
    return attach(df, keys.select(*on).distinct(), on, how="left_semi")


def rows_not_in(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return attach(df, keys.select(*on).distinct(), on, how="left_anti")


def key_overlap(log: DataFrame, log_key: str, facts: DataFrame, fact_key: str) -> DataFrame:
    """Counts of distinct log keys that are present in, and absent from, the fact table."""
    known = key_set(facts, fact_key).withColumn("known", F.lit(1))
    log_keys = key_set(log, log_key)
    return log_keys.join(known, "__key", "left").agg(
        F.count("*").alias("log_keys"),
        F.count("known").alias("keys_found"),
        (F.count("*") - F.count("known")).alias("keys_missing"),
    )


def key_intersection(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    return key_set(a, a_key).intersect(key_set(b, b_key)).withColumnRenamed("__key", "key")


def key_difference(a: DataFrame, a_key: str, b: DataFrame, b_key: str) -> DataFrame:
    return key_set(a, a_key).subtract(key_set(b, b_key)).withColumnRenamed("__key", "key")


def lookup(
    df: DataFrame, key: str, dim: DataFrame, dim_key: str, columns: Sequence[str]
) -> DataFrame:
    """Left-join dimension columns on a text key. A dimension key that occurs twice would
    multiply facts, so one row per key is kept: the smallest in column order."""
    row = F.struct(*columns)
    unique = dim.groupBy(key_text(dim_key).alias("__key")).agg(F.min(row).alias("__row"))
    keyed = df.withColumn("__key", key_text(key))
    joined = attach(keyed, unique, ["__key"])
    return joined.withColumns({c: F.col("__row")[c] for c in columns}).drop("__key", "__row")


def map_values(c: Column | str, mapping: Mapping[object, object], default: object = None) -> Column:
    """Constant dictionary lookup as a CASE expression."""
    col = F.col(c) if isinstance(c, str) else c
    expr = F
    for key, value in mapping.items():
        expr = expr.when(col == F.lit(key), F.lit(value))
    return expr.otherwise(F.lit(default))


def zip_arrays(df: DataFrame, names: str, values: str, value_name: str) -> DataFrame:
    """Two aligned arrays (names, values) as rows (position, name, value)."""
    pairs = F.arrays_zip(F.col(names).alias("name"), F.col(values).alias(value_name))
    return df.select(F.posexplode(pairs).alias("position", "pair")).select(
        "position", F.col("pair.name").alias("name"), F.col(f"pair.{value_name}").alias(value_name)
    )


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of several tables by column name; a column missing in one is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
