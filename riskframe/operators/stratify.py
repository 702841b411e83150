"""Exact, repeatable stratified splits, folds and draws.

Rows are ordered by a seeded hash of their key. The fit finds, per class, the hash at each
quota; applying it is one comparison per row, so wide rows are never sorted or shuffled.
Rows that agree on all ``key`` columns always land on the same side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.functions.fixed import FOLDS, SEED, TEST_SHARE
from riskframe.operators.joins import attach
from riskframe.operators.ranks import count_chunks, locate, resolve

#: Hashes are uniform, so their leading bits are chunks of equal size.
_CHUNK_BITS = 12


def order_hash(key: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *key)


def _hashed(df: DataFrame, label: Column, key: Sequence[str], seed: int) -> DataFrame:
    rows = df.select(label.alias("label"), order_hash(key, seed).alias("value"))
    return rows.withColumn("chunk", F.shiftright("value", 64 - _CHUNK_BITS))


def split_quotas(classes: DataFrame, test_share: float = TEST_SHARE) -> DataFrame:
    """Training rows per class: proportional, floored, the rest to the largest remainders.
    ``classes`` has one row (label, n) per class, so the windows over it are small."""
    every = Window.partitionBy()
    train = F.sum("n").over(every) - F.ceil(F.sum("n").over(every) * F.lit(test_share))
    exact = F.col("n") * F.col("train_total") / F.sum("n").over(every)
    by_rest = Window.orderBy((F.col("exact") - F.col("base")).desc(), F.col("label"))
    return (
        classes.withColumn("train_total", train)
        .withColumn("exact", exact)
        .withColumn("base", F.floor("exact"))
        .withColumns({
            "place": F.row_number().over(by_rest),
            "missing": F.col("train_total") - F.sum("base").over(every),
        })
        .select("label", "n", (
            F.col("base") + (F.col("place") <= F.col("missing")).cast("int")
        ).cast("long").alias("train_n"))
    )


def _single(rank: Column) -> Column:
    return F.array(F.struct(F.lit(0).alias("id"), rank.cast("long").alias("rank")))


def _limits(picked: DataFrame) -> DataFrame:
    """Per class, the ascending hashes at the wanted ranks."""
    return picked.groupBy("label").agg(F.sort_array(F.collect_list("value")).alias("__limits"))


def _part(df: DataFrame, label: str, key: Sequence[str], seed: int, limits: DataFrame, parts: int) -> DataFrame:
    """Add ``__part``: the number of limits (at most ``parts - 1``) below the row's hash. A class
    without any limit gets null."""
    joined = attach(df, limits.withColumnRenamed("label", label), [label], null_safe=True)
    h = order_hash(key, seed)
    part = F.lit(0)
    for i in range(parts - 1):
        part = part + F.coalesce((h > F.get("__limits", F.lit(i))).cast("int"), F.lit(0))
    return joined.withColumn("__part", F.when(F.col("__limits").isNotNull(), part)).drop("__limits")


def stratified_split(
    df: DataFrame, label: str, key: Sequence[str] | None = None,
    test_share: float = TEST_SHARE, seed: int = SEED, name: str = "is_test",
) -> DataFrame:
    """Add a boolean: is the row in the test part? Class sizes are exact for unique keys."""
    key = list(key or df.columns)
    hashed = _hashed(df, F.col(label), key, seed)
    counted, small = count_chunks(hashed, ["label"])
    quotas = split_quotas(counted.select("label", "n").distinct(), test_share).drop("n")
    quotas = quotas.withColumnRenamed("label", "__label")
    same = F.col("label").eqNullSafe(F.col("__label"))
    with_quota = counted.join(F.broadcast(quotas), same).drop("__label")  # one row per class
    located = locate(with_quota, _single(F.col("train_n"))).drop("train_n")
    split = _part(df, label, key, seed, _limits(resolve(hashed, ["label"], located, small)), parts=2)
    # a class without training quota has no limit and belongs to the test part
    return split.withColumn(name, F.coalesce(F.col("__part") > 0, F.lit(True))).drop("__part")


def stratified_folds(
    df: DataFrame, label: str, key: Sequence[str] | None = None,
    folds: int = FOLDS, seed: int = SEED, name: str = "fold",
) -> DataFrame:
    """Add a fold number 0..folds-1; within a class, fold sizes differ by at most one."""
    key = list(key or df.columns)
    hashed = _hashed(df, F.col(label), key, seed)
    ranks = F.array(*[
        F.struct(F.lit(i).alias("id"), F.floor(F.col("n") * i / folds).cast("long").alias("rank"))
        for i in range(1, folds)
    ])
    counted, small = count_chunks(hashed, ["label"])
    limits = _limits(resolve(hashed, ["label"], locate(counted, ranks), small))
    parted = _part(df, label, key, seed, limits, folds)
    return parted.withColumn(name, F.coalesce("__part", F.lit(0))).drop("__part")


def hash_limit(df: DataFrame, rows: int, key: Sequence[str], seed: int = SEED) -> Column:
    """The hash at rank ``rows``: exactly so many rows (of unique keys) have no larger one."""
    hashed = _hashed(df, F.lit(0), key, seed)
    counted, small = count_chunks(hashed, ["label"])
    located = locate(counted, _single(F.least(F.lit(rows), F.col("n"))))
    return resolve(hashed, ["label"], located, small).agg(F.max("value")).scalar()


def draw(df: DataFrame, rows: int, key: Sequence[str] | None = None, seed: int = SEED) -> DataFrame:
    """Exactly ``rows`` rows (of unique keys), chosen by hash order."""
    key = list(key or df.columns)
    if rows <= 0:
        return df.limit(0)
    return df.filter(order_hash(key, seed) <= hash_limit(df, rows, key, seed))
