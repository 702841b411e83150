"""Connected components of a table of links, by alternating large and small stars.

Each round replaces the links of every node by links to the smallest node it sees. Rounds are few
(about the logarithm of the longest path) and each is two aggregations and joins; the result of a round
is a written table, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import staged


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("a").agg(F.min("b").alias("m"))


def _star(links: DataFrame, large: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = _least(both).select(F.col("a").alias("of"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("of"))
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links a, b -> node, root: every node of a link with the smallest node it is connected to."""
    now = staged(links.select("a", "b").filter("a <> b").distinct())
    state = None
    while True:
        now = staged(_star(_star(now, True), False))
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == state:
            break
        state = sign
    # all links now lead from a node to its root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
