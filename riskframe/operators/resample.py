"""Re-sampling of the minority class: random over-sampling and SMOTE."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions.fixed import SEED, SMOTE_NEIGHBOURS
from riskframe.operators.joins import attach
from riskframe.operators.stratify import hash_limit, order_hash
from riskframe.session import stage

#: Rows of a block; a task compares two blocks at a time.
BLOCK_ROWS = 4096
MAX_PIVOTS = 1024
#: Numbers a task holds in one array at a time (8 MB): distances of a few queries to a block, or differences.
STEP_CELLS = 1 << 20


def _needed(df: DataFrame, label: str, minority: int) -> tuple[int, int]:
    """Minority rows, and rows missing to parity with the rest."""
    is_minority = F.col(label) == minority
    row = df.agg(F.count_if(is_minority).alias("few"), F.count_if(~is_minority).alias("many")).first()
    return row["few"], max(0, row["many"] - row["few"])


def _copies(rows: DataFrame, few: int, need: int, key: Sequence[str], seed: int) -> Column:
    """How many extra rows each minority row yields: the same for all, one more for the rows
    with the lowest hashes, so that the sum is exact (for unique keys)."""
    if few == 0:
        return F.lit(0)
    base, rest = divmod(need, few)
    if rest == 0:
        return F.lit(base)
    lowest = order_hash(key, seed) <= hash_limit(rows, rest, key, seed)
    return F.lit(base) + lowest.cast("int")


def oversample(
    df: DataFrame, label: str, key: Sequence[str], minority: int = 1, seed: int = SEED
) -> DataFrame:
    """The table with minority rows repeated until both classes are equally large. Column
    ``copy_no`` is 0 for original rows."""
    few, need = _needed(df, label, minority)
    rows = df.filter(F.col(label) == minority)
    copies = _copies(rows, few, need, key, seed)
    repeated = (
        rows.withColumn("__copies", copies).filter("__copies > 0")
        .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__copies")
    )
    return df.withColumn("copy_no", F.lit(0)).unionByName(repeated)


# --- exact nearest neighbours ---------------------------------------------------------


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances as a^2 + b^2 - 2ab, and a bound of their error: for points close together
    the difference has few digits left."""
    aa, bb = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    error = 4.0 * (a.shape[1] + 4) * np.finfo(float).eps * (aa + bb)
    return np.maximum(aa + bb - 2.0 * a @ b.T, 0.0), error


def _bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances."""
    square, error = _squares(a, b)
    return np.sqrt(np.maximum(square - error, 0.0)), np.sqrt(square + error)


def _steps(rows: int, width: int) -> Iterator[slice]:
    """Slices of so many rows that rows x width numbers stay within STEP_CELLS."""
    step = max(1, STEP_CELLS // max(1, width))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def _nearest_in_block(
    q: np.ndarray, c: np.ndarray, q_id: np.ndarray, c_id: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, candidate numbers and exact distances of the k nearest per query, in order of
    distance, then candidate; a row is no neighbour of its own. All candidates that the error bound leaves
    possible are compared by direct differences. A few queries at a time, so that memory does not depend
    on the sizes of the blocks."""
    found = []
    for part in _steps(len(q), len(c)):
        same = q_id[part, None] == c_id[None, :]
        square, error = _squares(q[part], c)
        high = square + error
        high[same] = np.inf
        kth = min(k, high.shape[1]) - 1
        limit = np.partition(high, kth, axis=1)[:, kth]
        row, col = np.nonzero((square - error <= limit[:, None]) & ~same)
        row += part.start
        exact = np.empty(len(row))
        for pairs in _steps(len(row), q.shape[1]):
            exact[pairs] = np.sqrt(((q[row[pairs]] - c[col[pairs]]) ** 2).sum(1))
        order = np.lexsort((col, exact, row))
        row, col, exact = row[order], col[order], exact[order]
        first = np.searchsorted(row, np.arange(part.start, part.stop))
        keep = np.arange(len(row)) - first[row - part.start] < k
        found.append((row[keep], col[keep], exact[keep]))
    row, col, exact = (np.concatenate(v) for v in zip(*found))
    return row, col, exact


def nearest(points: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest other points of each point, exactly: rows (id, neighbours), an array of
    (distance, id) in ascending order. ``points`` has unique ``id`` (long) and distinct
    ``features`` (array of double).

    Points are grouped around pivots. A first round searches a point's own cell, which bounds
    its k-th distance; by the triangle inequality a second round visits only cells that can
    hold something nearer. Cells are cut into blocks, so that a task compares two blocks and
    hands on k candidates per point, never all pairs.
    """
    n = points.count()
    wanted = min(MAX_PIVOTS, max(1, n // block_rows), max(1, n))
    pivot_rows = points.orderBy(F.xxhash64("id"), "id").limit(wanted).select("features").collect()
    if not pivot_rows:
        return points.select("id", F.array().cast("array<struct<distance:double,id:bigint>>").alias("neighbours"))
    pivots = np.array([r["features"] for r in pivot_rows], dtype=float)  # at most MAX_PIVOTS

    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _steps(len(batch), max(pivots.shape)):
                some = batch.iloc[part]
                _, d = _bounds(np.stack(some["features"].to_numpy()), pivots)
                cell = d.argmin(1)
                yield some.assign(cell=cell, reach=d[np.arange(len(cell)), cell])

    # written once: the cells of a point steer several passes
    located = stage(points.select("id", "features").mapInPandas(
        locate, "id long, features array<double>, cell long, reach double"
    ))
    cells = located.groupBy("cell").agg(F.count("*").alias("n"), F.max("reach").alias("radius")).collect()
    blocks = np.ones(len(pivots), dtype=int)
    radius = np.full(len(pivots), -np.inf)
    for row in cells:
        blocks[row["cell"]] = -(-row["n"] // block_rows)
        radius[row["cell"]] = row["radius"]
    block_count = F.array(*[F.lit(int(b)) for b in blocks])
    blocks_of = lambda c: F.get(block_count, c.cast("int"))
    block = F.pmod(F.xxhash64("id"), blocks_of(F.col("cell"))).cast("int")
    candidates = located.select("cell", block.alias("block"), "id", "features")

    def search(queries: DataFrame) -> DataFrame:
        """Rows (id, distance, other): k candidates per query and block of its target cell."""
        spread = queries.withColumn(
            "block", F.explode(F.sequence(F.lit(0), blocks_of(F.col("cell")) - 1))
        )
        # queries of a full cell are grouped in blocks as well, candidates are repeated for them
        per_cell = queries.groupBy("cell").agg(
            F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("groups")
        ).collect()  # at most MAX_PIVOTS rows
        groups = np.zeros(len(pivots), dtype=int)
        for row in per_cell:
            groups[row["cell"]] = row["groups"]
        group_count = F.array(*[F.lit(int(g)) for g in groups])
        groups_of = F.get(group_count, F.col("cell").cast("int"))
        left = spread.withColumn("part", F.pmod(F.xxhash64("id"), groups_of).cast("int"))
        right = candidates.filter(groups_of > 0).withColumn(
            "part", F.explode(F.sequence(F.lit(0), groups_of - 1))
        )

        def compare(_, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            empty = pd.DataFrame({"id": [], "distance": [], "other": []}).astype(
                {"id": "int64", "distance": "float64", "other": "int64"}
            )
            if q.empty or c.empty:
                return empty
            c = c.sort_values("id")
            ids, others = q["id"].to_numpy(), c["id"].to_numpy()
            row, col, near = _nearest_in_block(np.stack(q["features"].to_numpy()), np.stack(c["features"].to_numpy()), ids, others, k)
            return pd.DataFrame({"id": ids[row], "distance": near, "other": others[col]})

        keys = ["cell", "block", "part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            compare, "id long, distance double, other long"
        )

    def merged(found: DataFrame) -> DataFrame:
        pairs = F.sort_array(F.collect_list(F.struct("distance", F.col("other").alias("id"))))
        return found.groupBy("id").agg(F.slice(pairs, 1, k).alias("neighbours"))

    own = stage(search(located.select("id", "features", "cell")))  # used for the bounds and the result
    if len(pivots) == 1:
        return merged(own)

    bounds = merged(own).select("id", F.when(
        F.size("neighbours") >= k, F.element_at("neighbours", k)["distance"]
    ).alias("bound"))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _steps(len(batch), max(pivots.shape)):
                some = batch.iloc[part]
                ids, vectors = some["id"].to_numpy(), some["features"].to_numpy()
                d, _ = _bounds(np.stack(vectors), pivots)
                bound = some["bound"].fillna(np.inf).to_numpy()
                slack = 1e-12 * (1.0 + d)
                useful = (d - radius[None, :] <= bound[:, None] + slack) & np.isfinite(radius)[None, :]
                useful[np.arange(len(some)), some["cell"].to_numpy()] = False
                row, target = np.nonzero(useful)
                for out in _steps(len(row), pivots.shape[1]):  # each row carries a vector
                    yield pd.DataFrame({"id": ids[row[out]], "features": vectors[row[out]], "cell": target[out]})

    bounded = located.join(bounds, "id", "left").select("id", "features", "cell", "bound")
    further = bounded.mapInPandas(visits, "id long, features array<double>, cell long")
    return merged(own.unionByName(search(further)))


def neighbour_lists(rows: DataFrame, key: str, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Per distinct vector the vectors of its k nearest rows: (features, neighbours).

    Equal vectors are merged before the search, with their number of copies. A copy is a
    neighbour at distance 0, so a vector with many copies has itself as its neighbours.
    """
    if dict(rows.dtypes)[key] in ("tinyint", "smallint", "int", "bigint"):
        points = rows.groupBy("features").agg(F.min(key).cast("long").alias("id"), F.count("*").alias("copies"))
    else:  # numbers that are written once
        points = stage(rows.groupBy("features").agg(F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    near = stage(nearest(points.select("id", "features"), k, block_rows))  # the join reads it twice
    pairs = near.select("id", F.posexplode("neighbours").alias("place", "near")).select(
        "id", "place", F.col("near.id").alias("other")
    )
    others = points.select(F.col("id").alias("other"), F.col("features").alias("vector"), F.col("copies").alias("times"))
    repeated = lambda vector, times: F.array_repeat(vector, F.least(times, F.lit(k)).cast("int"))
    lists = (
        attach(pairs, others, ["other"], small=False)
        .groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "vector", "times"))).alias("near"))
        .select("id", F.flatten(F.transform("near", lambda v: repeated(v["vector"], v["times"]))).alias("near"))
    )
    own = repeated(F.col("features"), F.col("copies") - 1)
    far = F.coalesce("near", F.array().cast("array<array<double>>"))
    return points.join(lists, "id", "left").select(
        "features", F.slice(F.concat(own, far), 1, k).alias("neighbours")
    )


def smote(
    df: DataFrame, label: str, key: str, features: str = "features", minority: int = 1,
    k: int = SMOTE_NEIGHBOURS, seed: int = SEED, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Synthetic minority rows up to parity: (key, copy_no, label, base, neighbour, gap,
    features). Each lies between a minority row and one of its k nearest minority rows; which
    one, and where between, follows from a seeded hash. ``key`` is a row key of any simple type,
    ``features`` an array of numbers or a vector (the result has arrays)."""
    few, need = _needed(df, label, minority)
    is_vector = isinstance(df.schema[features].dataType, VectorUDT)
    numbers = vector_to_array(features) if is_vector else F.col(features).cast("array<double>")
    rows = df.filter(F.col(label) == minority).select(F.col(key), F.col(label), numbers.alias("features"))
    copies = _copies(rows, few, need, [key], seed)
    lists = neighbour_lists(rows, key, k, block_rows)
    bases = attach(rows.withColumn("__copies", copies).filter("__copies > 0"), lists, ["features"], small=False)
    drawn = bases.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    pick = F.pmod(F.xxhash64(F.lit(seed), F.lit("pick"), key, "copy_no"), F.size("neighbours")).cast("int")
    steps = 1 << 53
    gap = F.pmod(F.xxhash64(F.lit(seed), F.lit("gap"), key, "copy_no"), F.lit(steps)) / F.lit(float(steps))
    placed = drawn.filter(F.size("neighbours") > 0).withColumns({"neighbour": F.get("neighbours", pick), "gap": gap})
    between = F.zip_with("features", "neighbour", lambda a, b: a + F.col("gap") * (b - a))
    return placed.select(
        key, "copy_no", label, F.col("features").alias("base"), "neighbour", "gap", between.alias("features")
    )


def with_synthetic(train: DataFrame, synthetic: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Training rows plus synthetic rows, on the given columns."""
    return train.select(*columns).unionByName(synthetic.select(*columns))


def as_vectors(df: DataFrame, width: int, features: str = "features") -> DataFrame:
    """Arrays of ``width`` numbers as vectors that list only what is not 0, where that is shorter. Runs no job."""
    made = df.withColumn("__dense", array_to_vector(features))
    sized = VectorSizeHint(inputCol="__dense", size=width, handleInvalid="optimistic").transform(made)
    short = VectorAssembler(inputCols=["__dense"], outputCol="__short").transform(sized)
    return short.withColumn(features, F.col("__short")).drop("__dense", "__short")
