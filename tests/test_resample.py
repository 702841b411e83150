import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import resample


def labelled(spark, vectors, extra):
    rows = [(i, 1, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(10_000 + i, 0, [0.0, 0.0, 0.0]) for i in range(extra)]
    return spark.createDataFrame(rows, "id long, y int, features array<double>").repartition(4)


def test_oversampling_reaches_parity_evenly(spark):
    df = labelled(spark, np.eye(3).tolist() * 7, 100)
    rows = resample.oversample(df, "y", ["id"]).collect()
    assert sum(r["y"] == 1 for r in rows) == 100 == sum(r["y"] == 0 for r in rows)
    per_row = np.bincount([r["id"] for r in rows if r["y"] == 1])
    assert per_row.min() >= 4 and per_row.max() <= 5


def test_oversampling_of_balanced_and_empty_classes(spark):
    assert resample.oversample(labelled(spark, np.eye(3), 3), "y", ["id"]).count() == 6
    assert resample.oversample(labelled(spark, [], 3), "y", ["id"]).count() == 3


@pytest.mark.parametrize("block_rows", [4096, 16])
def test_nearest_equals_brute_force(spark, block_rows):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(5, 3)) * 10
    x = centres[rng.integers(0, 5, 150)] + rng.normal(size=(150, 3))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = {r["id"]: r["neighbours"] for r in resample.nearest(points, 5, block_rows).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert len(got) == 150
    for i in range(150):
        want = np.argsort(d[i])[:5]
        assert [n["id"] for n in got[i]] == want.tolist()
        assert np.allclose([n["distance"] for n in got[i]], d[i][want], atol=1e-6)


def test_copies_are_their_own_neighbours(spark):
    vectors = [[1.0, 1.0, 1.0]] * 30 + [[float(i), 0.0, 5.0] for i in range(10)]
    df = labelled(spark, vectors, 0)
    lists = {tuple(r["features"]): r["neighbours"] for r in resample.neighbour_lists(df, "id", 5).collect()}
    assert lists[(1.0, 1.0, 1.0)] == [[1.0, 1.0, 1.0]] * 5
    near_three = lists[(3.0, 0.0, 5.0)]
    assert near_three[0] in ([2.0, 0.0, 5.0], [4.0, 0.0, 5.0]) and len(near_three) == 5


def test_copies_fill_a_list(spark):
    df = labelled(spark, [[0.0, 0.0, 0.0]] + [[1.0, 0.0, 0.0]] * 3 + [[2.0, 0.0, 0.0]], 0)
    lists = {tuple(r["features"]): r["neighbours"] for r in resample.neighbour_lists(df, "id", 3).collect()}
    assert lists[(0.0, 0.0, 0.0)] == [[1.0, 0.0, 0.0]] * 3
    assert lists[(1.0, 0.0, 0.0)][:2] == [[1.0, 0.0, 0.0]] * 2


def test_smote_points_lie_between_a_row_and_a_neighbour(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    df = labelled(spark, x, 130)
    rows = resample.smote(df, "y", "id", block_rows=16).collect()
    assert len(rows) == 90
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for r in rows:
        base, near, made = (np.array(r[c]) for c in ("base", "neighbour", "features"))
        assert np.allclose(base, x[r["id"]]) and 0 <= r["gap"] < 1
        assert np.linalg.norm(near - base) <= np.sort(d[r["id"]])[4] + 1e-9
        assert np.allclose(made, base + r["gap"] * (near - base))
    again = resample.smote(df.repartition(9), "y", "id", block_rows=16).collect()
    assert sorted(map(tuple, [(r["id"], r["copy_no"], r["gap"]) for r in rows])) == sorted(
        map(tuple, [(r["id"], r["copy_no"], r["gap"]) for r in again]))


def test_smote_with_a_single_minority_row_makes_nothing(spark):
    assert resample.smote(labelled(spark, [[1, 2, 3]], 5), "y", "id").count() == 0


@pytest.mark.parametrize("scale, apart, block_rows", [(1000.0, 1e-6, 4096), (1.0, 1e-8, 64), (1000.0, 1e-4, 64)])
def test_near_copies_are_told_apart(spark, scale, apart, block_rows):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(80, 8)) * scale
    x = np.concatenate([base + rng.normal(size=base.shape) * apart for _ in range(6)])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, features array<double>")
    got = {r["id"]: [n["id"] for n in r["neighbours"]] for r in resample.nearest(points, 5, block_rows).collect()}
    for i in range(len(x)):
        d = np.sqrt(((x[i] - x) ** 2).sum(1))
        d[i] = np.inf
        assert got[i] == np.lexsort((np.arange(len(x)), d))[:5].tolist()


def test_smote_takes_vectors_and_text_keys(spark):
    from pyspark.ml.functions import array_to_vector

    df = labelled(spark, np.eye(3) + 1, 9).withColumn("key", F.concat(F.lit("p"), "id")).withColumn("v", array_to_vector("features"))
    made = resample.smote(df, "y", "key", "v", k=2).collect()
    assert len(made) == 6 and all(r["key"].startswith("p") for r in made)


def test_a_block_search_holds_a_few_rows_of_distances_at_a_time():
    import tracemalloc

    rng = np.random.default_rng(5)
    x = (rng.random((4096, 60)) < 0.1).astype(float)  # many equal distances: many pairs are compared by differences
    ids = np.arange(len(x))
    tracemalloc.start()
    row, col, near = resample._nearest_in_block(x, x, ids, ids, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 128 << 20  # one matrix of 4096 x 4096 distances has as much
    assert np.bincount(row).tolist() == [5] * len(x)
    for i in (0, 256, 4095):
        d = ((x[i] - x) ** 2).sum(1)
        d[i] = np.inf
        assert col[row == i].tolist() == np.lexsort((ids, d))[:5].tolist()
        assert np.allclose(near[row == i] ** 2, np.sort(d)[:5])


def test_synthetic_rows_are_written_as_sparse_vectors(spark):
    from pyspark.ml.linalg import DenseVector, SparseVector

    rows = [(0, [0.0] * 90 + [2.0, 0.5]), (1, [float(i + 1) for i in range(92)]), (2, [0.0] * 92)]
    made = resample.as_vectors(spark.createDataFrame(rows, "id int, features array<double>"), 92)
    got = {r["id"]: r["features"] for r in made.collect()}
    assert made.columns == ["id", "features"] and {i: v.toArray().tolist() for i, v in got.items()} == dict(rows)
    assert [type(got[i]) for i in range(3)] == [SparseVector, DenseVector, SparseVector]
