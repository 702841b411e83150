import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import profile, ranks, sequence, stratify
from riskframe.functions.bins import with_position


@pytest.fixture(params=["few distinct values", "many distinct values"])
def path(request, monkeypatch):
    """Both ways: everything counted in one table, and in chunks."""
    if request.param.startswith("many"):
        monkeypatch.setattr(ranks, "SMALL_ROWS", 4)
    return request.param


def sample(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=n).round(3)
    a[: n // 3] = 7.25  # one value holds a third of the rows
    b = rng.exponential(size=n) * 10 ** rng.integers(0, 9, size=n)
    g = rng.integers(0, 3, size=n)
    return a, b, g


def test_quantiles_equal_numpy(spark, path):
    a, b, g = sample()
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), g.tolist())), "a double, b double, g int").repartition(7)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["column"], r["share"]): r["value"] for r in ranks.quantiles(df, ["a", "b"], shares, ["g"]).collect()}
    for k in range(3):
        for name, x in (("a", a), ("b", b)):
            for s in shares:
                assert got[(k, name, s)] == pytest.approx(np.quantile(x[g == k], s), rel=1e-12)
    assert len(got) == 3 * 2 * len(shares)


def test_medians_with_nulls_nan_and_empty_column(spark, path):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None), (10.0, None), (None, None), (float("nan"), None)], "x double, e double")
    row = ranks.medians(df, ["x", "e"]).first()
    assert row["x"] == 2.5 and row["e"] is None


def test_median_of_counts(spark):
    counts = spark.createDataFrame([(1.0, 1), (2.0, 3), (9.0, 4), (None, 50)], "value double, cnt long")
    assert ranks.median_of_counts(counts).first()["median"] == pytest.approx(np.median([1, 2, 2, 2, 9, 9, 9, 9]))


def test_describe_equals_pandas(spark, path):
    a, b, g = sample(500)
    df = spark.createDataFrame(list(zip(a.tolist(), b.tolist(), g.tolist())), "a double, b double, g int")
    import pandas as pd
    want = pd.DataFrame({"a": a, "b": b}).describe()
    got = {(r["column"], r["stat"]): r["value"] for r in profile.describe(df, ["a", "b"]).collect()}
    assert len(got) == 16
    for (column, stat), value in got.items():
        assert value == pytest.approx(want.loc[stat, column], rel=1e-9)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_prefix_sums_equal_a_sorted_loop(spark, path, by):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 3)), float(x), int(rng.integers(0, 5))) for x in rng.permutation(900)]
    df = spark.createDataFrame(rows, "g int, s double, v int").repartition(5)
    out = ranks.prefix_sums(df, "s", {"v": "upto"}, {"v": "total"}, by, descending=True, following={"v": "next"})
    got = {(r["g"], r["s"]): r for r in out.collect()}
    assert len(got) == len(rows)
    groups = {g: sorted((r for r in rows if not by or r[0] == g), key=lambda r: -r[1]) for g in range(3)}
    for g, s, _ in rows:
        line = groups[g]
        i = next(i for i, r in enumerate(line) if r[1] == s)
        assert got[(g, s)]["upto"] == sum(r[2] for r in line[: i + 1])
        assert got[(g, s)]["total"] == sum(r[2] for r in line)
        assert got[(g, s)]["next"] == (line[i + 1][2] if i + 1 < len(line) else None)


def test_position_in_a_sorted_array(spark):
    cuts = [0.5, 0.5, 1.0, 3.0, 9.5]
    values = [-1.0, 0.5, 0.7, 1.0, 2.9, 9.4, 9.5, 100.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    array = F.array(*[F.lit(c) for c in cuts])
    got = {r["x"]: r["p"] for r in with_position(df, {"p": ("x", array)}, len(cuts)).collect()}
    assert got == {v: None if v is None else sum(c <= v for c in cuts) for v in values}


# --- splits and folds -----------------------------------------------------------------


def labelled(spark, n=1003, positives=211):
    return spark.createDataFrame([(i, int(i < positives), f"row {i}") for i in range(n)], "id int, y int, t string")


def test_split_has_exact_sizes_and_is_repeatable(spark):
    df = labelled(spark)
    parts = []
    for arranged in (df.repartition(1), df.repartition(17)):
        rows = stratify.stratified_split(arranged, "y", ["id"]).collect()
        assert len(rows) == 1003
        parts.append({r["id"] for r in rows if r["is_test"]})
    assert parts[0] == parts[1] and len(parts[0]) == 251  # ceil(1003 / 4)
    assert abs(sum(i < 211 for i in parts[0]) - 211 / 4) < 1


def test_split_sizes_of_the_published_counts(spark):
    counts = spark.createDataFrame([(0, 50604), (1, 12516)], "label int, n long")
    quotas = {r["label"]: r["train_n"] for r in stratify.split_quotas(counts).collect()}
    assert quotas == {0: 50604 - 12651, 1: 12516 - 3129}


def test_split_of_a_tiny_class_and_null_label(spark):
    df = spark.createDataFrame([(i, None if i == 0 else 1) for i in range(9)], "id int, y int")
    rows = stratify.stratified_split(df, "y", ["id"]).collect()
    assert len(rows) == 9 and sum(r["is_test"] for r in rows) == 3


def test_folds(spark):
    rows = stratify.stratified_folds(labelled(spark), "y", ["id"]).collect()
    for y, n in ((0, 792), (1, 211)):
        sizes = [sum(1 for r in rows if r["y"] == y and r["fold"] == f) for f in range(3)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1


def test_draw(spark):
    df = labelled(spark)
    first = {r["id"] for r in stratify.draw(df, 100, ["id"]).collect()}
    again = {r["id"] for r in stratify.draw(df.repartition(5), 100, ["id"]).collect()}
    assert len(first) == 100 and first == again
    assert stratify.draw(df, 0, ["id"]).count() == 0 and stratify.draw(df, 5000, ["id"]).count() == 1003


# --- sequences ------------------------------------------------------------------------


@pytest.mark.parametrize("min_rows", [1, 10**9])
def test_sequence_equals_pandas_with_and_without_hot_keys(spark, monkeypatch, min_rows):
    import pandas as pd
    rng = np.random.default_rng(5)
    n = 3000
    key = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 900, n))  # one key holds 40 %
    hours = rng.integers(0, 5000, n)
    times = pd.Series(pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, "h"))
    times[rng.random(n) < 0.02] = pd.NaT
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "t": times})
    rows = [(int(r.id), int(r.k), None if pd.isna(r.t) else r.t.to_pydatetime()) for r in pdf.itertuples()]
    df = spark.createDataFrame(rows, "id int, k int, t timestamp_ntz").repartition(6)
    out = sequence.with_sequence(df, ["k"], "t", ["id"], min_rows=min_rows)
    got = {r["id"]: (r["event_no"], r["days_since_last"]) for r in out.collect()}
    pdf = pdf.sort_values(["k", "t", "id"])
    pdf["no"] = pdf.groupby("k").cumcount() + 1
    pdf["gap"] = pdf.groupby("k")["t"].diff().dt.days
    assert len(got) == n
    for r in pdf.itertuples():
        no, gap = got[r.id]
        assert no == r.no
        assert (gap is None) == pd.isna(r.gap) and (gap is None or gap == r.gap)
