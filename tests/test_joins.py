import pytest
from pyspark.sql import functions as F

from riskframe import session
from riskframe.operators import joins


def tables(spark):
    rows = [(i, "hot" if i % 3 else ("cold" if i % 2 else f"k{i}")) for i in range(300)] + [(1000, None), (1001, None)]
    left = spark.createDataFrame(rows, "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("cold", 2), ("k0", 3), ("unused", 4)], "k string, v int")
    return left, right


@pytest.mark.parametrize("small, hot", [(True, None), (False, []), (False, "found"), (None, None)])
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_all_ways_to_attach_agree(spark, small, hot, how):
    left, right = tables(spark)
    if hot == "found":
        hot = joins.hot_keys(left, ["k"], share=0.1, min_rows=1)
        assert len(hot) == 1 or len(hot) == 2
    got = joins.attach(left, right, ["k"], small, hot, how=how)
    want = left.join(right, "k", how).select(*got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_null_safe_attach_with_hot_keys(spark):
    left, right = tables(spark)
    right = right.unionByName(spark.createDataFrame([(None, 9)], "k string, v int"))
    hot = joins.hot_keys(left, ["k"], share=0.005, min_rows=1)
    got = joins.attach(left, right, ["k"], False, hot, null_safe=True)
    assert {r["i"]: r["v"] for r in got.filter("k is null").collect()} == {1000: 9, 1001: 9}
    assert got.count() == 302


def test_hot_keys_are_few_and_found(spark):
    left, _ = tables(spark)
    hot = joins.hot_keys(left, ["k"], share=0.5, min_rows=1)
    assert hot == [left.filter("k = 'hot'").select(F.xxhash64("k")).first()[0]]
    assert joins.hot_keys(left, ["k"]) == []  # far below the row limit


def test_settle_keeps_large_tables_off_the_driver(spark):
    df = spark.range(100)
    local, small = session.settle(df, limit=100)
    assert small and local.count() == 100
    far, small = session.settle(df, limit=99)
    assert not small and far.count() == 100


def test_settle_keeps_types(spark):
    df = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' t, date'2024-01-01' d, array(struct(1 as a, 2L as b)) s, cast(null as string) n")
    local, _ = session.settle(df)
    assert local.schema == df.schema and local.collect() == df.collect()


def test_key_sets(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    b = spark.createDataFrame([("2 ",), ("3",)], "k string")
    row = joins.key_overlap(a, "k", b, "k").first()
    assert (row["log_keys"], row["keys_found"], row["keys_missing"]) == (2, 1, 1)
    assert [r[0] for r in joins.key_intersection(a, "k", b, "k").collect()] == ["2"]
    assert [r[0] for r in joins.key_difference(a, "k", b, "k").collect()] == ["1"]


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([("m1", 0.5)], "name string, x double")
    b = spark.createDataFrame([("m2",)], "name string")
    assert {r["name"]: r["x"] for r in joins.union_rows([a, b]).collect()} == {"m1": 0.5, "m2": None}


def test_keys_of_different_types_still_join(spark):
    left = spark.createDataFrame([(i % 3,) for i in range(30)], "k int")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    got = joins.attach(left, right, ["k"], small=False, hot=[left.select(F.xxhash64("k")).first()[0]])
    assert got.filter("v = 'a'").count() == 10 and got.filter("v is null").count() == 10


def test_hot_duplicates_are_all_kept(spark, monkeypatch):
    from riskframe.operators import profile
    df = spark.createDataFrame([("x", 1)] * 50 + [("y", None)] * 2 + [(f"k{i}", i) for i in range(40)], "a string, b int")
    monkeypatch.setattr(profile, "settle", lambda t: (t, False))
    monkeypatch.setattr(joins, "HOT_ROWS", 1)
    monkeypatch.setattr(joins, "hot_keys", lambda d, k: [d.filter("a = 'x'").select(F.xxhash64(*k)).first()[0]])
    assert profile.duplicate_members(df).count() == 52
