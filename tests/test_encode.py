import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskframe import session
from riskframe.operators import encode, joins, projection, rates
from riskframe.plans import features
from riskframe.sources import sinks, tables


def train_rows(spark):
    rows = [(i, 1, float(i % 4), None, "ab"[i % 2], "big") for i in range(40)]
    rows += [(100, 0, None, None, "rare1", "big"), (101, 0, 10.0, None, "rare2", None)]
    return spark.createDataFrame(rows, "id int, y int, x double, empty double, c string, d string")


def vectors(df):
    return {r["id"]: r["v"] for r in df.select("id", vector_to_array("features").alias("v")).collect()}


@pytest.mark.parametrize("small", [True, False])
def test_vector_layout(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(session, "SMALL_ROWS", 0)
    train = train_rows(spark)
    fitted = encode.fit_preprocessor(train, ["x", "empty"], ["c", "d"])
    assert bool(fitted.small_columns) == small  # the way a large vocabulary is joined must give the same
    names = [r["name"] for r in fitted.names().orderBy("position").collect()]
    assert names == ["x", "c_a", "c_b", "c_infrequent_sklearn", "d_big"]
    x = np.array([float(i % 4) for i in range(40)] + [2.0, 10.0])
    new = spark.createDataFrame([(1, None, "a", "big"), (2, 3.0, "rare2", "other"), (3, 1.0, "never", None)], "id int, x double, c string, d string")
    new = new.withColumn("empty", F.lit(None).cast("double"))
    got = vectors(fitted.transform(new, ["id"]))
    z = lambda v: (v - x.mean()) / x.std()
    assert np.allclose(got[1], [z(2.0), 1, 0, 0, 1])
    assert np.allclose(got[2], [z(3.0), 0, 0, 1, 0])
    assert np.allclose(got[3], [z(1.0), 0, 0, 0, 0])


def test_scaling_uses_population_deviation_and_survives_constants(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0), (10.0, 5.0)], "x double, k double")
    got = {r["column"]: r for r in encode.scaling_params(df, ["x", "k"]).collect()}
    assert got["x"]["median"] == 2.5 and got["x"]["scale"] == pytest.approx(3.5355339)
    assert got["k"]["scale"] == 1.0


def test_vocabulary_without_rare_or_without_frequent(spark):
    df = spark.createDataFrame([("a", str(i)) for i in range(12)], "c string, d string")
    vocab = encode.vocabulary(df, ["c", "d"])
    rows = {(r["column"], r["category"]): (r["name"], r["slot"]) for r in vocab.collect()}
    assert rows[("c", "a")] == ("c_a", 0)
    assert {v for k, v in rows.items() if k[0] == "d"} == {("d_infrequent_sklearn", 0)}


def test_generic_names_on_mismatch():
    assert encode.names_or_generic(["a", "b"], 2) == ["a", "b"]
    assert encode.names_or_generic(["a"], 2) == ["feat_0", "feat_1"]


def test_preprocessor_round_trip(spark, tmp_path):
    train = train_rows(spark)
    fitted = encode.fit_preprocessor(train, ["x"], ["c", "d"])
    loaded = sinks.load_preprocessor(spark, sinks.save_preprocessor(fitted, str(tmp_path / "p")))
    assert vectors(fitted.transform(train, ["id"])) == vectors(loaded.transform(train, ["id"]))


def test_matrix_and_params_round_trip(spark, tmp_path):
    train = train_rows(spark)
    data = encode.fit_preprocessor(train, ["x"], ["c"]).transform(train.withColumn("is_test", F.col("id") >= 100), ["id", "is_test"])
    path = sinks.write_matrix(data, str(tmp_path / "m"))
    assert sinks.read_matrix(spark, path, test=True).count() == 2
    assert vectors(sinks.read_matrix(spark, path)) == vectors(data)
    params = {"max_depth": 5, "learning_rate": 0.1}
    assert sinks.read_params(spark, sinks.write_params(spark, params, str(tmp_path / "j"))) == params


def test_table_sources(spark, tmp_path):
    df = spark.createDataFrame([("p1", "2024-01-01 00:00:00")], "plan_id string, cancel_date string")
    df.write.option("header", True).csv(str(tmp_path / "log"))
    schema = "plan_id string, cancel_date timestamp_ntz"
    back = tables.read_table(spark, str(tmp_path / "log"), "csv", schema)
    assert back.dtypes == [("plan_id", "string"), ("cancel_date", "timestamp_ntz")] and back.count() == 1
    df.write.json(str(tmp_path / "j"))
    assert tables.read_first_of(spark, [str(tmp_path / "none"), str(tmp_path / "j")], "json").count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_first_of(spark, [str(tmp_path / "none")])
    with pytest.raises(ValueError, match="lacks columns"):
        tables.require_columns(df, ["plan_id", "surgery_date"], "plans")


def test_projections(spark):
    df = spark.createDataFrame([(1, 2.0, "t", True)], "i int, x double, s string, b boolean")
    assert projection.numeric_columns(df) == ["i", "x"] and projection.text_columns(df) == ["s"]
    assert projection.non_numeric_columns(df) == ["s", "b"]
    assert projection.rename(df, {"i": "j", "nope": "k"}).columns == ["j", "x", "s", "b"]
    assert projection.select_existing(df, ["s", "nope"]).columns == ["s"]


def engineered_sample(spark):
    from datetime import date, datetime
    n = 60
    rows = [{
        "plan_id": f" {i}", "patient_id": str(i), "room": None if i % 9 == 0 else str(i % 3), "anesthesia": "ga" if i % 2 else None,
        "procedure_code": f"c{i % 4}", "surgery_site": "main", "department": "d", "bmi": "x" if i % 7 == 0 else str(15 + i),
        "medications": "a,b" if i % 2 else " ", "diagnoses": None, "city": "t" if i % 2 else "u", "gender": "f", "payer": "p",
        "marital_status": "m", "distance_km": str(i * 3), "performed_plan_no": "1", "wait_days_source": i,
        "request_date": datetime(2024, 1, 1, 12), "surgery_date": None if i == 5 else datetime(2024, 1, 1 + i % 28, 8),
        "age": float(i), **{lab: float(i) if i % 3 else None for lab in ("albumin", "pt_inr", "potassium", "sodium", "hb", "wbc", "plt")},
    } for i in range(n)]
    plans = spark.createDataFrame([[r[f.name] for f in tables.PLANS.fields] for r in rows], tables.PLANS)
    log = spark.createDataFrame([(str(i), None, None) for i in range(0, n, 5)], tables.CANCEL_LOG)
    city = spark.createDataFrame([("t ", "4"), ("w", "bad")], tables.CITY_DIM)
    return features.engineer(plans, log, tables.holiday_table(spark, [date(2024, 1, 10)]), city)


def test_engineered_table(spark):
    df = engineered_sample(spark)
    assert len(df.columns) == 52 and df.count() == 60
    row = df.filter("plan_id = ' 5'").first()
    assert row["was_canceled"] and row["wait_days"] is None and row["wait_days_category"] == "__MISSING__"
    assert row["surgery_weekday"] is None and not row["is_weekend"] and row["days_to_next_holiday"] == 999
    assert row["weekday_cancel_rate_smoothed"] == pytest.approx(2 / 3)  # a missing weekday is a group
    row = df.filter("plan_id = ' 0'").first()
    assert row["wait_days"] == -1 and row["bmi_category"] == "__MISSING__" and not row["bmi_missing"]
    assert row["site_room"] == "main_nan" and row["socioeconomic_cluster"] == 4.0
    assert row["num_existing_labs"] == 0 and row["has_missing_labs"] and row["num_medications"] == 0


def test_prepare_selects_features(spark):
    prepared, spec = features.prepare(engineered_sample(spark))
    assert len(spec.numeric) == 26 and len(spec.categorical) == 13
    assert prepared.filter("bmi < 10 or bmi > 70").count() == 0
    assert prepared.filter("anesthesia is null").count() == 0
    matrices = features.build_matrices(prepared, spec)
    sizes = {(r["is_test"], r["was_canceled"]): r["count"] for r in matrices.data.groupBy("is_test", "was_canceled").count().collect()}
    assert sizes == {(True, 1): 3, (True, 0): 12, (False, 1): 9, (False, 0): 36}
    width = len(vectors(matrices.data.withColumnRenamed("plan_id", "id"))[" 0"])
    assert matrices.preprocessor.names().count() == width


def test_row_features_need_no_state(spark, tmp_path):
    """The row-wise part also runs on a stream of files."""
    from riskframe.plans.features import add_calendar_features
    rows = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' request_date, timestamp_ntz'2024-01-09 00:00:00' surgery_date")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = add_calendar_features(stream).writeStream.format("memory").queryName("row_features").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("row_features").first()["wait_days_category"] == "8-30 days"


def test_large_vocabularies_and_rates_read_the_source_once(spark, monkeypatch, tmp_path):
    """Thirteen large columns, two hot keys each: the plan must not grow with the columns."""
    columns = [f"c{i}" for i in range(13)]
    rows = spark.range(400).select(
        F.col("id"), (F.col("id") % 2).cast("int").alias("y"), F.col("id").cast("double").alias("x"),
        *[F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "warm").otherwise(F.concat(F.lit("v"), F.col("id") % 5)).alias(c) for c in columns])
    rows.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    few = vectors(encode.fit_preprocessor(df, ["x"], columns).transform(df, ["id"]))
    few_rates = rates.fit_smoothed_rates(df, {f"r_{c}": c for c in columns}, "y").transform(df).orderBy("id").collect()
    monkeypatch.setattr(session, "SMALL_ROWS", 0)
    monkeypatch.setattr(joins, "HOT_ROWS", 50)
    fitted = encode.fit_preprocessor(df, ["x"], columns)
    out = fitted.transform(df, ["id"])
    scans = lambda d: sum("Relation [" in line and "c0#" in line for line in d._jdf.queryExecution().optimizedPlan().toString().split("\n"))
    assert 1 <= scans(out) <= 2
    many = vectors(out)
    assert many.keys() == few.keys() and all(np.allclose(many[k], few[k]) for k in few)
    rated = rates.fit_smoothed_rates(df, {f"r_{c}": c for c in columns}, "y").transform(df)
    assert 1 <= scans(rated) <= 2
    assert rated.orderBy("id").select(*few_rates[0].asDict()).collect() == few_rates


def test_plans_may_bring_their_label(spark):
    from datetime import datetime
    row = (datetime(2024, 1, 1, 12), datetime(2024, 1, 9, 8))
    values = {**{c: None for c in tables.PLANS.fieldNames()}, "request_date": row[0], "surgery_date": row[1]}
    plans = spark.createDataFrame([[{**values, "plan_id": str(i)}[c] for c in tables.PLANS.fieldNames()] for i in range(4)], tables.PLANS)
    log = spark.createDataFrame([("1", None, None), ("1", None, None)], tables.CANCEL_LOG)
    holidays, city = tables.holiday_table(spark, []), spark.createDataFrame([], tables.CITY_DIM)
    want = features.engineer(plans, log, holidays, city)
    got = features.engineer(joins.flag_members(plans, "plan_id", log, "plan_id", "was_canceled"), None, holidays, city)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError, match="lacks columns"):
        features.engineer(plans, None, holidays, city)


def test_partitioned_write_does_not_sort(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter
    key, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: seen.append(spark.conf.get(key)) or write(self, path))
    before, rows = spark.conf.get(key), spark.range(40).selectExpr("id", "id % 20 AS p")
    path = sinks.write_table(rows, str(tmp_path / "t"), partition_by=["p"])  # more folders than open files
    assert seen == [str(sinks.OPEN_FILES)] and spark.conf.get(key) == before
    assert spark.read.parquet(path).filter("id % 20 = p").count() == 40


@pytest.mark.parametrize("own", [None, "60000"])
def test_wide_projections_are_compiled_in_any_session(spark, monkeypatch, own):
    from pyspark.sql import DataFrameWriter
    key, seen, write = "spark.sql.codegen.hugeMethodLimit", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: seen.append(spark.conf.get(key)) or write(self, path))
    given = spark.conf.get(key)
    spark.conf.unset(key) if own is None else spark.conf.set(key, own)
    try:
        before = spark.conf.get(key)
        assert session.stage(spark.range(3)).count() == 3
        assert seen == [str(session.HUGE_METHOD)] and spark.conf.get(key) == before
        with pytest.raises(ZeroDivisionError), session.set_for_now(spark, key, 1):
            1 / 0
        assert spark.conf.get(key) == before
    finally:
        spark.conf.set(key, given)
