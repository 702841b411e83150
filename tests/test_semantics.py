"""Hand tables for the places where nulls, edges and types decide the result."""

import math
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions import bins, clean, dates, text
from riskframe.functions.fixed import BMI_EDGES, BMI_LABELS, DISTANCE_EDGES, WAIT_DAYS_EDGES, WAIT_DAYS_LABELS
from riskframe.operators import calendar, joins, profile, rates
from riskframe.sources.tables import holiday_table


def one(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_key_text_spells_nulls_and_strips_unicode_space(spark):
    got = one(spark, ["\ta ", None, " שלום  ", "nan", ""], "string", clean.key_text)
    assert got == ["a", "nan", "שלום", "nan", ""]


def test_category_folds_null_texts(spark):
    assert one(spark, ["a", None, "nan", "<NA>"], "string", clean.category) == ["a", *["__MISSING__"] * 3]


def test_to_number_coerces(spark):
    values = ["1.5", " 2 ", "1e3", ".5", "abc", "", None, "nan", "1d", "3f", "-7", "inf"]
    got = one(spark, values, "string", clean.to_number)
    assert got == [1.5, 2.0, 1000.0, 0.5, None, None, None, None, None, None, -7.0, math.inf]


def test_to_timestamp_coerces(spark):
    got = one(spark, ["2024-02-03 04:05:06", "2024-02-03", "soon", None], "string", clean.to_timestamp)
    assert got == [datetime(2024, 2, 3, 4, 5, 6), datetime(2024, 2, 3), None, None]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_elapsed_days_floors_and_ignores_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        start = datetime(2024, 3, 9, 23)
        ends = [datetime(2024, 3, 10, 1), datetime(2024, 3, 9, 22), datetime(2024, 3, 11, 0),
                datetime(2024, 3, 10, 23), datetime(2024, 3, 8, 22), None]
        df = spark.createDataFrame([(i, start, e) for i, e in enumerate(ends)], "i int, a timestamp_ntz, b timestamp_ntz")
        got = [r[0] for r in df.orderBy("i").select(dates.elapsed_days("b", "a")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [0, -1, 1, 1, -2, None]


def test_wait_bins_are_half_open(spark):
    values = [-5.0, 0.0, 6.0, 7.0, 30.0, 365.0, math.inf, math.nan, None]
    got = one(spark, values, "double", lambda c: bins.bin_label(c, WAIT_DAYS_EDGES, WAIT_DAYS_LABELS))
    first = WAIT_DAYS_LABELS[0]
    assert got == [first, first, first, "8-30 days", "31-90 days", "365+ days", *["__MISSING__"] * 3]


def test_bmi_and_distance_bins(spark):
    got = one(spark, [-1.0, 0.0, 18.5, 24.9, math.inf], "double", lambda c: bins.bin_label(c, BMI_EDGES, BMI_LABELS))
    assert got == ["__MISSING__", "Underweight", "Normal", "Overweight", "__MISSING__"]
    assert bins.DISTANCE_LABELS == [
        "0-5 km", "5-10 km", "10-20 km", "20-50 km", "50-100 km", "100-200 km", "200-500 km", "500+ km"
    ]
    got = one(spark, [-0.1, 5.0, 500.0], "double", lambda c: bins.bin_label(c, DISTANCE_EDGES, bins.DISTANCE_LABELS))
    assert got == ["__MISSING__", "5-10 km", "500+ km"]


def test_count_items(spark):
    values = [None, "", "  ", "\t ", "a", "a,,b,", ","]
    assert one(spark, values, "string", text.count_items) == [0, 0, 0, 0, 1, 4, 2]


def test_site_room(spark):
    df = spark.createDataFrame([(0, "A ", "1"), (1, "A", "12"), (2, "A", "1.0"), (3, "A", None), (4, "ח  ב", "r\t2")], "i int, s string, r string")
    got = [r[0] for r in df.orderBy("i").select(text.site_room("s", "r")).collect()]
    assert got == ["A __1", "A__12", "A_1._0", "A_nan", "ח ב_r_2"]


def test_clip_keeps_null(spark):
    assert one(spark, [None, 5.0, 80.0, 30.0], "double", lambda c: clean.clip(c, 10, 70)) == [None, 10.0, 70.0, 30.0]


def test_out_of_range_ignores_null(spark):
    assert one(spark, [None, 5.0, 80.0, 10.0, 70.0], "double", lambda c: clean.outside(c, 10, 70)) == [False, True, True, False, False]


def test_decade_floors(spark):
    assert one(spark, [79.9, 80.0, -7.0, None], "double", dates.decade) == [70, 80, -10, None]


def test_calendar_parts(spark):
    days = [datetime(2024, 1, 5), datetime(2024, 6, 1), datetime(2024, 9, 1), datetime(2024, 12, 2), None]
    assert one(spark, days, "timestamp_ntz", dates.day_name) == ["Friday", "Saturday", "Sunday", "Monday", None]
    assert one(spark, days, "timestamp_ntz", dates.is_weekend) == [True, True, False, False, False]
    assert one(spark, days, "timestamp_ntz", dates.season) == ["Winter", "Summer", "Fall", "Winter", None]


def test_holiday_features_match_a_loop(spark):
    holidays = [date(2024, 1, 10), date(2024, 1, 11), date(2024, 2, 20)]
    days = [date.fromordinal(date(2024, 1, 1).toordinal() + i) for i in range(70)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "d date")
    got = {r["d"]: r for r in calendar.add_holiday_features(df, "d", holiday_table(spark, holidays)).collect()}
    for d in days:
        nxt = min([(h - d).days for h in holidays if h >= d], default=999)
        prv = min([(d - h).days for h in holidays if h <= d], default=999)
        eve = date.fromordinal(d.toordinal() - 1)
        assert got[d]["days_to_next_holiday"] == nxt and got[d]["days_from_prev_holiday"] == prv
        assert got[d]["near_holiday"] == (min(nxt, prv) <= 3)
        assert got[d]["is_surgery_after_holiday_weekend"] == (eve in holidays or eve.weekday() in (4, 5)), d
    empty = got[None]
    assert empty["days_to_next_holiday"] == 999 and not empty["near_holiday"]
    assert not empty["is_surgery_after_holiday_weekend"]


def test_no_holidays_at_all(spark):
    df = spark.createDataFrame([(date(2024, 1, 6),)], "d date")  # a Saturday
    row = calendar.add_holiday_features(df, "d", holiday_table(spark, [])).first()
    assert row["days_from_prev_holiday"] == 999 and not row["is_surgery_after_holiday_weekend"]


def test_smoothed_rates_and_unknown_categories(spark):
    df = spark.createDataFrame([("a", True), ("a", False), ("a", True), (None, True), ("nan", True), ("b", False)], "c string, y boolean")
    fitted = rates.fit_smoothed_rates(df, {"rate": "c"}, "y")
    got = {(r["c"], r["y"]): r["rate"] for r in fitted.transform(df).collect()}
    assert got[("a", True)] == pytest.approx(3 / 5) and got[("b", False)] == pytest.approx(1 / 3)
    assert got[(None, True)] == got[("nan", True)] == pytest.approx(3 / 6)  # 2 of 4 known rows
    other = spark.createDataFrame([("zzz", True)], "c string, y boolean")
    assert fitted.transform(other).first()["rate"] == pytest.approx(0.5)


def test_out_of_fold_rates_leave_the_own_fold_out(spark):
    from riskframe.operators.stratify import stratified_folds
    df = spark.createDataFrame([(i, "ab"[i % 2], int(i % 5 == 0)) for i in range(60)], "id int, c string, y int")
    folds = {r["id"]: r["fold"] for r in stratified_folds(df, "y", ["id"]).collect()}
    rows = df.collect()
    for r in rates.out_of_fold_rates(df, {"rate": "c"}, "y", ["id"]).collect():
        others = [o["y"] for o in rows if o["c"] == r["c"] and folds[o["id"]] != folds[r["id"]]]
        assert r["rate"] == pytest.approx((sum(others) + 1) / (len(others) + 2))


def test_flag_members_matches_text_keys_and_nulls(spark):
    facts = spark.createDataFrame([("1 ",), ("2",), (None,)], "id string")
    log = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    got = {r["id"]: r["was_canceled"] for r in joins.flag_members(facts, "id", log, "k").collect()}
    assert got == {"1 ": True, "2": False, None: True}


def test_lookup_does_not_multiply_rows(spark):
    facts = spark.createDataFrame([("x ", 1), ("y", 2), (None, 3)], "city string, i int")
    dim = spark.createDataFrame([("x", 5), (" x", 4), ("z", 1)], "name string, v int")
    got = {r["i"]: r["v"] for r in joins.lookup(facts, "city", dim, "name", ["v"]).collect()}
    assert got == {1: 4, 2: None, 3: None}


def test_value_counts_skip_null_and_rates_keep_it(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1), (None, 0)], "c string, y int")
    assert [(r["c"], r["n"]) for r in profile.value_counts(df, "c").collect()] == [("a", 2), ("b", 1)]
    assert {r["c"] for r in profile.rate_by_category(df, "c", "y").collect()} == {"a", "b", None}
    assert "__MISSING__" in {r["c"] for r in profile.rate_by_category(df, "c", "y", "__MISSING__").collect()}


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", 1), ("c", 2), ("c", 2), ("c", 2)], "k string, v int")
    s = profile.duplicate_summary(df).first()
    assert (s["rows"], s["distinct_rows"], s["removed_rows"], s["duplicate_members"]) == (6, 3, 3, 5)
    assert profile.duplicate_members(df).count() == 5


def test_imbalance_of_an_empty_table_is_zero(spark):
    assert profile.imbalance_ratio(spark.createDataFrame([], "y int"), "y").first()["imbalance"] == 0.0


def test_grid_equals_numpy(spark):
    assert bins.threshold_grid() == list(np.arange(0.05, 0.96, 0.01))


def test_round_half_even(spark):
    assert one(spark, [0.5, 1.5, 2.5, None], "double", lambda c: bins.round_half_even(c, 0)) == [0.0, 2.0, 2.0, None]


def test_constant_dictionary_lookup(spark):
    assert one(spark, [1, 2, None], "int", lambda c: joins.map_values(c, {1: "x"}, "?")) == ["x", "?", "?"]
