"""Queries: scans, the event log, profiles and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions import bins, clean, dates, text
from riskframe.operators import joins, profile, projection, sequence
from riskframe.plans import workload as w
from riskframe.plans.catalog import (
    ELAPSED, LABELLED, LOG, WITH_LINES, describe_sql, query, r, rounded,
)
from riskframe.sources import tables

# --- scans ----------------------------------------------------------------------------


@query(f"""WITH {LOG} SELECT 'orders' AS "table", count(*) AS "rows", 6::BIGINT AS columns FROM orders
 UNION ALL SELECT 'log', count(*), 3::BIGINT FROM log""")
def table_shapes(spark, sf) -> DataFrame:
    named = {"orders": w.table(spark, sf, "orders"), "log": w.cancel_log(spark, sf)}
    shapes = [
        profile.table_shape(df).select(F.lit(n).alias("table"), "rows", F.col("columns").cast("long").alias("columns"))
        for n, df in named.items()
    ]
    return joins.union_rows(shapes)


@query("""SELECT count(*) AS "rows", count(DISTINCT o_custkey) AS customers FROM orders""")
def first_available_table(spark, sf) -> DataFrame:
    df = tables.read_first_of(spark, [f"{sf}/features_v3.parquet", f"{sf}/orders.parquet"])
    df = tables.require_columns(df, ["o_orderkey", "o_custkey"], "orders")
    return df.agg(F.count("*").alias("rows"), F.countDistinct("o_custkey").alias("customers"))


# --- label and target -----------------------------------------------------------------


@query(f"WITH {LABELLED} SELECT o_orderkey, was_canceled FROM labelled")
def label_flag(spark, sf) -> DataFrame:
    return w.labelled_orders(spark, sf).select("o_orderkey", "was_canceled")


@query(f"""WITH {LABELLED} SELECT o_orderpriority, round(avg(was_canceled::INT), 6) AS rate, count(*) AS n
 FROM labelled GROUP BY o_orderpriority""")
def rate_by_category(spark, sf) -> DataFrame:
    rates = profile.rate_by_category(w.labelled_orders(spark, sf), "o_orderpriority", "was_canceled")
    return rounded(rates, "rate")


@query(f"""WITH {LABELLED}, {WITH_LINES}, f AS (SELECT was_canceled::INT AS y, coalesce(lines > 4, false) AS many_lines,
 coalesce(discount > 0.05::DOUBLE, false) AS discounted FROM labelled JOIN wide USING (o_orderkey))
 SELECT 'many_lines' AS flag, many_lines AS value, round(avg(y), 6) AS rate, count(y) AS n FROM f GROUP BY many_lines
 UNION ALL SELECT 'discounted', discounted, round(avg(y), 6), count(y) FROM f GROUP BY discounted""")
def rate_by_flag(spark, sf) -> DataFrame:
    lines = w.order_lines(spark, sf).withColumnRenamed("l_orderkey", "o_orderkey")
    df = w.labelled_orders(spark, sf).join(lines, "o_orderkey", "left").withColumns({
        "many_lines": F.col("lines") > 4, "discounted": F.col("discount") > 0.05,
    })
    return rounded(profile.rate_by_flag(df, ["many_lines", "discounted"], "was_canceled"), "rate")


@query(f"""WITH {LABELLED} SELECT count(*) AS "rows", sum(was_canceled::INT)::BIGINT AS positives,
 round(avg(was_canceled::INT), 6) AS rate FROM labelled""")
def target_rate(spark, sf) -> DataFrame:
    return rounded(profile.target_rate(w.labelled_orders(spark, sf), "was_canceled"), "rate")


@query(f"""WITH {LABELLED}, c AS (SELECT was_canceled, count(*) AS n FROM labelled GROUP BY was_canceled)
 SELECT min(n) AS smallest, max(n) AS largest, round(min(n) / max(n)::DOUBLE, 6) AS imbalance FROM c""")
def imbalance_ratio(spark, sf) -> DataFrame:
    return rounded(profile.imbalance_ratio(w.labelled_orders(spark, sf), "was_canceled"), "imbalance")


# --- event log ------------------------------------------------------------------------


@query(f"""WITH {LOG} SELECT count(*) AS "rows", count(DISTINCT plan_id) AS distinct_keys FROM log""")
def log_counts(spark, sf) -> DataFrame:
    return profile.log_counts(w.cancel_log(spark, sf), "plan_id")


COPIES = "g AS (SELECT l_returnflag, l_linestatus, l_quantity, count(*) AS copies FROM lineitem GROUP BY ALL)"
COPY_COLUMNS = ["l_returnflag", "l_linestatus", "l_quantity"]


@query(f"""WITH {COPIES} SELECT sum(copies)::BIGINT AS "rows", count(*) AS distinct_rows, (sum(copies) - count(*))::BIGINT AS removed_rows,
 coalesce(sum(copies) FILTER (copies > 1), 0)::BIGINT AS duplicate_members FROM g""")
def exact_duplicates(spark, sf) -> DataFrame:
    return profile.duplicate_summary(w.table(spark, sf, "lineitem").select(*COPY_COLUMNS))


@query(f"WITH {COPIES} SELECT * FROM g WHERE copies > 1")
def dup_groups(spark, sf) -> DataFrame:
    return profile.duplicate_groups(w.table(spark, sf, "lineitem").select(*COPY_COLUMNS))


@query("""SELECT l_shipdate::VARCHAR AS shipped, l_returnflag, l_quantity FROM (SELECT *, count(*) OVER
 (PARTITION BY l_shipdate, l_returnflag, l_quantity) AS c FROM lineitem) WHERE c > 1""")
def dup_members(spark, sf) -> DataFrame:
    rows = w.table(spark, sf, "lineitem").select("l_shipdate", "l_returnflag", "l_quantity")
    return profile.duplicate_members(rows).select(
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("shipped"), "l_returnflag", "l_quantity"
    )


MULTI = LOG + """, d AS (SELECT DISTINCT * FROM log), multi AS (SELECT plan_id, count(*) AS events FROM d
 WHERE plan_id IS NOT NULL GROUP BY plan_id HAVING count(*) > 1)"""


@query(f"WITH {MULTI} SELECT * FROM multi")
def multi_event_keys(spark, sf) -> DataFrame:
    return profile.multi_event_keys(w.cancel_log(spark, sf), "plan_id")


@query(f"WITH {MULTI} SELECT d.plan_id, cancel_date::VARCHAR AS cancelled, quantity FROM d SEMI JOIN multi USING (plan_id)")
def multi_event_rows(spark, sf) -> DataFrame:
    return _dated(profile.multi_event_rows(w.cancel_log(spark, sf), "plan_id"))


def _dated(df: DataFrame) -> DataFrame:
    return df.select("plan_id", F.date_format("cancel_date", "yyyy-MM-dd HH:mm:ss").alias("cancelled"), "quantity")


@query(f"""WITH {MULTI} SELECT count(*) AS keys, sum(events)::BIGINT AS "rows" FROM multi""")
def multi_event_summary(spark, sf) -> DataFrame:
    return profile.multi_event_summary(w.cancel_log(spark, sf), "plan_id")


@query(f"""WITH {MULTI} SELECT d.plan_id, cancel_date::VARCHAR AS cancelled, quantity FROM d
 WHERE plan_id IN (SELECT plan_id FROM multi ORDER BY plan_id LIMIT 3)""")
def multi_event_examples(spark, sf) -> DataFrame:
    return _dated(profile.example_events(w.cancel_log(spark, sf), "plan_id", ["cancel_date", "quantity"]))


FINISHED = "facts AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), k AS (SELECT DISTINCT plan_id FROM log)"


def _finished(spark, sf) -> DataFrame:
    return w.table(spark, sf, "orders").filter("o_orderstatus = 'F'")


@query(f"""WITH {LOG}, {FINISHED} SELECT count(*) AS log_keys, count(o_orderkey) AS keys_found,
 (count(*) - count(o_orderkey)) AS keys_missing FROM k LEFT JOIN facts ON plan_id = o_orderkey""")
def log_keys_found(spark, sf) -> DataFrame:
    return joins.key_overlap(w.cancel_log(spark, sf), "plan_id", _finished(spark, sf), "o_orderkey")


@query(f"WITH {LOG}, {FINISHED} SELECT count(*) AS keys_missing FROM k WHERE plan_id NOT IN (SELECT o_orderkey FROM facts)")
def log_keys_missing(spark, sf) -> DataFrame:
    facts = _finished(spark, sf).select(F.col("o_orderkey").alias("plan_id"))
    keys = w.cancel_log(spark, sf).select("plan_id").distinct()
    return joins.rows_not_in(keys, facts, ["plan_id"]).agg(F.count("*").alias("keys_missing"))


@query(f"WITH {LOG}, {FINISHED} SELECT plan_id::VARCHAR AS key FROM k WHERE plan_id IN (SELECT o_orderkey FROM facts)")
def key_intersect(spark, sf) -> DataFrame:
    return joins.key_intersection(w.cancel_log(spark, sf), "plan_id", _finished(spark, sf), "o_orderkey")


@query(f"WITH {LOG}, {FINISHED} SELECT plan_id::VARCHAR AS key FROM k WHERE plan_id NOT IN (SELECT o_orderkey FROM facts)")
def key_except(spark, sf) -> DataFrame:
    return joins.key_difference(w.cancel_log(spark, sf), "plan_id", _finished(spark, sf), "o_orderkey")


@query(f"""WITH {MULTI} SELECT o.o_orderkey, o_custkey FROM orders o SEMI JOIN multi ON plan_id = o_orderkey""")
def multi_event_orders(spark, sf) -> DataFrame:
    keys = profile.multi_event_keys(w.cancel_log(spark, sf), "plan_id").select(F.col("plan_id").alias("o_orderkey"))
    return joins.rows_in(w.table(spark, sf, "orders"), keys, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query(f"""SELECT event_id, user_id, row_number() OVER w AS event_no, {ELAPSED.format(a='ts', b='lag(ts) OVER w')} AS days_since_last,
 (epoch_us(ts) - epoch_us(lag(ts) OVER w))::BIGINT AS micros_since_last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def event_sequence(spark, sf) -> DataFrame:
    df = sequence.with_sequence(w.table(spark, sf, "events"), ["user_id"], "ts", ["event_id"])
    gap = F.expr("cast(extract(SECOND FROM (ts - previous_time)) * 1000000 as bigint)")
    whole = F.expr("""extract(DAY FROM (ts - previous_time)) * 86400000000L + extract(HOUR FROM (ts - previous_time)) * 3600000000L
        + extract(MINUTE FROM (ts - previous_time)) * 60000000L""")
    return df.select("event_id", "user_id", "event_no", "days_since_last", (whole + gap).alias("micros_since_last"))


@query(f"""WITH {MULTI}, s AS (SELECT d.plan_id, quantity, cancel_date, lag(cancel_date) OVER w AS prev, row_number() OVER w AS event_no FROM d
 SEMI JOIN multi USING (plan_id) WINDOW w AS (PARTITION BY plan_id ORDER BY cancel_date, quantity))
 SELECT plan_id, quantity, event_no, {ELAPSED.format(a='cancel_date', b='prev')} AS days_since_last FROM s""")
def event_gaps(spark, sf) -> DataFrame:
    rows = profile.multi_event_rows(w.cancel_log(spark, sf), "plan_id")
    df = sequence.with_sequence(rows, ["plan_id"], "cancel_date", ["quantity"])
    return df.select("plan_id", "quantity", "event_no", "days_since_last")


@query(describe_sql("(SELECT count(*) AS events FROM events GROUP BY user_id)", ["events"]))
def events_per_key_describe(spark, sf) -> DataFrame:
    per_key = sequence.events_per_key(w.table(spark, sf, "events"), ["user_id"])
    return rounded(profile.describe(per_key, ["events"]), "value", digits=4)


@query(f"""WITH {MULTI}, lab AS (SELECT o.*, o_orderkey IN (SELECT plan_id FROM log) AS y FROM orders o),
 f AS (SELECT lab.*, o_orderkey IN (SELECT plan_id FROM multi) AS member FROM lab)
 SELECT 'price' AS metric, round(avg(o_totalprice) FILTER (member), 4) AS cohort, round(avg(o_totalprice), 4) AS overall FROM f
 UNION ALL SELECT 'rate_pct', round(avg(y::INT * 100) FILTER (member), 4), round(avg(y::INT * 100), 4) FROM f""")
def cohort_compare(spark, sf) -> DataFrame:
    keys = profile.multi_event_keys(w.cancel_log(spark, sf), "plan_id").select("plan_id")
    df = joins.flag_members(w.labelled_orders(spark, sf), "o_orderkey", keys, "plan_id", "member")
    metrics = {"price": F.col("o_totalprice"), "rate_pct": F.col("was_canceled").cast("int") * 100}
    return rounded(profile.cohort_compare(df, F.col("member"), metrics), "cohort", "overall", digits=4)


@query(f"""WITH {MULTI} SELECT o_orderpriority, count(*) AS n FROM orders SEMI JOIN multi ON plan_id = o_orderkey
 GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority LIMIT 10""")
def cohort_top_values(spark, sf) -> DataFrame:
    keys = profile.multi_event_keys(w.cancel_log(spark, sf), "plan_id").select(F.col("plan_id").alias("o_orderkey"))
    members = joins.rows_in(w.table(spark, sf, "orders"), keys, ["o_orderkey"])
    return profile.value_counts(members, "o_orderpriority").limit(10)


# --- profiles -------------------------------------------------------------------------

WIDE_COLUMNS = ["o_orderkey", "o_totalprice", "first_ship", "part", "supp", "lines", "quantity", "discount", "tax"]


@query(f"WITH {WITH_LINES}, m AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS missing, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 6) AS missing_pct FROM wide"""
    for c in WIDE_COLUMNS) + ") SELECT * FROM m WHERE missing > 0")
def missing_profile(spark, sf) -> DataFrame:
    return rounded(profile.missing_profile(w.orders_with_lines(spark, sf), WIDE_COLUMNS), "missing_pct")


@query("""SELECT 'o_orderkey' AS "column", 'bigint' AS dtype, count(o_orderkey) AS non_null FROM orders
 UNION ALL SELECT 'o_custkey', 'bigint', count(o_custkey) FROM orders
 UNION ALL SELECT 'o_orderstatus', 'string', count(o_orderstatus) FROM orders
 UNION ALL SELECT 'o_totalprice', 'double', count(o_totalprice) FROM orders
 UNION ALL SELECT 'o_orderdate', 'timestamp_ntz', count(o_orderdate) FROM orders
 UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority) FROM orders""")
def schema_profile(spark, sf) -> DataFrame:
    return profile.schema_profile(w.table(spark, sf, "orders"))


@query(f"""WITH {WITH_LINES}, w AS (SELECT o_orderkey, o_totalprice, first_ship, lines, quantity FROM wide)
 SELECT count(*) AS "rows", 5::BIGINT AS columns, ((count(*) > count(first_ship))::INT * 3)::BIGINT AS incomplete_columns,
 CASE WHEN count(*) > count(first_ship) THEN 'first_ship' END AS worst_column,
 CASE WHEN count(*) > count(first_ship) THEN round(100.0 * (count(*) - count(first_ship)) / count(*), 6) END AS worst_pct,
 min(quantity) AS dimension_min, max(quantity) AS dimension_max FROM w""")
def readiness_summary(spark, sf) -> DataFrame:
    df = w.orders_with_lines(spark, sf).select("o_orderkey", "o_totalprice", "first_ship", "lines", "quantity")
    found = profile.readiness(df, "quantity")
    return rounded(found, "worst_pct").withColumns({
        c: F.col(c).cast("long") for c in ("columns", "incomplete_columns")
    })


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(describe_sql("lineitem", LINE_NUMBERS))
def describe(spark, sf) -> DataFrame:
    return rounded(profile.describe(w.table(spark, sf, "lineitem"), LINE_NUMBERS), "value", digits=4)


@query(f"WITH {LABELLED}, f AS (SELECT was_canceled, o_totalprice, o_custkey FROM labelled) " + describe_sql("f", ["o_totalprice", "o_custkey"], "was_canceled"))
def describe_by_target(spark, sf) -> DataFrame:
    df = profile.describe(w.labelled_orders(spark, sf), ["o_totalprice", "o_custkey"], ["was_canceled"])
    return rounded(df, "value", digits=4)


@query("""SELECT min(o_orderdate)::VARCHAR AS first_day, max(o_orderdate)::VARCHAR AS last_day, round(min(o_totalprice), 4) AS low,
 round(max(o_totalprice), 4) AS high, round(avg(o_totalprice), 4) AS mean FROM orders""")
def range_stats(spark, sf) -> DataFrame:
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return w.table(spark, sf, "orders").agg(
        stamp(F.min("o_orderdate")).alias("first_day"), stamp(F.max("o_orderdate")).alias("last_day"),
        r(F.min("o_totalprice"), 4).alias("low"), r(F.max("o_totalprice"), 4).alias("high"),
        r(F.avg("o_totalprice"), 4).alias("mean"),
    )


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(avg({c}), 4) AS mean FROM lineitem""" for c in LINE_NUMBERS))
def numeric_ranges(spark, sf) -> DataFrame:
    return rounded(profile.ranges(w.table(spark, sf, "lineitem"), LINE_NUMBERS), "min", "max", "mean", digits=4)


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name")
def value_counts(spark, sf) -> DataFrame:
    return profile.value_counts(w.table(spark, sf, "part"), "p_name")


@query("""SELECT p_type, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM part GROUP BY p_type""")
def value_share(spark, sf) -> DataFrame:
    return rounded(profile.value_shares(w.table(spark, sf, "part"), "p_type"), "share")


@query("""SELECT 'user_id' AS "column", count(DISTINCT user_id) AS n_distinct FROM events
 UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM events UNION ALL SELECT 'props', count(DISTINCT props) FROM events""")
def distinct_counts(spark, sf) -> DataFrame:
    return profile.distinct_counts(w.table(spark, sf, "events"), ["user_id", "event_type", "props"])


@query(f"""WITH {LABELLED}, {WITH_LINES}, j AS (SELECT was_canceled::INT AS y, coalesce(p_name, '__MISSING__') AS p_name, coalesce(p_brand, '__MISSING__') AS p_brand,
 coalesce(p_size::VARCHAR, '__MISSING__') AS p_size FROM labelled l JOIN wide USING (o_orderkey) LEFT JOIN part ON p_partkey = part),
 g AS (SELECT 'p_name' AS "column", p_name AS value, avg(y) AS rate, count(*) AS n FROM j GROUP BY p_name UNION ALL SELECT 'p_brand', p_brand, avg(y), count(*) FROM j GROUP BY p_brand
 UNION ALL SELECT 'p_size', p_size, avg(y), count(*) FROM j GROUP BY p_size),
 k AS (SELECT *, count(*) OVER (PARTITION BY "column") AS n_distinct, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, rate DESC, value) AS place FROM g)
 SELECT "column", value, round(rate, 6) AS rate, n, n_distinct, place FROM k WHERE place <= CASE WHEN "column" = 'p_size' THEN (CASE WHEN n_distinct > 15 THEN 15 ELSE n_distinct END)
 WHEN n_distinct > 50 THEN 20 ELSE n_distinct END""")
def topk_by_cardinality(spark, sf) -> DataFrame:
    part = w.table(spark, sf, "part").withColumnRenamed("p_partkey", "part")
    lines = w.order_lines(spark, sf).withColumnRenamed("l_orderkey", "o_orderkey")
    df = w.labelled_orders(spark, sf).join(lines, "o_orderkey", "left").join(part, "part", "left")
    top = profile.rate_profile(df, ["p_name", "p_brand", "p_size"], "was_canceled", high_cardinality=["p_size"])
    return rounded(top, "rate").withColumn("place", F.col("place").cast("long"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem
 ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10""")
def ordered_head(spark, sf) -> DataFrame:
    return (
        w.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
        .orderBy(F.desc("l_quantity"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(10)
    )


# --- projections, coercion, cleaning ---------------------------------------------------


@query("SELECT o_orderkey AS plan_id, o_custkey AS patient_id, o_totalprice AS price FROM orders")
def rename_project(spark, sf) -> DataFrame:
    names = {"o_orderkey": "plan_id", "o_custkey": "patient_id", "o_totalprice": "price", "absent": "x"}
    df = projection.drop_columns(projection.rename(w.table(spark, sf, "orders"), names), ["o_orderdate", "absent"])
    return projection.select_existing(df, ["plan_id", "patient_id", "missing", "price"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def numeric_projection(spark, sf) -> DataFrame:
    df = w.table(spark, sf, "orders")
    return df.select(*projection.numeric_columns(df))


EVENT_TEXT = "e AS (SELECT event_id, regexp_extract(props, '[0-9]+') AS digits, props FROM events)"


@query(f"""WITH {EVENT_TEXT} SELECT event_id, TRY_CAST(digits AS DOUBLE) AS from_digits, TRY_CAST(props AS DOUBLE) AS from_text FROM e""")
def coerce_numeric(spark, sf) -> DataFrame:
    digits = F.regexp_extract("props", "[0-9]+", 0)
    return w.table(spark, sf, "events").select(
        "event_id", clean.to_number(digits).alias("from_digits"), clean.to_number("props").alias("from_text")
    )


@query(f"""WITH {EVENT_TEXT} SELECT 'digits' AS "column", count(digits) AS before, count(TRY_CAST(digits AS DOUBLE)) AS after,
 count(digits) > 0 AND count(TRY_CAST(digits AS DOUBLE)) = 0 AS became_empty FROM e
 UNION ALL SELECT 'props', count(props), count(TRY_CAST(props AS DOUBLE)), count(props) > 0 AND count(TRY_CAST(props AS DOUBLE)) = 0 FROM e""")
def coercion_check(spark, sf) -> DataFrame:
    df = w.table(spark, sf, "events").withColumn("digits", F.regexp_extract("props", "[0-9]+", 0))
    return profile.all_null_after_coercion(df, {"digits": clean.to_number("digits"), "props": clean.to_number("props")})


@query("""SELECT event_id, strftime(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN props ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP),
 '%Y-%m-%d %H:%M:%S') AS stamp FROM events""")
def coerce_timestamp(spark, sf) -> DataFrame:
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("props")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    stamp = F.date_format(clean.to_timestamp(mixed), "yyyy-MM-dd HH:mm:ss")
    return w.table(spark, sf, "events").select("event_id", stamp.alias("stamp"))


@query("""SELECT c_custkey, CASE WHEN c_acctbal IS NOT NULL THEN least(greatest(c_acctbal, 10.0::DOUBLE), 70.0::DOUBLE) END AS clipped FROM customer""")
def clip(spark, sf) -> DataFrame:
    return w.table(spark, sf, "customer").select("c_custkey", clean.clip("c_acctbal", 10.0, 70.0).alias("clipped"))


@query("""SELECT count(c_acctbal) AS present, count(*) FILTER (c_acctbal < 10 OR c_acctbal > 70) AS out_of_range FROM customer""")
def out_of_range(spark, sf) -> DataFrame:
    return profile.out_of_range(w.table(spark, sf, "customer"), "c_acctbal", 10, 70)


@query(f"WITH {WITH_LINES} SELECT o_orderkey, coalesce(lines, 0) AS lines, coalesce(part::VARCHAR, '__MISSING__') AS part FROM wide")
def fill_const(spark, sf) -> DataFrame:
    df = w.orders_with_lines(spark, sf)
    return df.select("o_orderkey", clean.fill("lines", 0).alias("lines"), clean.category("part").alias("part"))


@query(f"""WITH {WITH_LINES} SELECT o_orderkey, round(coalesce(quantity, (SELECT median(quantity) FROM wide)), 4) AS quantity FROM wide""")
def fill_median(spark, sf) -> DataFrame:
    from riskframe.operators.ranks import medians
    df = w.orders_with_lines(spark, sf).select("o_orderkey", "quantity")
    return df.select("o_orderkey", r(clean.fill("quantity", medians(df, ["quantity"]).scalar()), 4).alias("quantity"))


@query("""SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN '__MISSING__' ELSE event_type END AS event_type FROM events""")
def replace_tokens(spark, sf) -> DataFrame:
    return w.table(spark, sf, "events").select(
        "event_id", clean.replace_values("event_type", ["error", "view"], "__MISSING__").alias("event_type")
    )


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'HIGH' ELSE o_orderstatus END AS status FROM orders WHERE o_orderpriority IS NOT NULL""")
def masked_assign(spark, sf) -> DataFrame:
    df = w.table(spark, sf, "orders").filter(F.col("o_orderpriority").isNotNull())
    return df.select("o_orderkey", clean.masked(F.col("o_totalprice") > 100000, "HIGH", "o_orderstatus").alias("status"))


@query(f"WITH {LABELLED} SELECT o_orderkey, was_canceled::INT AS label, (o_orderkey % 2 = 1) AS odd FROM labelled")
def flag_casts(spark, sf) -> DataFrame:
    return w.labelled_orders(spark, sf).select(
        "o_orderkey", clean.flag_to_int("was_canceled").alias("label"),
        clean.flag_or_false((F.col("o_orderkey") % 2).cast("int")).alias("odd"),
    )


@query("SELECT doc_id, text FROM documents WHERE trim(text, ' \t\n\r') <> '' ORDER BY doc_id LIMIT 5")
def nonempty_examples(spark, sf) -> DataFrame:
    return projection.first_texts(w.table(spark, sf, "documents"), "text", "doc_id")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5")
def preview(spark, sf) -> DataFrame:
    return projection.preview(w.table(spark, sf, "orders"), ["o_orderkey", "o_orderstatus", "absent", "o_totalprice"], "o_orderkey")


@query("""SELECT p_partkey, trim(p_name) AS name, p_brand || '_' || p_size AS brand_size,
 regexp_replace(trim(regexp_replace(p_brand || ' _' || p_size, '\\s+', ' ', 'g')), '\\s*([0-9]+)$', '_\\1') AS site_room,
 lower(replace(p_name, ' ', '_')) AS slug FROM part""")
def site_room(spark, sf) -> DataFrame:
    return w.table(spark, sf, "part").select(
        "p_partkey", clean.strip("p_name").alias("name"), text.joined("p_brand", "p_size").alias("brand_size"),
        text.site_room(F.concat("p_brand", F.lit(" ")), "p_size").alias("site_room"), text.slug("p_name").alias("slug"),
    )


@query(f"""WITH {WITH_LINES} SELECT o_orderkey, coalesce(part::VARCHAR, 'nan') AS part_key, coalesce(o_orderpriority, 'nan') || '_' || coalesce(supp::VARCHAR, 'nan') AS pair FROM wide""")
def key_tokens(spark, sf) -> DataFrame:
    return w.orders_with_lines(spark, sf).select(
        "o_orderkey", clean.key_text("part").alias("part_key"), text.joined("o_orderpriority", "supp").alias("pair")
    )


@query("SELECT c_custkey, trim(c_mktsegment) AS segment, c_nationkey::VARCHAR AS nation FROM customer")
def strip_keys(spark, sf) -> DataFrame:
    padded = F.concat(F.lit("\t  "), F.col("c_mktsegment"), F.lit("  "))
    return w.table(spark, sf, "customer").select(
        "c_custkey", clean.strip(padded).alias("segment"), clean.key_text("c_nationkey").alias("nation")
    )


@query("""SELECT doc_id, CASE WHEN trim(text, ' \t\n\r') = '' THEN 0 ELSE len(string_split(text, ',')) END::BIGINT AS items FROM documents""")
def item_count(spark, sf) -> DataFrame:
    return w.table(spark, sf, "documents").select("doc_id", text.count_items("text").alias("items"))


@query("""SELECT c_custkey, (floor((c_acctbal / 100) / 10) * 10)::BIGINT AS decade, round(c_acctbal / 7, 3) AS third, abs(c_acctbal) AS size FROM customer""")
def decade(spark, sf) -> DataFrame:
    return w.table(spark, sf, "customer").select(
        "c_custkey", dates.decade(F.col("c_acctbal") / 100).alias("decade"),
        F.round(F.col("c_acctbal") / 7, 3).alias("third"), F.abs("c_acctbal").alias("size"),
    )


@query("""SELECT p_partkey, CASE WHEN v < 0 THEN '__MISSING__' WHEN v < 5 THEN '0-5 km' WHEN v < 10 THEN '5-10 km' WHEN v < 20 THEN '10-20 km'
 WHEN v < 50 THEN '20-50 km' WHEN v < 100 THEN '50-100 km' WHEN v < 200 THEN '100-200 km' WHEN v < 500 THEN '200-500 km' ELSE '500+ km' END AS distance,
 CASE WHEN p_size < 18.5 THEN 'Underweight' WHEN p_size < 24.9 THEN 'Normal' WHEN p_size < 29.9 THEN 'Overweight' WHEN p_size < 34.9 THEN 'Obese_I'
 WHEN p_size < 39.9 THEN 'Obese_II' ELSE 'Obese_III' END AS bmi FROM (SELECT *, (p_retailprice - 1100) * 3 AS v FROM part)""")
def bin_edges(spark, sf) -> DataFrame:
    from riskframe.functions.fixed import BMI_EDGES, BMI_LABELS, DISTANCE_EDGES
    return w.table(spark, sf, "part").select(
        "p_partkey",
        bins.bin_label((F.col("p_retailprice") - 1100) * 3, DISTANCE_EDGES, bins.DISTANCE_LABELS).alias("distance"),
        bins.bin_label("p_size", BMI_EDGES, BMI_LABELS).alias("bmi"),
    )


#: A double with nulls, NaN and both zeros, derived from the order prices.
GAPS = """gaps AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN NULL
 WHEN o_orderkey % 5 = 2 THEN 0.0::DOUBLE ELSE floor(o_totalprice / 1000) END AS x FROM orders)"""


def _gaps(spark, sf) -> DataFrame:
    k = F.col("o_orderkey") % 5
    x = F.when(k == 0, F.lit(None)).when(k == 1, F.lit("NaN").cast("double")).when(k == 2, F.when(
        F.col("o_orderkey") % 2 == 0, F.lit("-0.0").cast("double")).otherwise(F.lit(0.0))).otherwise(F.floor(F.col("o_totalprice") / 1000).cast("double"))
    return w.table(spark, sf, "orders").select("o_orderkey", x.alias("x"))


@query(f"""WITH {GAPS} SELECT 'x' AS "column", (count(*) - count(x)) AS missing, round(100.0::DOUBLE * (count(*) - count(x)) / count(*), 4) AS missing_pct FROM gaps""")
def missing_with_nan(spark, sf) -> DataFrame:
    return rounded(profile.missing_profile(_gaps(spark, sf)), "missing_pct", digits=4)


@query(f"""WITH {GAPS} SELECT 'x' AS "column", count(DISTINCT x) AS n_distinct FROM gaps""")
def distinct_with_nan(spark, sf) -> DataFrame:
    return profile.distinct_counts(_gaps(spark, sf), ["x"])


@query(f"""WITH {GAPS} SELECT x, count(*) AS n FROM gaps WHERE x IS NOT NULL GROUP BY x""")
def value_counts_with_nan(spark, sf) -> DataFrame:
    return profile.value_counts(_gaps(spark, sf), "x")


@query(f"""WITH {GAPS} SELECT count(*) AS rows, 2 AS columns, 1 AS incomplete_columns, 'x' AS worst_column,
 round(100.0::DOUBLE * (count(*) - count(x)) / count(*), 4) AS worst_pct, min(x) AS dimension_min, max(x) AS dimension_max FROM gaps""")
def readiness_with_nan(spark, sf) -> DataFrame:
    return rounded(profile.readiness(_gaps(spark, sf), "x"), "worst_pct", digits=4)
