"""Queries: calendar features, smoothed rates, the engineered table, preprocessing, splits."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from riskframe.functions import bins, dates
from riskframe.functions.fixed import WAIT_DAYS_EDGES, WAIT_DAYS_LABELS
from riskframe.operators import calendar, encode, joins, profile, rates, resample, stratify
from riskframe.plans import features, workload as w
from riskframe.plans.catalog import ELAPSED, LABELLED, LOG, WITH_LINES, query, r, rounded
from riskframe.session import fresh_path, stage
from riskframe.sources import sinks

# --- SQL fragments --------------------------------------------------------------------

HOLIDAYS = "hol AS (SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in w.holiday_dates()) + "]) AS h)"

NEAREST = """days AS (SELECT DISTINCT first_ship::DATE AS d FROM wide WHERE first_ship IS NOT NULL),
 near AS (SELECT d, min(CASE WHEN h >= d THEN h - d END) AS nxt, min(CASE WHEN h <= d THEN d - h END) AS prv,
 max((h = d - 1)::INT) = 1 OR dayname(d - 1) IN ('Friday', 'Saturday') AS after FROM days, hol GROUP BY d)"""

WAIT_BUCKET = """CASE WHEN {v} IS NULL THEN '__MISSING__' WHEN {v} < 7 THEN '0-7 days' WHEN {v} < 30 THEN '8-30 days'
 WHEN {v} < 90 THEN '31-90 days' WHEN {v} < 365 THEN '91-365 days' ELSE '365+ days' END"""

SEASON = """CASE WHEN month({d}) IN (12, 1, 2) THEN 'Winter' WHEN month({d}) IN (3, 4, 5) THEN 'Spring'
 WHEN month({d}) IN (6, 7, 8) THEN 'Summer' WHEN month({d}) IN (9, 10, 11) THEN 'Fall' END"""


def smooth_sql(column: str, name: str, table: str = "base") -> str:
    """Join fragment for one smoothed rate: (subquery, select expression)."""
    return f"""{name}_t AS (SELECT {column}, (sum(was_canceled::INT) + 1)::DOUBLE / (count(*) + 2) AS {name} FROM {table}
 WHERE {column} IS NOT NULL AND {column} <> 'nan' GROUP BY {column}),
 {name}_g AS (SELECT (sum(was_canceled::INT) + 1)::DOUBLE / (count(*) + 2) AS {name}_all FROM {table} WHERE {column} IS NOT NULL AND {column} <> 'nan')"""


# --- calendar -------------------------------------------------------------------------


@query(f"WITH {WITH_LINES} SELECT o_orderkey, {ELAPSED.format(a='first_ship', b='o_orderdate')} AS wait_days FROM wide")
def wait_days(spark, sf) -> DataFrame:
    return w.orders_with_lines(spark, sf).select(
        "o_orderkey", dates.elapsed_days("first_ship", "o_orderdate").alias("wait_days")
    )


@query(f"""WITH {WITH_LINES}, d AS (SELECT {ELAPSED.format(a='first_ship', b='o_orderdate')} AS v FROM wide),
 b AS (SELECT {WAIT_BUCKET.format(v='v')} AS wait_days_category FROM d) SELECT wait_days_category, count(*) AS n FROM b GROUP BY ALL""")
def wait_bucket(spark, sf) -> DataFrame:
    wait = dates.elapsed_days("first_ship", "o_orderdate")
    df = w.orders_with_lines(spark, sf).select(bins.bin_label(wait, WAIT_DAYS_EDGES, WAIT_DAYS_LABELS).alias("wait_days_category"))
    return df.groupBy("wait_days_category").agg(F.count("*").alias("n"))


@query(f"""WITH {WITH_LINES} SELECT o_orderkey, dayname(first_ship) AS weekday, {SEASON.format(d='first_ship')} AS season,
 coalesce(dayname(first_ship) IN ('Friday', 'Saturday'), false) AS weekend FROM wide""")
def weekday_season(spark, sf) -> DataFrame:
    return w.orders_with_lines(spark, sf).select(
        "o_orderkey", dates.day_name("first_ship").alias("weekday"), dates.season("first_ship").alias("season"),
        dates.is_weekend("first_ship").alias("weekend"),
    )


def _with_holidays(spark, sf) -> DataFrame:
    return calendar.add_holiday_features(w.orders_with_lines(spark, sf), "first_ship", w.holidays(spark))


@query(f"""WITH {WITH_LINES}, {HOLIDAYS}, {NEAREST} SELECT o_orderkey, coalesce(nxt, 999)::DOUBLE AS days_to_next_holiday,
 coalesce(prv, 999)::DOUBLE AS days_from_prev_holiday FROM wide LEFT JOIN near ON d = first_ship::DATE""")
def holiday_next_prev(spark, sf) -> DataFrame:
    return _with_holidays(spark, sf).select("o_orderkey", "days_to_next_holiday", "days_from_prev_holiday")


@query(f"""WITH {WITH_LINES}, {HOLIDAYS}, {NEAREST}, flags AS (SELECT coalesce(least(coalesce(nxt, 999), coalesce(prv, 999)) <= 3, false) AS near_holiday FROM wide LEFT JOIN near ON d = first_ship::DATE)
 SELECT near_holiday, count(*) AS n FROM flags GROUP BY near_holiday""")
def near_holiday(spark, sf) -> DataFrame:
    return _with_holidays(spark, sf).groupBy("near_holiday").agg(F.count("*").alias("n"))


@query(f"""WITH {WITH_LINES}, {HOLIDAYS}, {NEAREST}, flags AS (SELECT coalesce(after, false) AS after_holiday_weekend FROM wide LEFT JOIN near ON d = first_ship::DATE)
 SELECT after_holiday_weekend, count(*) AS n FROM flags GROUP BY ALL""")
def after_holiday_weekend(spark, sf) -> DataFrame:
    df = _with_holidays(spark, sf).withColumnRenamed("is_surgery_after_holiday_weekend", "after_holiday_weekend")
    return df.groupBy("after_holiday_weekend").agg(F.count("*").alias("n"))


# --- lookups and rates ----------------------------------------------------------------


@query("""SELECT c_custkey, n_name, n_regionkey::BIGINT AS region FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey""")
def dim_lookup(spark, sf) -> DataFrame:
    dim = w.table(spark, sf, "nation").filter("n_regionkey <> 2").withColumn("region", F.col("n_regionkey").cast("long"))
    df = joins.lookup(w.table(spark, sf, "customer"), "c_nationkey", dim, "n_nationkey", ["n_name", "region"])
    return df.select("c_custkey", "n_name", "region")


@query("""SELECT c_custkey, coalesce(n_regionkey, (SELECT median(n_regionkey) FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> 2))::DOUBLE AS cluster
 FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey""")
def city_cluster(spark, sf) -> DataFrame:
    customers = w.table(spark, sf, "customer").withColumn("city", F.col("c_nationkey").cast("string"))
    df = features.add_city_cluster(customers, w.city_dim(spark, sf))
    return df.select("c_custkey", F.col("socioeconomic_cluster").alias("cluster"))


@query(f"""WITH {LABELLED}, base AS (SELECT was_canceled, o_custkey::VARCHAR AS cust FROM labelled), {smooth_sql('cust', 'rate')}
 SELECT cust, round(rate, 6) AS rate FROM rate_t""")
def smoothed_rate(spark, sf) -> DataFrame:
    df = w.labelled_orders(spark, sf).withColumn("cust", F.col("o_custkey").cast("string"))
    fitted = rates.fit_smoothed_rates(df, {"rate": "cust"}, "was_canceled")
    rate = rates.smoothed(F.col("positives"), F.col("rows"))
    return fitted.table.select(F.col("category").alias("cust"), r(rate).alias("rate"))


@query(f"""WITH {LABELLED}, {WITH_LINES}, base AS (SELECT o_orderkey, was_canceled, CASE WHEN supp % 3 > 0 THEN part::VARCHAR END AS cat FROM labelled JOIN wide USING (o_orderkey)),
 {smooth_sql('cat', 'rate')} SELECT o_orderkey, round(coalesce(rate, rate_all), 6) AS rate FROM base LEFT JOIN rate_t USING (cat) CROSS JOIN rate_g""")
def smoothed_rate_global_fill(spark, sf) -> DataFrame:
    lines = w.order_lines(spark, sf).withColumnRenamed("l_orderkey", "o_orderkey")
    df = w.labelled_orders(spark, sf).join(lines, "o_orderkey", "left").withColumn(
        "cat", F.when(F.col("supp") % 3 > 0, F.col("part").cast("string"))
    )
    fitted = rates.fit_smoothed_rates(df, {"rate": "cat"}, "was_canceled")
    return fitted.transform(df).select("o_orderkey", r("rate"))


@query(f"""WITH {WITH_LINES} SELECT o_orderkey, ((first_ship IS NOT NULL)::INT + (quantity IS NOT NULL)::INT + (discount > 0.05::DOUBLE AND discount IS NOT NULL)::INT)::BIGINT AS present FROM wide""")
def nonnull_count(spark, sf) -> DataFrame:
    df = w.orders_with_lines(spark, sf).withColumn("big", F.when(F.col("discount") > 0.05, F.col("discount")))
    return df.select("o_orderkey", profile.horizontal_present(["first_ship", "quantity", "big"]).alias("present"))


# --- the engineered table -------------------------------------------------------------

PLANS = WITH_LINES + """, plans AS (SELECT o_orderkey, o_orderkey::VARCHAR AS plan_id, o_orderdate AS request_date, first_ship AS surgery_date,
 p_size::VARCHAR AS room, c_mktsegment AS anesthesia, p_name AS procedure_code, p_type AS surgery_site, c_acctbal / 100 AS age,
 CASE WHEN supp % 7 > 0 THEN p_size END AS bmi, CASE WHEN lines >= 2 THEN 1 END AS l1, CASE WHEN quantity >= 50 THEN 1 END AS l2,
 CASE WHEN discount >= 0.05::DOUBLE THEN 1 END AS l3, CASE WHEN tax >= 0.04::DOUBLE THEN 1 END AS l4, CASE WHEN p_size >= 10 THEN 1 END AS l5,
 CASE WHEN p_retailprice >= 1000 THEN 1 END AS l6, CASE WHEN c_acctbal >= 0 THEN 1 END AS l7, p_name, p_brand, c_nationkey, supp AS km
 FROM wide LEFT JOIN part ON p_partkey = part LEFT JOIN customer ON c_custkey = o_custkey)"""

ENGINEERED = f"""WITH {LOG}, {PLANS}, {HOLIDAYS}, {NEAREST}, first_features AS (SELECT *, o_orderkey IN (SELECT plan_id FROM log) AS was_canceled,
 {ELAPSED.format(a='surgery_date', b='request_date')} AS wait_days, coalesce(dayname(surgery_date), '<NA>') AS wd,
 coalesce(l1, 0) + coalesce(l2, 0) + coalesce(l3, 0) + coalesce(l4, 0) + coalesce(l5, 0) + coalesce(l6, 0) + coalesce(l7, 0) AS labs,
 regexp_replace(coalesce(surgery_site, 'nan') || '_' || coalesce(room, 'nan'), '\\s*([0-9]+)$', '_\\1') AS site_room,
 CASE WHEN km IS NULL THEN '__MISSING__' WHEN km < 5 THEN '0-5 km' WHEN km < 10 THEN '5-10 km' WHEN km < 20 THEN '10-20 km'
 WHEN km < 50 THEN '20-50 km' WHEN km < 100 THEN '50-100 km' WHEN km < 200 THEN '100-200 km' WHEN km < 500 THEN '200-500 km' ELSE '500+ km' END AS distance_bucket
 FROM plans), base AS (SELECT f.*, n_regionkey FROM first_features f LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey),
 {smooth_sql('site_room', 'r1')}, {smooth_sql('anesthesia', 'r2')}, {smooth_sql('procedure_code', 'r3')}, {smooth_sql('wd', 'r4')}, {smooth_sql('distance_bucket', 'r5')}
 SELECT plan_id, was_canceled, wait_days, {WAIT_BUCKET.format(v='wait_days')} AS wait_days_category, dayname(surgery_date) AS surgery_weekday,
 wd IN ('Friday', 'Saturday') AS is_weekend, {SEASON.format(d='surgery_date')} AS season, coalesce(nxt, 999)::DOUBLE AS days_to_next_holiday,
 coalesce(prv, 999)::DOUBLE AS days_from_prev_holiday, coalesce(after, false) AS is_surgery_after_holiday_weekend,
 coalesce(least(coalesce(nxt, 999), coalesce(prv, 999)) <= 3, false) AS near_holiday, (floor(age / 10) * 10)::BIGINT AS age_decade,
 bmi IS NULL AS bmi_missing, CASE WHEN bmi IS NULL THEN '__MISSING__' WHEN bmi < 18.5 THEN 'Underweight' WHEN bmi < 24.9 THEN 'Normal' WHEN bmi < 29.9 THEN 'Overweight'
 WHEN bmi < 34.9 THEN 'Obese_I' WHEN bmi < 39.9 THEN 'Obese_II' ELSE 'Obese_III' END AS bmi_category, labs::BIGINT AS num_existing_labs, labs < 7 AS has_missing_labs,
 coalesce(len(string_split(replace(p_name, ' ', ','), ',')), 0)::BIGINT AS num_medications, coalesce(len(string_split(replace(p_brand, '#', ','), ',')), 0)::BIGINT AS num_diagnoses,
 coalesce(n_regionkey, (SELECT median(n_regionkey) FROM base))::DOUBLE AS socioeconomic_cluster, base.site_room, base.distance_bucket,
 round(coalesce(r1, r1_all), 6) AS site_room_cancel_rate_smoothed, round(coalesce(r2, r2_all), 6) AS anesthesia_cancel_rate_smoothed,
 round(coalesce(r3, r3_all), 6) AS procedure_code_cancel_rate_smoothed, round(coalesce(r4, r4_all), 6) AS weekday_cancel_rate_smoothed,
 round(coalesce(r5, r5_all), 6) AS distance_bucket_cancel_rate_smoothed
 FROM base LEFT JOIN near ON d = surgery_date::DATE LEFT JOIN r1_t USING (site_room) LEFT JOIN r2_t USING (anesthesia) LEFT JOIN r3_t USING (procedure_code)
 LEFT JOIN r4_t USING (wd) LEFT JOIN r5_t USING (distance_bucket) CROSS JOIN r1_g CROSS JOIN r2_g CROSS JOIN r3_g CROSS JOIN r4_g CROSS JOIN r5_g"""

ENGINEERED_COLUMNS = [
    "plan_id", "was_canceled", "wait_days", "wait_days_category", "surgery_weekday", "is_weekend", "season",
    "days_to_next_holiday", "days_from_prev_holiday", "is_surgery_after_holiday_weekend", "near_holiday",
    "age_decade", "bmi_missing", "bmi_category", "num_existing_labs", "has_missing_labs", "num_medications",
    "num_diagnoses", "socioeconomic_cluster", "site_room", "distance_bucket",
]


def engineered(spark, sf) -> DataFrame:
    return features.engineer(w.plans(spark, sf, "was_canceled"), None, w.holidays(spark), w.city_dim(spark, sf))


@query(ENGINEERED)
def engineered_features(spark, sf) -> DataFrame:
    df = engineered(spark, sf)
    return df.select(*ENGINEERED_COLUMNS, *[r(c) for c in features.RATES])


@query(f"""WITH {PLANS} SELECT p_brand, count(*) AS n, sum(labs)::BIGINT AS labs FROM (SELECT *, coalesce(l1, 0) + coalesce(l2, 0) + coalesce(l3, 0)
 + coalesce(l4, 0) + coalesce(l5, 0) + coalesce(l6, 0) + coalesce(l7, 0) AS labs FROM plans) GROUP BY p_brand""")
def engineered_roundtrip(spark, sf) -> DataFrame:
    path = fresh_path(spark, "engineered")
    sinks.write_table(features.row_features(w.plans(spark, sf)), path)
    back = spark.read.parquet(path).withColumnRenamed("department", "p_brand")
    return back.groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("num_existing_labs").alias("labs"))


# --- preprocessing --------------------------------------------------------------------

NUMERIC = ["quantity", "discount", "o_totalprice", "lines"]


@query(f"WITH {WITH_LINES}" + " UNION ALL ".join(
    f""" SELECT '{c}' AS "column", round(median({c}), 4) AS median, round(avg(coalesce({c}, (SELECT median({c}) FROM wide))), 4) AS mean,
 round(stddev_pop(coalesce({c}, (SELECT median({c}) FROM wide))), 4) AS scale FROM wide""" for c in NUMERIC))
def scale_params(spark, sf) -> DataFrame:
    df = stage(w.orders_with_lines(spark, sf).select("o_orderkey", *NUMERIC))
    return rounded(encode.scaling_params(df, NUMERIC), "median", "mean", "scale", digits=4).drop("position")


@query(f"""WITH {WITH_LINES}, p AS (SELECT median(quantity) AS m FROM wide), f AS (SELECT o_orderkey, coalesce(quantity, m) AS q FROM wide, p),
 s AS (SELECT avg(q) AS a, stddev_pop(q) AS d FROM f) SELECT o_orderkey, round((q - a) / d, 5) AS quantity FROM f, s""")
def impute_scale(spark, sf) -> DataFrame:
    df = stage(w.orders_with_lines(spark, sf).select("o_orderkey", "quantity", "o_orderpriority"))
    fitted = encode.fit_preprocessor(df, ["quantity"], ["o_orderpriority"])
    return rounded(fitted.scaled(df), "quantity", digits=5).select("o_orderkey", "quantity")


CATEGORICAL = ["p_type", "p_name", "p_container"]

VOCABULARY = """cells AS (SELECT p_partkey, 'p_type' AS "column", p_type AS category FROM part UNION ALL SELECT p_partkey, 'p_name', p_name FROM part
 UNION ALL SELECT p_partkey, 'p_container', p_brand || '-' || p_size FROM part),
 c AS (SELECT "column", category, count(*) AS n FROM cells GROUP BY "column", category),
 v AS (SELECT "column", category, n, n < 10 AS rare, CASE WHEN n < 10 THEN "column" || '_infrequent_sklearn' ELSE "column" || '_' || category END AS name FROM c),
 vocab AS (SELECT v.*, CASE WHEN rare THEN coalesce(width, 0) ELSE row_number() OVER (PARTITION BY v."column", rare ORDER BY category) - 1 END AS slot
 FROM v LEFT JOIN (SELECT "column", count(*) AS width FROM v WHERE NOT rare GROUP BY "column") k ON k."column" = v."column")"""


def _part_categories(spark, sf) -> DataFrame:
    return w.table(spark, sf, "part").select(
        "p_partkey", "p_type", "p_name", F.concat_ws("-", "p_brand", "p_size").alias("p_container")
    )


@query(f"""WITH {VOCABULARY} SELECT "column", category, n, name, rare, slot::BIGINT AS slot FROM vocab""")
def onehot_vocab(spark, sf) -> DataFrame:
    vocab = encode.vocabulary(_part_categories(spark, sf), CATEGORICAL)
    return vocab.withColumn("slot", F.col("slot").cast("long"))


@query(f"""WITH {VOCABULARY} SELECT p_partkey, cells."column", name FROM cells JOIN v ON v."column" = cells."column" AND v.category = cells.category""")
def onehot_long(spark, sf) -> DataFrame:
    df = _part_categories(spark, sf)
    return encode.one_hot_long(df, "p_partkey", CATEGORICAL, encode.vocabulary(df, CATEGORICAL))


@query(f"""WITH {VOCABULARY}, names AS (SELECT DISTINCT "column", slot, name FROM vocab), o AS (SELECT name, row_number() OVER
 (ORDER BY CASE "column" WHEN 'p_type' THEN 0 WHEN 'p_name' THEN 1 ELSE 2 END, slot) + 1 AS position FROM names)
 SELECT 0::BIGINT AS position, 'p_size' AS name UNION ALL SELECT 1, 'p_retailprice' UNION ALL SELECT position, name FROM o""")
def feature_names(spark, sf) -> DataFrame:
    vocab = encode.vocabulary(_part_categories(spark, sf), CATEGORICAL)
    names = encode.feature_names(vocab, ["p_size", "p_retailprice"], CATEGORICAL)
    return names.withColumn("position", F.col("position").cast("long"))


_MATRICES: dict[tuple[str, str], features.Matrices] = {}


def model_matrices(spark, sf) -> features.Matrices:
    """Matrices of the plan table, written once per application and folder: the model queries
    hand them over by files, as the steps of an analysis do."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _MATRICES:
        prepared, spec = features.prepare(engineered(spark, sf))
        built = features.build_matrices(stage(prepared), spec)
        _MATRICES[at] = features.Matrices(stage(built.data), built.preprocessor, spec)
    return _MATRICES[at]


@query()
def model_matrix(spark, sf) -> DataFrame:
    """Split, fitted and encoded features of all plans, written and read back."""
    matrices = model_matrices(spark, sf)
    path = sinks.write_matrix(matrices.data, fresh_path(spark, "matrix"))
    data = sinks.read_matrix(spark, path)
    vector = vector_to_array("features")
    return data.select(
        "plan_id", "was_canceled", "is_test", F.size(vector).alias("width"),
        F.round(F.aggregate(vector, F.lit(0.0), lambda a, v: a + v), 4).alias("total"),
    )


# --- split, folds, over-sampling ------------------------------------------------------

SIZES = LABELLED + """, c AS (SELECT was_canceled::INT AS y, count(*) AS n FROM labelled GROUP BY ALL), t AS (SELECT sum(n)::BIGINT AS total FROM c),
 q AS (SELECT y, n, n * (total - ceil(total * 0.25::DOUBLE))::DOUBLE / total AS exact, total - ceil(total * 0.25::DOUBLE) AS train_total FROM c, t),
 k AS (SELECT y, n, floor(exact) AS base, train_total - sum(floor(exact)) OVER () AS missing, row_number() OVER (ORDER BY exact - floor(exact) DESC, y) AS place FROM q),
 sizes AS (SELECT y, n, (base + (place <= missing)::INT)::BIGINT AS train_n FROM k)"""


@query(f"""WITH {SIZES} SELECT y, false AS is_test, train_n AS n FROM sizes UNION ALL SELECT y, true, n - train_n FROM sizes""")
def strat_split_sizes(spark, sf) -> DataFrame:
    df = w.labelled_orders(spark, sf).select("o_orderkey", F.col("was_canceled").cast("int").alias("y"))
    split = stratify.stratified_split(df, "y", ["o_orderkey"])
    return split.groupBy("y", "is_test").agg(F.count("*").alias("n"))


@query(f"""WITH {SIZES}, f AS (SELECT unnest([0, 1, 2]) AS fold) SELECT y, fold::BIGINT AS fold, (floor(n * (fold + 1) / 3.0::DOUBLE) - floor(n * fold / 3.0::DOUBLE))::BIGINT AS n FROM sizes, f""")
def fold_sizes(spark, sf) -> DataFrame:
    df = w.labelled_orders(spark, sf).select("o_orderkey", F.col("was_canceled").cast("int").alias("y"))
    folds = stratify.stratified_folds(df, "y", ["o_orderkey"])
    return folds.groupBy("y", F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"))


@query(f"""WITH {LABELLED}, c AS (SELECT count(*) FILTER (was_canceled) AS few, count(*) FILTER (NOT was_canceled) AS many FROM labelled)
 SELECT 1 AS y, many AS n, (many - few) AS added, few AS distinct_rows FROM c UNION ALL SELECT 0, many, 0, many FROM c""")
def oversample_counts(spark, sf) -> DataFrame:
    df = w.labelled_orders(spark, sf).select("o_orderkey", F.col("was_canceled").cast("int").alias("y"))
    more = resample.oversample(df, "y", ["o_orderkey"])
    return more.groupBy("y").agg(
        F.count("*").alias("n"), F.count_if(F.col("copy_no") > 0).alias("added"), F.countDistinct("o_orderkey").alias("distinct_rows")
    )


@query()
def out_of_fold_rate(spark, sf) -> DataFrame:
    """Smoothed rate per order in which the order's own fold has no part."""
    df = w.labelled_orders(spark, sf).withColumn("y", F.col("was_canceled").cast("int"))
    out = rates.out_of_fold_rates(df, {"rate": "o_orderpriority"}, "y", ["o_orderkey"])
    return out.select("o_orderkey", r("rate"))


@query()
def smote_points(spark, sf) -> DataFrame:
    """Synthetic vectors that bring class 0 of the embeddings to the size of the others."""
    df = w.table(spark, sf, "embeddings").withColumn("y", (F.col("label") == 0).cast("int"))
    made = resample.smote(df, "y", "vec_id", "embedding")
    total = F.aggregate("features", F.lit(0.0), lambda a, v: a + v)
    return made.select("vec_id", "copy_no", r("gap"), r(total).alias("total"))


NEAR = """few AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE label = 0), p AS (SELECT a.vec_id, b.vec_id AS other,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.e, b.e), b.vec_id) AS place FROM few a JOIN few b ON a.vec_id <> b.vec_id)"""


@query(f"""WITH {NEAR} SELECT vec_id, place::INT AS place, other FROM p WHERE place <= 5""")
def nearest_ids(spark, sf) -> DataFrame:
    """The five nearest vectors of each vector of class 0."""
    few = w.table(spark, sf, "embeddings").filter("label = 0")
    near = resample.nearest(few.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features")), 5)
    listed = near.select(F.col("id").alias("vec_id"), F.posexplode("neighbours").alias("at", "near"))
    return listed.select("vec_id", (F.col("at") + 1).alias("place"), F.col("near.id").alias("other"))


@query(f"""WITH {LABELLED}, t AS (SELECT o_orderkey, o_orderpriority AS g, was_canceled::INT AS y, o_orderkey % 3 AS fold FROM labelled),
 a AS (SELECT g, sum(y) AS p, count(*) AS n FROM t GROUP BY g), f AS (SELECT g, fold, sum(y) AS p, count(*) AS n FROM t GROUP BY g, fold)
 SELECT o_orderkey, round((a.p - f.p + 1)::DOUBLE / (a.n - f.n + 2), 6) AS rate FROM t JOIN a USING (g) JOIN f USING (g, fold)""")
def out_of_fold_rate_by_key(spark, sf) -> DataFrame:
    """The same with folds given by the key."""
    df = w.labelled_orders(spark, sf).withColumn("y", F.col("was_canceled").cast("int"))
    out = rates.out_of_fold_rates(df, {"rate": "o_orderpriority"}, "y", ["o_orderkey"], fold=F.col("o_orderkey") % 3)
    return out.select("o_orderkey", r("rate"))
