"""The supplied tables in the roles of plans, event log, city table and scored rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions.clean import key_text
from riskframe.operators.joins import flag_members
from riskframe.session import parallelism
from riskframe.sources.tables import holiday_table

#: Dates taken as holidays, each year of the orders.
HOLIDAY_DAYS = [(1, 1), (3, 21), (4, 10), (5, 1), (9, 25), (9, 26), (12, 25)]
HOLIDAY_YEARS = range(1996, 2001)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def holiday_dates() -> list[date]:
    return [date(y, m, d) for y in HOLIDAY_YEARS for m, d in HOLIDAY_DAYS]


def holidays(spark: SparkSession) -> DataFrame:
    return holiday_table(spark, holiday_dates())


def cancel_log(spark: SparkSession, sf: str) -> DataFrame:
    """Returned lines of at least 42 pieces are the cancellation events of an order."""
    return table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 42").select(
        F.col("l_orderkey").alias("plan_id"), F.col("l_shipdate").alias("cancel_date"),
        F.col("l_quantity").alias("quantity"),
    )


def labelled_orders(spark: SparkSession, sf: str) -> DataFrame:
    return flag_members(table(spark, sf, "orders"), "o_orderkey", cancel_log(spark, sf), "plan_id")


def scored_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Rows (key, label, score, grp): the label of each order and a score in [0, 1) with ties,
    made of the total price and the largest line."""
    largest = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max("l_quantity").alias("largest")
    )
    noise = F.floor(F.pmod(F.col("o_totalprice"), F.lit(1000.0)) * 10) / 10000.0
    orders = labelled_orders(spark, sf).join(largest, "o_orderkey", "left")
    return orders.select(
        F.col("o_orderkey").alias("key"), F.col("was_canceled").cast("int").alias("label"),
        (noise * 0.5 + F.coalesce("largest", F.lit(0.0)) / 101.0).alias("score"),
        F.col("o_orderpriority").alias("grp"),
    )


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Per order what its lines say; orders without lines are absent."""
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_shipdate").alias("first_ship"), F.min("l_partkey").alias("part"),
        F.min("l_suppkey").alias("supp"), F.count("*").alias("lines"),
        F.sum("l_quantity").alias("quantity"), F.max("l_discount").alias("discount"),
        F.max("l_tax").alias("tax"),
    )


def orders_with_lines(spark: SparkSession, sf: str, orders: DataFrame | None = None) -> DataFrame:
    """All orders with their line facts; null where an order has no lines."""
    lines = order_lines(spark, sf).withColumnRenamed("l_orderkey", "o_orderkey")
    return (table(spark, sf, "orders") if orders is None else orders).join(lines, "o_orderkey", "left")


def spread(df: DataFrame) -> DataFrame:
    """A scan that comes as a single partition (one file with one row group) over all shuffle
    tasks, so that costly row work after it runs in parallel. Other scans are left alone."""
    return df if df.rdd.getNumPartitions() > 1 else df.repartition(parallelism(df.sparkSession))


def plans(spark: SparkSession, sf: str, label: str | None = None) -> DataFrame:
    """Orders, their lines, parts and customers in the shape of the plan table. ``label`` adds a boolean of that
    name, whether the cancellation log holds the order: found while the rows are narrow, as the key is the order's."""
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("part"), "p_name", "p_brand", "p_type", "p_size", "p_retailprice"
    )
    customer = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    orders = spread(table(spark, sf, "orders"))
    if label:
        orders = flag_members(orders, "o_orderkey", cancel_log(spark, sf), "plan_id", label)
    joined = orders_with_lines(spark, sf, orders).join(part, "part", "left").join(customer, "o_custkey", "left")
    lab = lambda value, low: F.when(value >= low, value.cast("double"))
    return joined.select(
        key_text("o_orderkey").alias("plan_id"), key_text("o_custkey").alias("patient_id"),
        F.col("o_orderdate").alias("request_date"), F.col("first_ship").alias("surgery_date"),
        F.col("p_size").cast("string").alias("room"), F.col("c_mktsegment").alias("anesthesia"),
        F.col("p_name").alias("procedure_code"), F.col("p_type").alias("surgery_site"),
        F.col("p_brand").alias("department"), (F.col("c_acctbal") / 100).alias("age"),
        F.when(F.col("supp") % 7 > 0, F.col("p_size").cast("string")).alias("bmi"),
        lab(F.col("lines"), 2).alias("albumin"), lab(F.col("quantity"), 50).alias("pt_inr"),
        lab(F.col("discount"), 0.05).alias("potassium"), lab(F.col("tax"), 0.04).alias("sodium"),
        lab(F.col("p_size"), 10).alias("hb"), lab(F.col("p_retailprice"), 1000).alias("wbc"),
        lab(F.col("c_acctbal"), 0).alias("plt"),
        F.replace(F.col("p_name"), F.lit(" "), F.lit(",")).alias("medications"),
        F.replace(F.col("p_brand"), F.lit("#"), F.lit(",")).alias("diagnoses"),
        F.col("c_nationkey").cast("string").alias("city"),
        F.col("o_orderstatus").alias("gender"), F.col("o_orderpriority").alias("payer"),
        F.col("p_type").alias("marital_status"), F.col("supp").cast("string").alias("distance_km"),
        *([label] if label else []),
    )


def city_dim(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with a cluster number; some nations are left out, so some cities are unknown."""
    return table(spark, sf, "nation").filter("n_regionkey <> 2").select(
        F.col("n_nationkey").cast("string").alias("city"), F.col("n_regionkey").cast("string").alias("cluster")
    )
