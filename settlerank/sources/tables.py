"""The analytics roles (daily settlement, ledger, attributes) derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlerank.operators.ledger import ledger_rollup

CATS = ["segment", "nation", "region"]
NUMS = ["acctbal", "n_orders", "avg_price"]
SEGMENT = ["segment", "nation", "region"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node, business and day from the event stream table (cost, revenue, peak, rows)."""
    events = table(spark, sf_dir, "events").where(F.col("user_id").isNotNull() & F.col("event_type").isNotNull())
    cost = F.get_json_object("props", "$.k").try_cast("double")
    return (events.groupBy(F.col("user_id").cast("string").alias("node_id"), F.col("event_type").alias("business"),
                           F.to_date("ts").alias("day"))
            .agg(F.sum(F.coalesce(cost, F.lit(0.0))).alias("cost"),
                 F.sum(F.coalesce("value", F.lit(0.0))).alias("revenue"),
                 F.max("value").alias("peak"), F.count("*").alias("n_rows"))
            .withColumn("profit", F.col("revenue") - F.col("cost")))


def sold_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost, revenue and quantity per node, business and day from the sales tables; keys may be null.

    Amounts are computed as soon as their columns meet, so that a shuffle carries them instead of what they are made of.
    """
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("node_id"),
                                                   F.to_date("o_orderdate").alias("day"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("business"), "p_retailprice")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        "l_orderkey", "business", "l_quantity", "revenue",
        (F.lit(0.8) * F.col("l_quantity") * F.col("p_retailprice")).alias("cost"))
    return rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("node_id", "business", "day").agg(
        F.sum("cost").alias("cost"), F.sum("revenue").alias("revenue"), F.sum("l_quantity").alias("quantity"))


def ledger_totals(spark: SparkSession, sf_dir: str, days: DataFrame | None = None) -> DataFrame:
    """One row per node and business from the sales tables, in the ledger layout. ``days`` are stored ``sold_days``.

    Rows per day are dealt out by node once; pairs, names and the roll-up of a node then need no further shuffle.
    """
    days = sold_days(spark, sf_dir) if days is None else days
    known = days.where(F.col("node_id").isNotNull() & F.col("business").isNotNull()).drop("quantity")
    pairs = known.repartition("node_id").groupBy("node_id", "business").agg(
        F.min("day").alias("business_online_day"), F.count("*").cast("int").alias("outcome_days"),
        F.sum("cost").alias("cum_cost_7d"), F.sum("revenue").alias("cum_revenue_7d"))
    parts = table(spark, sf_dir, "part").where(F.col("p_brand").isNotNull())
    names = parts.groupBy("p_brand").agg(F.min("p_type").alias("label")).select(
        F.col("p_brand").alias("business"), F.concat_ws(" ", "p_brand", "label").alias("business_name"))
    named = ledger_rollup(pairs).join(names, "business", "left")
    return named.withColumn("cum_profit_7d", F.col("cum_revenue_7d") - F.col("cum_cost_7d"))


def node_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes that have attributes."""
    return table(spark, sf_dir, "customer").where(F.col("c_custkey").isNotNull()).select(
        F.col("c_custkey").cast("string").alias("node_id"))


def node_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node: three categorical and three numeric attributes."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = table(spark, sf_dir, "region")
    spend = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").cast("double").alias("n_orders"), F.avg("o_totalprice").alias("avg_price"))
    return (customer.where(F.col("c_custkey").isNotNull())
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .join(spend, F.col("c_custkey") == F.col("o_custkey"), "left")
            .select(F.col("c_custkey").cast("string").alias("node_id"), F.col("c_mktsegment").alias("segment"),
                    F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
                    F.col("c_acctbal").alias("acctbal"), "n_orders", "avg_price"))


def build_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build-bandwidth records per node and business: one per sold line, the quantity as its size."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
            .join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(F.col("o_custkey").cast("string").alias("node_id"), F.col("p_brand").alias("business"),
                    F.col("l_quantity").cast(T.DoubleType()).alias("build_bandwidth")))
