"""Declared schemas of the input tables. Keys are text so that leading zeros survive."""

from __future__ import annotations

from pyspark.sql import types as T

from settlerank.fixed_values import CAT_COLS, NUM_COLS


# --- fixed values: column names and types of the input tables ------------------
ATTRS = T.StructType([T.StructField("node_id", T.StringType())]
                     + [T.StructField(name, T.StringType()) for name in CAT_COLS]
                     + [T.StructField(name, T.DoubleType()) for name in NUM_COLS])
LEDGER = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("business", T.StringType()),
    T.StructField("business_name", T.StringType()),
    T.StructField("business_online_day", T.DateType()),
    T.StructField("online_day", T.DateType()),
    T.StructField("business_count", T.IntegerType()),
    T.StructField("outcome_days", T.IntegerType()),
    T.StructField("cum_cost_7d", T.DoubleType()),
    T.StructField("cum_revenue_7d", T.DoubleType()),
])
CAPACITY = T.StructType([
    T.StructField("business", T.StringType()),
    T.StructField("business_name", T.StringType()),
    T.StructField("days", T.IntegerType()),
    T.StructField("sample_nodes", T.IntegerType()),
    T.StructField("traffic_p75_mbps", T.DoubleType()),
    T.StructField("capacity_upper_mbps", T.DoubleType()),
    T.StructField("util_at_capacity", T.DoubleType()),
    T.StructField("current_daily_peak95_sum_mbps", T.DoubleType()),
    T.StructField("can_add_mbps", T.DoubleType()),
    T.StructField("over_capacity_mbps", T.DoubleType()),
])
BW_DAILY = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("business", T.StringType()),
    T.StructField("business_name", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("day", T.DateType()),
    T.StructField("peak95", T.DoubleType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
])
CURRENT = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("cur_name", T.StringType()),
    T.StructField("cur_start", T.DateType()),
    T.StructField("cur_end", T.DateType()),
    T.StructField("has_cur", T.IntegerType()),
    T.StructField("cur_cost7", T.DoubleType()),
    T.StructField("cur_profit7", T.DoubleType()),
])
DAILY = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("business", T.StringType()),
    T.StructField("day", T.DateType()),
    T.StructField("cost", T.DoubleType()),
    T.StructField("revenue", T.DoubleType()),
    T.StructField("profit", T.DoubleType()),
])
BUILD_BANDWIDTH = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("business", T.StringType()),
    T.StructField("build_bandwidth", T.DoubleType()),
])
RECS = T.StructType([
    T.StructField("node_id", T.StringType()),
    T.StructField("business", T.StringType()),
    T.StructField("rank", T.IntegerType()),
    T.StructField("profit_positive", T.IntegerType()),
    T.StructField("pred_cost", T.DoubleType()),
    T.StructField("pred_profit", T.DoubleType()),
])
MANIFEST = T.StructType([T.StructField("inputs", T.ArrayType(T.StructType([
    T.StructField("role", T.StringType()), T.StructField("local_file", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("row_expected_min", T.LongType()),
    T.StructField("required_cols", T.ArrayType(T.StringType())),
])))])
