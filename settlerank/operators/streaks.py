"""Current activity: trailing streak of days, the business run in it, and the strict seven-day form.

The daily table has one row per node, business and day, so a node's window holds at most seven days
(or the recent days) times its businesses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from settlerank.functions import streak_label


def trailing_rows(daily: DataFrame, cap: int = 7) -> DataFrame:
    """Rows of each node's trailing run of consecutive days, with the run length.

    The days back from the last one set bits of a small mask; its lowest zero bit ends the run. All
    windows share one partitioning by node.
    """
    node = W.partitionBy("node_id")
    dated = daily.where(F.col("day").isNotNull()).withColumn("last_day", F.max("day").over(node))
    recent = dated.withColumn("back", F.datediff("last_day", "day")).where(F.col("back") < cap)
    masked = recent.withColumn("mask", F.bit_or(F.expr("shiftleft(1, back)")).over(node))
    return (masked.withColumn("streak", F.bit_count(F.expr("((mask + 1) & ~mask) - 1")))
            .where(F.col("back") < F.col("streak")).drop("mask"))


def trailing_streak(daily: DataFrame, cap: int = 7) -> DataFrame:
    return trailing_rows(daily, cap).groupBy("node_id").agg(
        F.max("last_day").alias("last_day"), F.max("streak").cast("int").alias("streak"))


def current_business(daily: DataFrame, cap: int = 7, by: str = "row", names: DataFrame | None = None) -> DataFrame:
    """The business a node runs now: that of its largest revenue row (``by='row'``) or sum in the streak.

    A window without positive revenue gives no row. Profit falls back to revenue minus cost when the
    booked profit is zero.
    """
    node = W.partitionBy("node_id")
    rows = trailing_rows(daily, cap).withColumn("rev", F.coalesce("revenue", F.lit(0.0)))
    rows = rows.withColumn("node_rev", F.sum("rev").over(node)).where(F.col("node_rev") > 0)
    if by == "sum":
        rows = rows.withColumn("weight", F.sum("rev").over(W.partitionBy("node_id", "business")))
    else:
        rows = rows.withColumn("weight", F.col("rev"))
    best = F.first("business").over(node.orderBy(F.desc("weight"), F.asc("day"), F.asc("business")))
    run = rows.withColumn("cur_business", best).where(F.col("business") == F.col("cur_business"))
    out = run.groupBy("node_id", "cur_business", "streak").agg(
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cur_cost"), F.sum("rev").alias("cur_revenue"),
        F.coalesce(F.sum("profit"), F.lit(0.0)).alias("booked"))
    out = out.select("node_id", "cur_business", F.col("streak").cast("int").alias("days"), "cur_cost",
                     F.when(F.abs("booked") > 1e-9, F.col("booked"))
                     .otherwise(F.col("cur_revenue") - F.col("cur_cost")).alias("cur_profit"),
                     streak_label("streak").alias("streak_label"))
    if names is None:
        return out
    return out.join(names.select(F.col("business").alias("cur_business"), F.col("business_name").alias("cur_name")),
                    "cur_business", "left")


def current_seven_days(daily: DataFrame, as_of=None, lookback: int = 30, length: int = 7,
                       unnamed: str = "0") -> DataFrame:
    """The strict form: the last run of ``length`` consecutive valid days inside the lookback.

    A day is valid when the node had cost or revenue. The seven days must hold revenue. The business is
    the named one with the highest cost in them; an unnamed id only folds its amounts into that one when it
    had revenue without cost. Nodes that fail keep one row of nulls with ``has_cur = 0``.
    """
    end = F.lit(as_of).cast("date") if as_of is not None else daily.agg(F.max("day")).scalar()
    node = W.partitionBy("node_id")
    recent = daily.where((F.col("day") > F.date_sub(end, lookback)) & (F.col("day") <= end))
    active = recent.where((F.coalesce("cost", F.lit(0.0)) != 0) | (F.coalesce("revenue", F.lit(0.0)) != 0))
    island = F.date_sub("day", F.dense_rank().over(node.orderBy("day")))
    runs = active.withColumn("island", island)
    per_run = W.partitionBy("node_id", "island")
    runs = (runs.withColumn("run_start", F.min("day").over(per_run)).withColumn("run_end", F.max("day").over(per_run))
            .where(F.datediff("run_end", "run_start") >= length - 1)
            .withColumn("cur_end", F.max("run_end").over(node)).where(F.col("run_end") == F.col("cur_end"))
            .where(F.col("day") > F.date_sub("cur_end", length)))
    sums = runs.groupBy("node_id", "business", "cur_end").agg(
        F.sum("cost").alias("cost"), F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"))
    named = F.col("business") != unnamed
    sums = (sums.withColumn("all_revenue", F.sum("revenue").over(node)).where(F.col("all_revenue") > 0)
            .withColumn("cur_business", F.first("business").over(
                node.orderBy(F.desc(named.cast("int")), F.desc("cost"), F.asc("business")))))
    folds = (~named) & (F.col("revenue") > 0)
    kept = sums.where((F.col("business") == F.col("cur_business")) | folds)
    found = kept.groupBy("node_id", "cur_business", "cur_end").agg(
        F.sum("cost").alias("cur_cost7"), F.sum("profit").alias("booked"), F.sum("revenue").alias("rev"))
    found = found.where(F.col("cur_business") != unnamed).select(
        "node_id", "cur_business", F.date_sub("cur_end", length - 1).alias("cur_start"), "cur_end", "cur_cost7",
        F.when(F.abs("booked") > 1e-9, F.col("booked")).otherwise(F.col("rev") - F.col("cur_cost7"))
        .alias("cur_profit7"), F.lit(1).alias("has"))
    nodes = daily.select("node_id").distinct()
    return nodes.join(found, "node_id", "left").withColumn("has_cur", F.coalesce("has", F.lit(0))).drop("has")
