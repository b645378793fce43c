"""Business statistics, support pools, priors and segment aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlerank.functions import log1p_floored
from settlerank.operators.percentiles import exact_percentiles, long_values, percentile_columns


def business_support(ledger: DataFrame) -> DataFrame:
    """Distinct nodes per business. Duplicates go first, keyed by node, so a hot business stays spread."""
    pairs = ledger.where(F.col("business").isNotNull() & F.col("node_id").isNotNull()).groupBy(
        "business", "node_id").agg(F.lit(1).alias("one"))
    return pairs.groupBy("business").agg(F.count("*").alias("support"))


def business_stats(train: DataFrame, gate_percentile: float = 0.1) -> DataFrame:
    """Mean and p90 cost, mean and low-percentile profit, distinct-node support and their logs."""
    train = train.where(F.col("business").isNotNull())
    means = train.groupBy("business").agg(F.avg("cum_cost_7d").alias("cost_mean"),
                                          F.avg("cum_profit_7d").alias("profit_mean"))
    amounts = long_values(train, ["cum_cost_7d", "cum_profit_7d"], ["business"])
    points = exact_percentiles(amounts, ["business", "field"], "value", [0.9, gate_percentile])

    def point(field: str, p: float):
        return F.max(F.when((F.col("field") == field) & (F.col("p") == F.lit(p)), F.col("value")))

    tails = points.groupBy("business").agg(point("cum_cost_7d", 0.9).alias("cost_p90"),
                                           point("cum_profit_7d", gate_percentile).alias("profit_p10"))
    stats = means.join(business_support(train), "business", "left").join(tails, "business", "left")
    return (stats.withColumn("cost_mean_log", F.log1p("cost_mean"))
            .withColumn("cost_p90_log", F.log1p("cost_p90"))
            .withColumn("profit_mean_log", log1p_floored("profit_mean"))
            .withColumn("support_log", F.log1p("support")))


def profit_floor(train: DataFrame, p: float = 0.1) -> DataFrame:
    return percentile_columns(train, ["business"], "cum_profit_7d", {"profit_p10": p})


def support_pool(stats: DataFrame, min_support: int) -> DataFrame:
    return stats.where(F.col("support") >= min_support)


def prior_of_means(stats: DataFrame) -> DataFrame:
    """The fallback prior as the mean of the business means."""
    return stats.agg(F.avg("cost_mean").alias("global_mean"))


def prior_of_rows(train: DataFrame) -> DataFrame:
    """The fallback prior as the mean over ledger rows."""
    return train.agg(F.avg("cum_cost_7d").alias("global_mean"))


def business_prior(train: DataFrame) -> DataFrame:
    return train.groupBy("business").agg(F.avg("cum_cost_7d").alias("prior"))


def segment_stats(train: DataFrame, segment: str = "seg") -> DataFrame:
    """Rows, cost sum and means per segment and business."""
    return train.groupBy(segment, "business").agg(
        F.count("*").alias("seg_rows"), F.sum("cum_cost_7d").alias("seg_cost_sum"),
        F.avg("cum_cost_7d").alias("seg_cost_mean"), F.sum("cum_profit_7d").alias("seg_profit_sum"))
