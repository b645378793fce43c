"""Per-node ranking, truth, normalisation and long-to-wide output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from settlerank.functions import positive_flag, rounded_money


def top_k(df: DataFrame, by: str | Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every group; the optimizer cuts each map task to k rows before the shuffle."""
    by = [by] if isinstance(by, str) else list(by)
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def true_best(ledger: DataFrame, value: str = "cum_cost_7d") -> DataFrame:
    """The business with the highest value per node; equal values go to the smaller id."""
    best = top_k(ledger.where(F.col(value).isNotNull()), "node_id", [F.desc(value), F.asc("business")], 1)
    return best.select("node_id", F.col("business").alias("true_best"), F.col(value).alias("true_value"))


def restrict_to_pool(df: DataFrame, pool: DataFrame, column: str = "business") -> DataFrame:
    return df.join(pool.select(F.col("business").alias(column)), column, "left_semi")


def norm_within(value: str, by: str = "node_id", flat: float = 0.5) -> Column:
    """Min-max normalisation inside the group; a constant group gives ``flat``."""
    w = W.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high - low > 1e-9, (F.col(value) - low) / (high - low)).otherwise(F.lit(flat))


def norm_by_max(value: str, by: str = "node_id") -> Column:
    """Value over the group maximum, zero where unknown or when the maximum is not positive."""
    high = F.max(value).over(W.partitionBy(by))
    return F.coalesce(F.col(value) / F.when(high > 0, high).otherwise(F.lit(1.0)), F.lit(0.0))


def recommendation_rows(ranked: DataFrame) -> DataFrame:
    """Long recommendation rows with rounded money, where predicted also of revenue, and the profit flag."""
    money = [c for c in ("pred_cost", "pred_revenue", "pred_profit") if c in ranked.columns]
    return ranked.select("node_id", "rank", "business", *[rounded_money(c).alias(c) for c in money],
                         positive_flag("pred_profit").alias("profit_positive"))


def widen(recs: DataFrame, k: int = 3) -> DataFrame:
    """One row per node with top1..topk columns; ranks a node lacks stay null."""
    fields = [c for c in ("business", "pred_cost", "pred_revenue", "pred_profit", "profit_positive") if c in recs.columns]
    aggs = [F.max(F.when(F.col("rank") == i, F.col(f))).alias(f"top{i}_{f}") for i in range(1, k + 1) for f in fields]
    return recs.groupBy("node_id").agg(*aggs)


def top_businesses(recs: DataFrame, n: int = 12, column: str = "business") -> DataFrame:
    """The n most frequent values, equal counts by id."""
    return recs.groupBy(column).agg(F.count("*").alias("n_nodes")).orderBy(F.desc("n_nodes"), F.asc(column)).limit(n)
