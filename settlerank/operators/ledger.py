"""Ledger building: first-seven-day windows, roll-ups, cleaning, family merge, scale summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from settlerank.fixed_values import FAMILY_RULES
from settlerank.functions import family_token, has_prefix, no_nan, profit_of, share_flag


def first_window_ledger(daily: DataFrame, days: int = 7) -> DataFrame:
    """Totals over the first ``days`` calendar days of every (node, business), missing amounts as 0.

    The daily table already has one row per node, business and day, so the window that finds the first
    day holds at most one row per calendar day and the aggregate reuses its partitioning: one shuffle
    and no self-join. Rows without a node or business belong to no pair and are left out.
    """
    daily = daily.where(F.col("node_id").isNotNull() & F.col("business").isNotNull())
    pair = W.partitionBy("node_id", "business")
    first = daily.withColumn("business_online_day", F.min("day").over(pair))
    inside = first.where(F.col("day") <= F.date_add("business_online_day", days - 1))
    return inside.groupBy("node_id", "business", "business_online_day").agg(
        F.count_distinct("day").cast("int").alias("outcome_days"),
        F.sum(F.coalesce("cost", F.lit(0.0))).alias("cum_cost_7d"),
        F.sum(F.coalesce("revenue", F.lit(0.0))).alias("cum_revenue_7d"))


def ledger_rollup(pairs: DataFrame) -> DataFrame:
    """Add the node's first day and its number of businesses to a ledger that is unique per pair."""
    node = W.partitionBy("node_id")
    return (pairs.withColumn("online_day", F.min("business_online_day").over(node))
            .withColumn("business_count", F.count("*").over(node).cast("int")))


def complete_windows(ledger: DataFrame, min_days: int = 7) -> DataFrame:
    """Keep complete windows; a missing or NaN day count fails."""
    days = F.col("outcome_days")
    if dict(ledger.dtypes)["outcome_days"] in ("double", "float"):
        days = no_nan(days)
    return ledger.where(days >= min_days)


def with_profit(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("cum_profit_7d", profit_of("cum_revenue_7d", "cum_cost_7d"))


def scale_summary(ledger: DataFrame, min_days: int = 7) -> DataFrame:
    """Pairs, nodes and businesses with a complete window.

    Distinct nodes and businesses come from two group-bys, so that no single task holds all keys.
    """
    full = complete_windows(ledger, min_days)
    nodes = full.groupBy("node_id").agg(F.count("*").alias("pairs"))
    businesses = full.groupBy("business").agg(F.lit(1).alias("one"))
    left = nodes.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("full_pairs"), F.count("*").alias("full_nodes"))
    right = businesses.agg(F.count("*").alias("businesses"))
    return left.withColumn("k", F.lit(1)).join(right.withColumn("k", F.lit(1)), "k").drop("k")


def unique_nodes(attrs: DataFrame, order: Sequence[str], key: str = "node_id") -> DataFrame:
    """One row per key: the first in the given order; without one, the copy with the most filled columns.

    The minimum of a struct keeps one row per key and map task, so a key with very many copies never
    meets in one place.
    """
    rest = [c for c in attrs.columns if c != key]
    empty = sum([F.col(c).isNull().cast("int") for c in rest], F.lit(0)).alias("_empty")
    ranked = F.struct(*([] if order else [empty]), *[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    picked = attrs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ranked).alias("row"))
    return picked.select(key, *[F.col("row")[c].alias(c) for c in rest])


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty when a many-to-one join is safe."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def join_attributes(ledger: DataFrame, attrs: DataFrame, check: bool = False) -> DataFrame:
    """Inner join on the node; with ``check`` a duplicate attribute key raises."""
    if check and not duplicate_keys(attrs, ["node_id"]).isEmpty():
        raise ValueError("attributes hold a node more than once")
    return ledger.where(F.col("node_id").isNotNull()).join(attrs, "node_id", "inner")


def name_map(ledger: DataFrame) -> DataFrame:
    """One name per business: the smallest that is not null."""
    return ledger.where(F.col("business_name").isNotNull()).groupBy("business").agg(
        F.min("business_name").alias("business_name"))


def pick_pool_side(df: DataFrame, side: str, prefix: str = "ant") -> DataFrame:
    """Keep the nodes with the prefix, those without it, or all."""
    if side == prefix:
        return df.where(has_prefix("node_id", prefix))
    if side == "non" + prefix:
        return df.where(~has_prefix("node_id", prefix))
    if side:
        raise ValueError(f"unknown pool side {side!r}")
    return df


def to_families(ledger: DataFrame, names: DataFrame | None = None, rules=FAMILY_RULES) -> DataFrame:
    """Replace each business by its family token; a business without a name keeps its id."""
    names = name_map(ledger) if names is None else names
    keyed = ledger.drop("business_name") if "business_name" in ledger.columns else ledger
    joined = keyed.join(names, "business", "left")
    return joined.withColumn("business", family_token("business", "business_name", rules))


def merge_families(ledger: DataFrame, names: DataFrame | None = None, rules=FAMILY_RULES) -> DataFrame:
    """Re-aggregate the ledger to (node, family) and recompute the profit."""
    merged = to_families(ledger, names, rules).groupBy("node_id", "business").agg(
        F.coalesce(F.sum("cum_cost_7d"), F.lit(0.0)).alias("cum_cost_7d"),
        F.coalesce(F.sum("cum_revenue_7d"), F.lit(0.0)).alias("cum_revenue_7d"),
        F.max("outcome_days").alias("outcome_days"), F.min("online_day").alias("online_day"),
        F.min("business_name").alias("business_name"))
    return with_profit(merged)


def prefix_shares(ledger: DataFrame, prefix: str = "ant") -> DataFrame:
    """Share of ledger rows per business that belong to prefix nodes."""
    return ledger.where(F.col("business").isNotNull()).groupBy("business").agg(
        F.avg(share_flag(has_prefix("node_id", prefix))).alias("prefix_share"), F.count("*").alias("n_rows"))


def gated_businesses(ledger: DataFrame, threshold: float = 0.9, prefix: str = "ant") -> DataFrame:
    """Businesses that nearly only prefix nodes run."""
    return prefix_shares(ledger, prefix).where(F.col("prefix_share") >= threshold).select("business")


def drop_gated(df: DataFrame, gated: DataFrame) -> DataFrame:
    return df.join(gated, "business", "left_anti")
