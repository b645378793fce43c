"""Candidate businesses per node and features taken from similar nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlerank.functions import share_flag


def neighbour_ledger(neighbours: DataFrame, train: DataFrame, *cols: str) -> DataFrame:
    """Ledger rows of every node's neighbours."""
    rows = train.select(F.col("node_id").alias("neighbour_id"), "business", *cols)
    return neighbours.join(rows, "neighbour_id")


def run_history(ledger: DataFrame) -> DataFrame:
    return ledger.select("node_id", "business").distinct()


def candidate_pairs(neighbours: DataFrame, train: DataFrame, history: DataFrame, pool: DataFrame,
                    gated: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """Businesses of the neighbours, united with the node's own, inside the pool and outside the gate.

    With ``members`` (node_id, profile_id) the neighbours are those of profiles: their businesses are made
    distinct per profile first and then handed to the profile's nodes. Businesses travel as one list a node, not as rows.
    """
    def lists(rows: DataFrame) -> DataFrame:
        """The businesses that pass, as one list a node (at most one entry per pool business)."""
        rows = rows.join(pool.select("business"), "business", "left_semi")
        if gated is not None:
            rows = rows.join(gated, "business", "left_anti")
        return rows.groupBy("node_id").agg(F.collect_set("business").alias("found"))

    seen = lists(neighbour_ledger(neighbours, train).select("node_id", "business"))
    if members is not None:
        seen = members.join(seen.withColumnRenamed("node_id", "profile_id"), "profile_id").select("node_id", "found")
    both = seen.unionByName(lists(history.select("node_id", "business"))).groupBy("node_id").agg(F.collect_list("found").alias("found"))
    return both.select("node_id", F.explode(F.array_distinct(F.flatten("found"))).alias("business"))


def fallback_businesses(pool: DataFrame, gated: DataFrame | None = None, n: int = 3) -> DataFrame:
    """The first n pool ids that pass the gate, for nodes without any candidate."""
    open_pool = pool.select("business") if gated is None else pool.select("business").join(
        gated, "business", "left_anti")
    return open_pool.orderBy("business").limit(n)


def with_fallback(nodes: DataFrame, pairs: DataFrame, fallback: DataFrame, skip: bool = False) -> DataFrame:
    """(node_id, business, is_fallback). ``skip`` leaves nodes without candidates out instead."""
    own = pairs.withColumn("is_fallback", F.lit(0))
    if skip:
        return own
    ids = fallback.agg(F.array_sort(F.collect_list("business"))).scalar()      # n ids
    empty = nodes.select("node_id").join(pairs.select("node_id"), "node_id", "left_anti")
    filled = empty.select("node_id", F.explode(ids).alias("business"), F.lit(1).alias("is_fallback"))
    return own.unionByName(filled)


def candidate_profile(candidates: DataFrame, neighbours: DataFrame, train: DataFrame, split: DataFrame,
                      members: DataFrame | None = None) -> DataFrame:
    """Per node: number of candidates, fallback flag, distinct businesses among the neighbours."""
    counts = candidates.groupBy("node_id").agg(F.count("*").alias("n_cand"), F.max("is_fallback").alias("fallback"))
    seen = neighbour_ledger(neighbours, train).select("node_id", "business").distinct().groupBy("node_id").agg(
        F.count("*").alias("n_neigh_biz"))
    if members is not None:
        seen = members.join(seen.withColumnRenamed("node_id", "profile_id"), "profile_id").drop("profile_id")
    return (counts.join(seen, "node_id", "left").join(split.select("node_id", "is_test"), "node_id", "left")
            .select("node_id", share_flag(F.col("is_test")).alias("is_test"), "n_cand", "fallback",
                    F.coalesce("n_neigh_biz", F.lit(0)).alias("n_neigh_biz")))


def profile_summary(profile: DataFrame) -> DataFrame:
    """Test nodes: median candidate count, fallback rate, mean distinct neighbour businesses.

    The median is over small counts, of which there are at most as many as pool businesses.
    """
    return profile.where(F.col("is_test") == 1).agg(
        F.count("*").alias("n"), F.round(F.median("n_cand"), 1).alias("median_candidates"),
        F.round(F.avg("fallback"), 4).alias("fallback_rate"), F.round(F.avg("n_neigh_biz"), 2).alias("mean_neigh_biz"))


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """The candidates of a node as one sorted, pipe-joined list (at most one entry per pool business)."""
    return candidates.groupBy("node_id").agg(
        F.array_join(F.array_sort(F.collect_set("business")), "|").alias("cand"), F.count("*").alias("n_cand"))


def neighbour_features(neighbours: DataFrame, train: DataFrame, power: float = 4.0, count: str | None = None) -> DataFrame:
    """Per (business, node): similarity-weighted mean cost of its same-business neighbours, and their number if ``count`` names a column.

    ``neighbours`` come from a grouped search that leaves the node itself out. Where they carry their cost, no row travels before
    those of a node are added up.
    """
    rows = neighbours
    if "cum_cost_7d" not in neighbours.columns:
        costs = train.select(F.col("node_id").alias("neighbour_id"), "business", "cum_cost_7d")
        rows = neighbours.join(costs, ["business", "neighbour_id"])
    rows = rows.withColumn(
        "w", F.pow(F.greatest("similarity", F.lit(0.0)), F.lit(power)))
    weight = F.sum("w")
    return rows.groupBy("business", "node_id").agg(
        F.when(weight > 1e-12, F.sum(F.col("w") * F.col("cum_cost_7d")) / weight)
        .otherwise(F.avg("cum_cost_7d")).alias("neighbour_cost"), *[F.count("*").alias(c) for c in [count] if c])


def peer_counts(pairs: DataFrame, train: DataFrame) -> DataFrame:
    """log1p of the number of other training nodes that run the business."""
    peers = train.select("business", "node_id").distinct()
    totals = peers.groupBy("business").agg(F.count("*").alias("peers"))
    own = peers.withColumn("own", F.lit(1))
    return (pairs.join(totals, "business", "left").join(own, ["business", "node_id"], "left")
            .select("business", "node_id", F.log1p(
                F.coalesce("peers", F.lit(0)) - F.coalesce("own", F.lit(0))).alias("neighbour_support_log")))
