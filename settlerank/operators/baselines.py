"""Baseline rankings of the whole pool without pairing every node with every business."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from settlerank.operators.ranking import top_k
from settlerank.session import cut_lineage


def ranked_pool(scored: DataFrame, score: str = "score") -> DataFrame:
    """The pool (one row per business) with its place by score, equal scores by id.

    The rows are cut into ranges of that order; a place is the place in the range plus the rows of the ranges before, which
    are running sums over one row a range.
    """
    order = [F.desc("score"), F.asc("business")]
    ranged = cut_lineage(scored.select("business", F.col(score).alias("score")).repartitionByRange(*order)
                         .withColumn("_range", F.spark_partition_id()), "ranked-pool")
    before = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", (F.coalesce(F.sum("_n").over(
        W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    placed = ranged.withColumn("_place", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    return placed.join(F.broadcast(before), "_range").select(         # one row a range
        "business", "score", (F.col("_place") + F.col("_before")).cast("int").alias("place"))


def same_for_all(nodes: DataFrame, pool: DataFrame, k: int = 3) -> DataFrame:
    """A score that does not depend on the node: attach the k best to every node by place."""
    best = pool.orderBy(F.desc("score"), F.asc("business")).limit(k)
    best = best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.asc("business"))))
    places = nodes.select("node_id").withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    return places.join(F.broadcast(best.select("rank", "business", "score")), "rank").select(
        "node_id", "rank", "business", "score")


def pool_with_overrides(keys: DataFrame, key: str, overrides: DataFrame, pool: DataFrame, k: int = 3) -> DataFrame:
    """Top k of the whole pool per key, where some (key, business) scores replace the common prior.

    Only the best k businesses without an override can enter the result, and with m overrides these lie in
    the first m + k places of the prior ranking. So a key contributes its overrides and m + k places,
    not the whole pool; the outcome equals ranking every pair.
    """
    ranked = ranked_pool(pool)
    known = overrides.join(ranked.select("business", "place"), "business").select(key, "business", "score", "place")
    counts = known.groupBy(key).agg(F.count("*").alias("m"))
    places = (keys.select(key).distinct().join(counts, key, "left")
              .withColumn("place", F.explode(F.sequence(F.lit(1), F.coalesce("m", F.lit(0)).cast("int") + F.lit(k))))
              .join(known.select(key, "place"), [key, "place"], "left_anti"))
    rest = top_k(places, key, [F.asc("place")], k, "rn").join(ranked, "place").select(key, "business", "score")
    return top_k(known.select(key, "business", "score").unionByName(rest), key,
                 [F.desc("score"), F.asc("business")], k)


def segment_overrides(segments: DataFrame, min_rows: int = 3, stat: str = "sum") -> DataFrame:
    """Segment scores with enough rows. ``sum`` is the default meaning of a segment value."""
    return segments.where(F.col("seg_rows") >= min_rows).select(
        "seg", "business", F.col("seg_cost_sum" if stat == "sum" else "seg_cost_mean").alias("score"))


def neighbour_overrides(neighbours: DataFrame, train: DataFrame) -> DataFrame:
    """Similarity-weighted mean cost per business over a node's neighbours; zero weight gives no override."""
    rows = neighbours.select("node_id", "neighbour_id", F.greatest("similarity", F.lit(0.0)).alias("w")).join(
        train.select(F.col("node_id").alias("neighbour_id"), "business", "cum_cost_7d"), "neighbour_id")
    return (rows.groupBy("node_id", "business").agg(
        F.try_divide(F.sum(F.col("w") * F.col("cum_cost_7d")), F.sum("w")).alias("score"))
        .where(F.col("score").isNotNull()))


def spread_pool(nodes: DataFrame, pool: DataFrame, chunk: int = 1000) -> DataFrame:
    """Every node with every pool business, for scorers that need a prediction per pair.

    The pool is packed by hash into arrays of about ``chunk`` ids and a node meets each array once. Arrays are copied under as
    many salts as the session has shuffle partitions and a node has the salt of its own hash, so the equi-join on
    pack and salt has no key that all nodes share.
    """
    spark = nodes.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_packs = max(1, -(-pool.count() // chunk))
    packs = pool.select("business", F.pmod(F.xxhash64("business"), F.lit(n_packs)).alias("pack")).groupBy("pack").agg(
        F.collect_list("business").alias("ids")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = nodes.withColumn("salt", F.pmod(F.xxhash64("node_id"), F.lit(salts)).cast("int")).withColumn(
        "pack", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_packs - 1).cast("long"))))
    return spread.join(packs, ["pack", "salt"]).select(*nodes.columns, F.explode("ids").alias("business"))
