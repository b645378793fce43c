"""Score variants over (node, business) pairs that carry predicted cost and profit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from settlerank.config import Settings
from settlerank.functions import capacity_penalty, utilisation_aux
from settlerank.operators.ranking import norm_by_max, norm_within, top_k


def with_cost_norm(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("cost_norm", norm_within("pred_cost"))


def with_profit_penalty(pairs: DataFrame, weight: float = 0.8) -> DataFrame:
    return pairs.withColumn("profit_pen", F.when(F.col("pred_profit") <= 0, -weight * F.col("cost_norm"))
                            .otherwise(F.lit(0.0)))


def with_capacity(pairs: DataFrame, capacity: DataFrame, weight: float = 0.3) -> DataFrame:
    """Capacity penalty; a business without a capacity row has none."""
    small = capacity.select("business", "over_capacity_mbps", "capacity_upper_mbps")
    return (pairs.join(small, "business", "left")
            .withColumn("cap_pen", -weight * capacity_penalty("over_capacity_mbps", "capacity_upper_mbps"))
            .drop("over_capacity_mbps", "capacity_upper_mbps"))


def peak_per_pair(bw_daily: DataFrame, column: str = "peak_mbps") -> DataFrame:
    return bw_daily.groupBy("node_id", "business").agg(F.max(column).alias("peak_mbps"))


def with_aux(pairs: DataFrame, peaks: DataFrame, nominal: DataFrame) -> DataFrame:
    """Utilisation aux from the node's own peak on that business over its nominal bandwidth."""
    return (pairs.join(peaks, ["node_id", "business"], "left").join(nominal, "node_id", "left")
            .withColumn("bw_aux", utilisation_aux("peak_mbps", "nominal_bw")))


def score_full_pool(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Normalised cost with a profit penalty, and the flag of the first-rank gate.

    Eligible: positive predicted profit and positive low-percentile profit of the business. A node without
    any eligible row has no gate.
    """
    scored = with_profit_penalty(with_cost_norm(pairs), settings.w_profit)
    passes = (F.col("pred_profit") > 0) & (F.coalesce("profit_p10", F.lit(0.0)) > 0)
    eligible = F.coalesce(passes, F.lit(False)).cast("int")
    return (scored.withColumn("eligible", eligible)
            .withColumn("any_eligible", F.max("eligible").over(W.partitionBy("node_id")))
            .withColumn("soft_score", F.col("cost_norm") + F.col("profit_pen")))


def gated_top(scored: DataFrame, k: int = 3) -> DataFrame:
    """First the best eligible row, then the best of the rest without any gate."""
    order = [F.desc("soft_score"), F.desc("pred_cost"), F.asc("business")]
    first = F.row_number().over(W.partitionBy("node_id").orderBy(F.desc("eligible"), *order))
    lead = scored.withColumn("lead", (first == 1).cast("int"))
    return top_k(lead, "node_id", [F.desc("lead"), *order], k)


def score_v1(pairs: DataFrame, capacity: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Raw predicted cost with soft profit and capacity penalties."""
    scored = with_capacity(with_profit_penalty(with_cost_norm(pairs), settings.w_profit), capacity,
                           settings.w_capacity)
    return scored.withColumn("score", F.col("pred_cost") + F.col("profit_pen") + F.col("cap_pen"))


def score_aux(pairs: DataFrame, capacity: DataFrame, peaks: DataFrame, nominal: DataFrame,
              settings: Settings = Settings()) -> DataFrame:
    """The first score as ``score_off``, and ``score_on`` with the bandwidth aux added.

    The join by pair comes first and the one by node second, whose shuffle the windows of a node then share.
    """
    scored = score_v1(with_aux(pairs, peaks, nominal), capacity, settings)
    return scored.withColumnRenamed("score", "score_off").withColumn(
        "score_on", F.col("score_off") + settings.w_bandwidth * F.col("bw_aux") * F.col("cost_norm"))


def score_v2(pairs: DataFrame, peaks: DataFrame, settings: Settings = Settings(),
             capacity: DataFrame | None = None) -> DataFrame:
    """No capacity term; the peak is normalised inside the node. ``legacy_score`` restores the first form."""
    if settings.legacy_score:
        legacy = score_v1(pairs, capacity, settings).withColumnRenamed("score", "score_on")
        return legacy.withColumn("score_off", F.col("score_on"))
    scored = with_profit_penalty(with_cost_norm(pairs), settings.w_profit)
    scored = scored.join(peaks, ["node_id", "business"], "left").withColumn("bw_norm", norm_by_max("peak_mbps"))
    return (scored.withColumn("score_off", F.col("pred_cost") + F.col("profit_pen"))
            .withColumn("score_on", F.col("score_off")
                        + settings.w_bandwidth * F.col("bw_norm") * F.col("cost_norm")))


def best_by_score(scored: DataFrame, score: str, k: int = 3) -> DataFrame:
    return top_k(scored, "node_id", [F.desc(score), F.asc("business")], k)
