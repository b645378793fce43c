"""Time-ordered train/test split, sampling and the hold-out flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from settlerank.functions import hash_share


def first_days(frame: DataFrame, day: str = "online_day") -> DataFrame:
    return frame.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.min(day).alias("intro_day"))


def split_at_day(nodes: DataFrame, cut_day: str) -> DataFrame:
    """Before the day: train; from the day on: test; a node without a day is in neither."""
    cut = F.lit(cut_day).cast("date")
    return nodes.where(F.col("intro_day").isNotNull()).withColumn("is_test", F.col("intro_day") >= cut)


def _running(df: DataFrame, order) -> DataFrame:
    """Add the count of rows before each row of a table with one row per distinct small key."""
    upto = W.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("before", F.sum("n").over(upto) - F.col("n"))


def split_by_ratio(nodes: DataFrame, ratio: float = 0.8) -> DataFrame:
    """The first ``floor(ratio * n)`` nodes by day are train; equal days fall in md5(node_id) order.

    No global sort: the cut is one key (day, md5). Counts per calendar day give the boundary day, counts
    per three-digit md5 prefix of that day's nodes the boundary prefix, and only the nodes below that prefix
    (1/4096 of the day) are ordered. Pass ``nodes`` as a stored table, since it is read four times.
    """
    total = nodes.agg(F.floor(F.lit(float(ratio)) * F.count("*")).alias("n_train"))
    keyed = nodes.withColumn("day_no", F.coalesce(F.unix_date("intro_day"), F.lit(2147483647)))

    def boundary(counts: DataFrame, order, need) -> DataFrame:
        """The row of a small count table in which the needed position lies, and what is still needed there."""
        return (_running(counts, order).withColumn("need", need)
                .where((F.col("before") < F.col("need")) & (F.col("before") + F.col("n") >= F.col("need")))
                .withColumn("need", F.col("need") - F.col("before")))

    day = boundary(keyed.groupBy("day_no").agg(F.count("*").alias("n")), ["day_no"], total.scalar())
    same_day = (keyed.join(F.broadcast(day.select("day_no", "need")), "day_no")
                .withColumn("h", F.md5("node_id")).withColumn("prefix", F.substring("h", 1, 3)))
    prefix = boundary(same_day.groupBy("day_no", "prefix", "need").agg(F.count("*").alias("n"))
                      .withColumnRenamed("need", "need_day"), ["prefix"], F.col("need_day"))
    last = (same_day.drop("need").join(F.broadcast(prefix.select("day_no", "prefix", "need")), ["day_no", "prefix"])
            .withColumn("rn", F.row_number().over(W.partitionBy("day_no", "prefix").orderBy("h", "node_id")))
            .where(F.col("rn") == F.col("need")))
    # one row at most: the key of the last training node ("" sorts before every key)
    cut = last.agg(F.max(F.struct("day_no", "h", "node_id")).alias("cut")).scalar()
    key = F.struct("day_no", F.md5("node_id").alias("h"), "node_id")
    return keyed.withColumn("is_test", F.coalesce(key > cut, F.lit(True))).select("node_id", "intro_day", "is_test")


def temporal_split(nodes: DataFrame, ratio: float = 0.8, cut_day: str | None = None) -> DataFrame:
    """(node_id, intro_day, is_test) by a cut day when one is given, otherwise by ratio."""
    return split_at_day(nodes, cut_day) if cut_day else split_by_ratio(nodes, ratio)


def with_side(frame: DataFrame, split: DataFrame) -> DataFrame:
    """The ledger with the is_test flag of its node; nodes outside the split drop out."""
    return frame.join(split.select("node_id", "is_test"), "node_id")


def validation_flag(frame: DataFrame, share: float = 0.15, seed: int = 42) -> DataFrame:
    """A repeatable random share of (node, business) rows for early stopping."""
    return frame.withColumn("is_valid", hash_share(share, seed, "node_id", "business"))


def seeded_sample(frame: DataFrame, attrs: DataFrame, n: int, seed: int, min_businesses: int = 2) -> DataFrame:
    """``n`` node ids drawn by seeded hash among nodes with several businesses and attributes."""
    rich = frame.groupBy("node_id").agg(F.count_distinct("business").alias("n_businesses")).where(
        F.col("n_businesses") >= min_businesses)
    eligible = rich.join(attrs.select("node_id"), "node_id", "left_semi")
    return eligible.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "node_id")), "node_id").limit(n)
