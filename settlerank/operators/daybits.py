"""Exact distinct counts that are stored by day and merged: bitmaps of numbered ids.

Text ids get whole numbers from a dictionary that only grows. Per day, group and bucket of 32768 numbers one bitmap of 4 kB
holds who was there; bitmaps of several days are merged by a bitwise or, and their bits counted. Counting
any span of days reads bitmaps only, whatever the number of rows behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from settlerank.session import cut_lineage


def numbered_ids(ids: DataFrame, known: DataFrame | None = None, key: str = "node_id") -> DataFrame:
    """key, number: the known numbers, and the next free ones for new ids in their order. No task holds all ids.

    New ids are cut into ranges; a number is the place in the range plus the sizes of the ranges before.
    """
    distinct = ids.select(key).where(F.col(key).isNotNull()).distinct()
    first = 0
    if known is not None:
        distinct = distinct.join(known.select(key), key, "left_anti")
        first = (known.agg(F.max("number")).first()[0] or 0)
    ranged = cut_lineage(distinct.repartitionByRange(key).withColumn("_range", F.spark_partition_id()), "id-ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)),
                                               F.lit(0)).alias("_before"))                       # one row a range
    own = F.row_number().over(W.partitionBy("_range").orderBy(key))
    fresh = ranged.withColumn("_own", own).join(F.broadcast(before), "_range").select(
        key, (F.col("_own") + F.col("_before") + F.lit(first)).alias("number"))
    return cut_lineage(fresh if known is None else known.select(key, "number").unionByName(fresh), "id-numbers")


def day_bitmaps(rows: DataFrame, numbers: DataFrame, groups: Sequence[str], day: str = "day", key: str = "node_id") -> DataFrame:
    """day, groups, bucket, bits: who occurs on a day in a group. Rows without an id are no one."""
    number = F.col("number")
    return (rows.select(day, *groups, key).join(numbers, key)
            .groupBy(day, *groups, F.bitmap_bucket_number(number).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")))


def merged_counts(bitmaps: DataFrame, groups: Sequence[str], span: Column | None = None, name: str = "n_distinct") -> DataFrame:
    """groups, the number of distinct ids over the days of ``span`` (all where none is given)."""
    some = bitmaps if span is None else bitmaps.where(span)
    merged = some.groupBy(*groups, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return merged.groupBy(*groups).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias(name))
