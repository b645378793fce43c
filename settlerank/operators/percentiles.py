"""Exact interpolated percentiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task. Here equal values are counted before they
are shuffled, then all (group, value) rows are cut into ranges of even size, which also cuts a group that is large. Counts
per range give the place of every range in its group, and only the ranges that hold a wanted position are ordered. Wanted
positions are never copied into the rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from settlerank.session import cut_lineage


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Rows (by..., p, n, value): the linear-interpolation percentile of every non-null group."""
    by = list(by)
    grouped = df.select(*by, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    for key in by:
        grouped = grouped.where(F.col(key).isNotNull())
    counted = grouped.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    # the number of a range is the place of its partition; it is stored, because a second run could cut elsewhere
    placed = cut_lineage(counted.repartitionByRange(*by, "_v").withColumn("_range", F.spark_partition_id()), "ranges")

    # how many values lie before each range, and whether a wanted order statistic falls into it; one small row a range
    sizes = placed.groupBy(*by, "_range").agg(F.sum("_c").alias("_size"))
    group = W.partitionBy(*by)
    spans = sizes.select(
        *by, "_range", F.sum("_size").over(group).alias("n"), F.col("_size"),
        (F.sum("_size").over(group.orderBy("_range").rowsBetween(W.unboundedPreceding, 0))
         - F.col("_size")).alias("_before"))
    asked = sorted({float(p) for p in probs})
    held = _asked_near(asked, F.col("_before"), F.col("_before") + F.col("_size"))
    # stored, because its true size lets the optimizer broadcast it
    spans = cut_lineage(spans.where(F.size(held) > 0).drop("_size"), "spans")
    needed = placed.join(spans, by + ["_range"])
    within = W.partitionBy(*by, "_range").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = needed.withColumn("_stop", F.col("_before") + F.sum("_c").over(within)).withColumn(
        "_start", F.col("_stop") - F.col("_c"))

    # a row carries no wanted positions; the few that lie in it are looked up in one literal list
    picked = ranked.select(*by, "n", "_v", "_start", "_stop",
                           F.explode(_asked_near(asked, F.col("_start"), F.col("_stop"))).alias("p"))
    picked = picked.withColumn("_pos", F.col("p") * (F.col("n") - 1))

    def at(position):
        inside = (position >= F.col("_start")) & (position < F.col("_stop"))
        return F.max(F.when(inside, F.col("_v")))

    ends = picked.groupBy(*by, "n", "p", "_pos").agg(at(F.floor("_pos")).alias("_a"), at(F.ceil("_pos")).alias("_b"))
    return ends.select(*by, "p", "n", (F.col("_a") + (F.col("_b") - F.col("_a"))
                                       * (F.col("_pos") - F.floor("_pos"))).alias("value"))


def _asked_near(asked: Sequence[float], start: Column, stop: Column) -> Column:
    """The percentiles whose position among ``n`` values has its lower or upper neighbour in [start, stop).

    The sorted percentiles are indexed by an even grid of as many steps, so a row reads the few of its own steps only.
    """
    steps = len(asked)
    first = [bisect_left(asked, i / steps) for i in range(steps + 1)] + [steps]
    last = F.greatest(F.col("n") - 1, F.lit(1))

    def step(place: Column) -> Column:
        return F.least(F.greatest(F.floor(place / last * steps), F.lit(0)), F.lit(steps)).cast("int")

    low = F.element_at(F.lit(first), F.greatest(step(start - 1) - 1, F.lit(0)) + 1)
    high = F.element_at(F.lit(first), F.least(step(stop) + 1, F.lit(steps + 1)) + 1)
    position = F.lit(1.0) * (F.col("n") - 1)
    some = F.slice(F.lit(list(asked)), low + 1, F.greatest(high - low, F.lit(0)))

    def inside(place: Column) -> Column:
        return (place >= start) & (place < stop)

    return F.filter(some, lambda p: inside(F.floor(p * position)) | inside(F.ceil(p * position)))


def percentile_columns(df: DataFrame, by: Sequence[str], value: str, names: dict[str, float], **kw) -> DataFrame:
    """The same with one named column per percentile."""
    rows = exact_percentiles(df, by, value, list(names.values()), **kw)
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("p") == F.lit(float(p)), F.col("value"))).alias(name)
                                   for name, p in names.items()])


def long_values(df: DataFrame, cols: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as (keep..., field, value) rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.field", "x.value")
