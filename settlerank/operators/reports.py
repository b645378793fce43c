"""Report tables: distributions, differences, reviews, unit yield, reachability, capacity, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from settlerank.fixed_values import FAMILY_MEMBERS, FAMILY_REPRESENTATIVE
from settlerank.functions import (any_of, display_label, has_prefix, mapped, missing_count, missing_fields,
                                  ratio_or_null, share_flag)
from settlerank.operators.percentiles import percentile_columns


# -- distributions -----------------------------------------------------------------------------------------

def distribution(df: DataFrame, column: str = "business", top: int = 10, names: DataFrame | None = None) -> DataFrame:
    """Counts of the ``top`` most frequent values and one row for the rest, with shares of the total."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("business")).agg(
        F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    head = counts.orderBy(F.desc("n"), F.asc("business")).limit(top)
    rest = (counts.join(F.broadcast(head.select("business")), "business", "left_anti")
            .agg(F.lit("rest").alias("business"), F.sum("n").alias("n"), F.count("*").alias("k"))
            .where(F.col("k") > 0).drop("k"))
    rows = head.withColumn("is_rest", F.lit(0)).unionByName(rest.withColumn("is_rest", F.lit(1)))
    rows = rows.withColumn("pct", F.round(F.col("n") * 100.0 / total, 1))
    if names is None:
        return rows
    return rows.join(names, "business", "left").withColumn("label", display_label("business_name", "business", 26))


def distribution_difference(recommended: DataFrame, current: DataFrame, top: int = 20) -> DataFrame:
    """Recommended against current node counts per business, the ``top`` largest by their sum."""
    rec = recommended.groupBy("business").agg(F.count("*").alias("rec_n"))
    cur = current.groupBy("business").agg(F.count("*").alias("cur_n"))
    both = rec.join(cur, "business", "full_outer").select(
        "business", F.coalesce("rec_n", F.lit(0)).alias("rec_n"), F.coalesce("cur_n", F.lit(0)).alias("cur_n"))
    return (both.withColumn("delta", F.col("rec_n") - F.col("cur_n"))
            .orderBy(F.desc(F.col("rec_n") + F.col("cur_n")), F.asc("business")).limit(top))


# -- reviews -------------------------------------------------------------------------------------------------

def review_table(wide: DataFrame, current: DataFrame, names: DataFrame) -> DataFrame:
    """Wide recommendations beside the current run, the names of the three ranks, predicted minus current."""
    out = wide.join(current, "node_id", "left")
    for i in (1, 2, 3):
        out = out.join(names.select(F.col("business").alias(f"top{i}_business"),
                                    F.col("business_name").alias(f"top{i}_name")), f"top{i}_business", "left")
    return (out.withColumn("diff_cost", F.col("top1_pred_cost") - F.col("cur_cost7"))
            .withColumn("diff_profit", F.col("top1_pred_profit") - F.col("cur_profit7")))


def review_counts(review: DataFrame) -> DataFrame:
    """Nodes, nodes with a current run, losing current runs, and losing runs whose first choice should gain."""
    has = F.col("has_cur") == 1
    losing = has & (F.col("cur_profit7") < 0)
    return review.agg(F.count("*").alias("nodes"), F.count_if(has).alias("with_current"),
                      F.count_if(losing).alias("losing"),
                      F.count_if(losing & (F.col("top1_pred_profit") > 0)).alias("turns_positive"))


def family_review(wide: DataFrame, truth: DataFrame, names: DataFrame, representative=FAMILY_REPRESENTATIVE,
                  members=FAMILY_MEMBERS) -> DataFrame:
    """Per evaluated node: the true best and its family, the shown first choice, family-level hits."""
    rows = wide.join(truth.select("node_id", "true_best"), "node_id")
    rows = rows.withColumn("tb_fam", mapped("true_best", members)).withColumn(
        "top1_business_id", mapped("top1_business", representative))
    fams = [mapped(f"top{i}_business", members) for i in (1, 2, 3)]
    rows = rows.join(names.select(F.col("business").alias("top1_business_id"),
                                  F.col("business_name").alias("shown")), "top1_business_id", "left")
    return rows.select("node_id", "true_best", "tb_fam", "top1_business_id",
                       display_label("shown", "top1_business_id").alias("top1_label"),
                       any_of("tb_fam", fams[0]).cast("int").alias("hit1"),
                       any_of("tb_fam", *fams).cast("int").alias("hit3"))


def with_current_cell(recs: DataFrame, current: DataFrame) -> DataFrame:
    """Recommendations with the text of the current run; empty where a node runs nothing."""
    cell = F.when(F.col("days") > 0, F.concat_ws(
        " ", "cur_business", F.concat("streak_label", F.format_string(" %.2f / %.2f", "cur_cost", "cur_profit"))))
    return recs.join(current, "node_id", "left").withColumn("current", F.coalesce(cell, F.lit("—")))


# -- unit yield ----------------------------------------------------------------------------------------------

def node_bandwidth(records: DataFrame) -> DataFrame:
    """Largest build bandwidth per node."""
    return records.where(F.col("build_bandwidth").isNotNull()).groupBy(F.col("node_id").alias("bw_node")).agg(
        F.max("build_bandwidth").alias("cap_bw"))


def pair_bandwidth(records: DataFrame) -> DataFrame:
    """Median build bandwidth per node and business. Exact for a pair of any size."""
    keyed = records.where(F.col("build_bandwidth").isNotNull())
    counted = keyed.groupBy("node_id", "business", "build_bandwidth").agg(F.count("*").alias("c"))
    pair = W.partitionBy("node_id", "business")
    upto = pair.orderBy("build_bandwidth").rowsBetween(W.unboundedPreceding, 0)
    ranked = counted.withColumn("n", F.sum("c").over(pair)).withColumn("stop", F.sum("c").over(upto))
    low, high = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    start = F.col("stop") - F.col("c")

    def at(position: Column) -> Column:
        return F.max(F.when((position >= start) & (position < F.col("stop")), F.col("build_bandwidth")))

    return ranked.groupBy("node_id", "business").agg(((at(low) + at(high)) / 2).alias("cap_bw"))


def unit_yield(ledger: DataFrame, bandwidth: DataFrame) -> DataFrame:
    """Cost per bandwidth for ledger rows; ``bandwidth`` is per node (bw_node) or per pair."""
    if "bw_node" in bandwidth.columns:
        joined = ledger.join(bandwidth, ledger["node_id"] == bandwidth["bw_node"]).drop("bw_node")
    else:
        joined = ledger.join(bandwidth, ["node_id", "business"])
    return joined.withColumn("unit_cost", ratio_or_null("cum_cost_7d", "cap_bw"))


def best_by_cost_and_unit(rows: DataFrame) -> DataFrame:
    """Per node: its best business by cost and by unit cost, and whether they agree.

    One pass: the minimum of (negated value, id) keeps one row per node and task.
    """
    def best(value: str) -> Column:
        key = F.struct((-F.col(value)).alias("neg"), F.col("business").alias("business"),
                       F.col("cum_cost_7d").alias("cost"), F.col("unit_cost").alias("unit"))
        return F.min(F.when(F.col(value).isNotNull(), key))

    out = rows.groupBy("node_id").agg(F.count("*").alias("n_biz"), best("cum_cost_7d").alias("a"),
                                      best("unit_cost").alias("u"))
    return out.select("node_id", "n_biz", F.col("a.business").alias("abs_best"), F.col("u.business").alias("unit_best"),
                      any_of("a.business", "u.business").cast("int").alias("same"),
                      F.col("a.cost").alias("abs_cost_abs"), F.col("u.cost").alias("abs_cost_unit"),
                      F.col("a.unit").alias("unit_abs"), F.col("u.unit").alias("unit_unit"))


def unit_summary(best: DataFrame, prefix: str = "ant") -> DataFrame:
    """Per stratum: nodes, agreement rate, and the median gain and drop among nodes that disagree."""
    flagged = best.withColumn("stratum", F.when(has_prefix("node_id", prefix), "prefix").otherwise("other"))
    both = flagged.withColumn("stratum", F.explode(F.array(F.lit("all"), F.col("stratum"))))
    base = both.groupBy("stratum").agg(F.count("*").alias("nodes"), F.round(F.avg("same") * 100, 1).alias("same_pct"),
                                       F.count_if(F.col("same") == 0).alias("different"))
    differ = both.where(F.col("same") == 0)
    gain = percentile_columns(differ.withColumn("g", ratio_or_null("unit_unit", "unit_abs") - 1), ["stratum"], "g",
                              {"gain": 0.5})
    drop = percentile_columns(differ.withColumn("d", ratio_or_null("abs_cost_unit", "abs_cost_abs") - 1), ["stratum"],
                              "d", {"drop": 0.5})
    return (base.join(gain, "stratum", "left").join(drop, "stratum", "left")
            .select("stratum", "nodes", "same_pct", "different", F.round(F.col("gain") * 100, 1).alias("unit_gain_pct"),
                    F.round(F.col("drop") * 100, 1).alias("cost_drop_pct")))


# -- reachability and capacity -------------------------------------------------------------------------------

def reachability(daily_peaks: DataFrame, nominal: DataFrame) -> DataFrame:
    """Per node: active days and businesses, highest and median daily peak, utilisation in percent.

    Built-in distinct counts and median are safe here: a node has at most one row per day and business.
    """
    feats = daily_peaks.groupBy("node_id").agg(
        F.count_distinct("day").alias("bw_days"), F.count_distinct("business").alias("biz_count"),
        F.max("peak_mbps").alias("peak_max"), F.median("peak_mbps").alias("peak_p50"))
    joined = feats.join(nominal.select("node_id", "nominal_bw"), "node_id", "left")
    return (joined.withColumn("days_ratio_7", F.col("bw_days") / 7.0)
            .withColumn("util_p50", ratio_or_null("peak_p50", "nominal_bw") * 100.0)
            .withColumn("util_max", ratio_or_null("peak_max", "nominal_bw") * 100.0))


def five_numbers(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of one column."""
    rows = df.where(F.col(value).isNotNull())
    base = rows.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                    F.min(value).alias("min"), F.max(value).alias("max")).withColumn("field", F.lit(value))
    quartiles = percentile_columns(rows.withColumn("field", F.lit(value)), ["field"], value,
                                   {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return base.join(quartiles, "field", "left")


def below_counts(df: DataFrame, value: str, limits: Sequence[float]) -> DataFrame:
    return df.agg(F.count(value).alias("n"), *[F.count_if(F.col(value) < x).alias(f"below_{int(x)}") for x in limits])


def business_capacity(daily_peaks: DataFrame, target: float = 0.7, pairs: DataFrame | None = None) -> DataFrame:
    """Capacity per business from daily peaks: p75 over the target, the current load, room and overrun.

    The load is the sum over nodes on each day; its p75 over days gives the capacity, the last day the load. ``pairs`` are the
    distinct (business, node_id) of the peaks, where they are known already.
    """
    per_day = daily_peaks.groupBy("business", "day").agg(F.sum("peak_mbps").alias("traffic"))
    pairs = daily_peaks.groupBy("business", "node_id").agg(F.lit(1).alias("one")) if pairs is None else pairs
    p75 = percentile_columns(per_day, ["business"], "traffic", {"traffic_p75": 0.75})
    days = per_day.groupBy("business").agg(F.count("*").alias("days"),
                                           F.max(F.struct("day", "traffic")).getField("traffic").alias("load"))
    nodes = pairs.groupBy("business").agg(F.count("*").alias("sample_nodes"))
    out = p75.join(days, "business").join(nodes, "business").withColumn("upper", F.col("traffic_p75") / target)
    return out.select("business", "days", "sample_nodes", F.col("traffic_p75").alias("traffic_p75_mbps"),
                      F.col("upper").alias("capacity_upper_mbps"), F.lit(target).alias("util_at_capacity"),
                      F.col("load").alias("current_daily_peak95_sum_mbps"),
                      F.greatest(F.lit(0.0), F.col("upper") - F.col("load")).alias("can_add_mbps"),
                      F.greatest(F.lit(0.0), F.col("load") - F.col("upper")).alias("over_capacity_mbps"))


# -- coverage --------------------------------------------------------------------------------------------------

def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null count and rate per column: one aggregate turned into rows."""
    one = df.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("filled")) for c in cols])
    return one.select("total", F.explode(pairs).alias("x")).select(
        "x.field", F.col("x.filled").alias("rows_non_null"), F.col("total").alias("rows_total"),
        F.round(ratio_or_null("x.filled", "total"), 4).alias("coverage"))


def incomplete_rows(df: DataFrame, cols: Sequence[str], key: str = "node_id") -> DataFrame:
    rows = df.select(key, missing_count(cols).alias("n_missing"), missing_fields(cols).alias("missing_fields"))
    return rows.where(F.col("n_missing") > 0)


def missing_histogram(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(missing_count(cols).alias("n_missing")).where(F.col("n_missing") > 0).groupBy("n_missing").agg(
        F.count("*").alias("n_nodes"))


def key_overlap(target: DataFrame, attrs: DataFrame, key: str = "node_id") -> DataFrame:
    """Distinct target keys, and how many of them have or lack attributes: one join with a flag."""
    known = attrs.select(key).distinct().withColumn("found", F.lit(1))
    rows = target.select(key).distinct().join(known, key, "left")
    return rows.agg(F.count("*").alias("target_nodes"), F.count("found").alias("in_attrs"),
                    F.count_if(F.col("found").isNull()).alias("not_in_attrs"))


def prefix_counts(df: DataFrame, prefix: str = "ant", key: str = "node_id") -> DataFrame:
    """Rows, distinct keys and distinct keys with the prefix."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_nodes"),
                       F.sum(share_flag(has_prefix(key, prefix))).alias("n_prefix_nodes"))

