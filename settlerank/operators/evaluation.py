"""Ranking quality, regression error, strata, A/B comparison, amplification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from settlerank.functions import any_of, has_prefix, ratio_or_null, share_flag


def hits(recs: DataFrame, truth: DataFrame, how: str = "inner", keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per node (and key) with hit1, hit3 and the profit flag of the first rank."""
    per_node = recs.groupBy(*keys, "node_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("business"))).alias("top1"),
        F.max(F.when(F.col("rank") == 2, F.col("business"))).alias("top2"),
        F.max(F.when(F.col("rank") == 3, F.col("business"))).alias("top3"),
        F.max(F.when(F.col("rank") == 1, F.col("profit_positive"))).alias("profit_positive")
        if "profit_positive" in recs.columns else F.lit(None).cast("int").alias("profit_positive"))
    joined = per_node.join(truth.select("node_id", "true_best"), "node_id", how)
    return joined.select(*keys, "node_id", "top1", "top2", "top3", "true_best", "profit_positive",
                         any_of("true_best", "top1").cast("int").alias("hit1"),
                         any_of("true_best", "top1", "top2", "top3").cast("int").alias("hit3"))


def hit_rates(hit_rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return hit_rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg("hit1"), 4).alias("hit_at_1"), F.round(F.avg("hit3"), 4).alias("hit_at_3"),
        F.round(F.avg(F.coalesce("profit_positive", F.lit(0))), 4).alias("top1_profit_positive_rate"))


def regression_error(df: DataFrame, actual: str, predicted: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """MAE, RMSE, R2 = 1 - SSE/SST and WAPE, with predictions floored at zero; one pass of plain sums.

    SST uses the group's variance aggregate, which is stable for large values.
    """
    y, p = F.col(actual), F.greatest(F.col(predicted), F.lit(0.0))
    rows = df.where(y.isNotNull() & F.col(predicted).isNotNull())
    sse, n = F.sum((y - p) * (y - p)), F.count("*")
    return rows.groupBy(*keys).agg(
        n.alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(sse / n).alias("rmse"),
        (F.lit(1.0) - ratio_or_null(sse, F.var_pop(y) * n)).alias("r2"),
        (F.sum(F.abs(y - p)) / F.greatest(F.sum(F.abs(y)), F.lit(1e-12))).alias("wape"))


def error_deltas(errors: DataFrame, variant: str = "variant", base: str = "direct") -> DataFrame:
    """WAPE of every variant and its difference to the base variant."""
    reference = errors.where(F.col(variant) == base).agg(F.max("wape").alias("base_wape")).scalar()
    return errors.select(variant, "n", "mae", "r2", "wape", F.round(reference - F.col("wape"), 4).alias("wape_gain"))


def stratified(hit_rows: DataFrame, prefix: str = "ant") -> DataFrame:
    """All, prefix and other nodes: count, share, hit rates in percent, in one pass; an absent stratum has n = 0."""
    inside = {"all": F.lit(True), "prefix": has_prefix("node_id", prefix), "other": ~has_prefix("node_id", prefix)}
    rows = [F.struct(F.lit(name).alias("stratum"), F.count_if(flag).alias("n"), F.avg(F.when(flag, F.col("hit1"))).alias("h1"),
                     F.avg(F.when(flag, F.col("hit3"))).alias("h3")) for name, flag in inside.items()]
    found = hit_rows.agg(F.array(*rows).alias("rows"), F.count("*").alias("_all")).select(F.inline("rows"), "_all")
    return found.select("stratum", "n", F.round(ratio_or_null(F.col("n") * 100.0, F.col("_all")), 1).alias("share_pct"),
                        F.round(F.col("h1") * 100, 2).alias("hit1_pct"), F.round(F.col("h3") * 100, 2).alias("hit3_pct"))


def strata(rows: DataFrame, dims: Sequence[str], aggs: Sequence[Column], domains: Mapping[str, Sequence[str]] | None = None,
           count: str = "n", every: str = "all") -> DataFrame:
    """Aggregates for every combination of ``dims`` and of ``every`` in their place, from one Expand and one shuffle.

    A stratum is told by its grouping id, so a null value is a stratum of its own (null) and not the total. With ``domains``
    (fixed values of some of the columns) strata of these values that have no row are kept with a ``count`` of 0.
    """
    text = rows.withColumns({d: F.col(d).cast("string") for d in dims})
    sets = [[d for i, d in enumerate(dims) if mask >> i & 1] for mask in range(1 << len(dims))]
    found = text.groupingSets([[F.col(d) for d in one] for one in sets], *[F.col(d) for d in dims]).agg(
        F.count("*").alias(count), *aggs, *[F.grouping(d).alias(f"_g_{d}") for d in dims])
    found = found.withColumns({d: F.when(F.col(f"_g_{d}") == 1, F.lit(every)).otherwise(F.col(d)) for d in dims}).drop(
        *[f"_g_{d}" for d in dims])
    if not domains:
        return found
    known = [d for d in dims if d not in domains]
    whole = found.select(*known).distinct() if known else found.sparkSession.range(1).select(F.lit(1).alias("_one"))
    for d, values in domains.items():
        whole = whole.withColumn(d, F.explode(F.array(*[F.lit(v) for v in [*values, every]])))
    left, right = whole.alias("w"), found.alias("f")
    same = reduce(lambda a, b: a & b, [F.col(f"w.{d}").eqNullSafe(F.col(f"f.{d}")) for d in dims])
    return left.join(right, same, "full").select(*[F.coalesce(f"w.{d}", f"f.{d}").alias(d) for d in dims],
                                                 F.coalesce(f"f.{count}", F.lit(0)).alias(count),
                                                 *[F.col(f"f.`{c}`") for c in found.columns if c not in (*dims, count)])


def compare_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Align two hit tables by node: both first choices, both hit flags, same-first flag."""
    left = a.select("node_id", "true_best", F.col("top1").alias("a_top1"), F.col("hit1").alias("a_hit1"),
                    F.col("hit3").alias("a_hit3"))
    right = b.select("node_id", F.col("top1").alias("b_top1"), F.col("hit1").alias("b_hit1"),
                     F.col("hit3").alias("b_hit3"))
    return left.join(right, "node_id").withColumn("same_top1", any_of("a_top1", "b_top1").cast("int"))


def hit_crosstab(pairs: DataFrame) -> DataFrame:
    """2 x 2 table of first-choice hits, absent cells as zero."""
    def cell(a: int, b: int):
        return F.count_if((F.col("a_hit1") == a) & (F.col("b_hit1") == b))
    counts = pairs.agg(F.array(*[F.struct(F.lit(a).alias("a_hit1"), cell(a, 0).alias("b_miss"), cell(a, 1).alias("b_hit"))
                                 for a in (0, 1)]).alias("cells"))
    return counts.select(F.inline("cells"))


def disagreements(pairs: DataFrame, prefix: str = "ant") -> DataFrame:
    """Nodes only one run gets right, with the prefix count of each side."""
    side = F.when((F.col("a_hit1") == 1) & (F.col("b_hit1") == 0), "only_a").when(
        (F.col("a_hit1") == 0) & (F.col("b_hit1") == 1), "only_b")
    return (pairs.withColumn("side", side).where(F.col("side").isNotNull()).groupBy("side")
            .agg(F.count("*").alias("n"), F.count_if(has_prefix("node_id", prefix)).alias("n_prefix")))


def ab_summary(on: DataFrame, off: DataFrame, truth: DataFrame, aux: DataFrame) -> DataFrame:
    """Mean first-choice cost and profit, hit rates, changed first choices and nodes with a positive aux."""
    def side(recs: DataFrame, tag: str) -> DataFrame:
        first = recs.where(F.col("rank") == 1).select("node_id", F.col("pred_cost").alias(f"{tag}_cost"),
                                                      F.col("pred_profit").alias(f"{tag}_profit"))
        hit = hits(recs, truth).select("node_id", F.col("top1").alias(f"{tag}_top1"),
                                       F.col("hit1").alias(f"{tag}_hit1"), F.col("hit3").alias(f"{tag}_hit3"))
        return first.join(hit, "node_id")
    flag = aux.groupBy("node_id").agg(F.max(share_flag(F.col("bw_aux") > 0)).alias("has_aux"))
    both = side(on, "on").join(side(off, "off"), "node_id").join(flag, "node_id", "left")
    means = [F.round(F.avg(f"{t}_{m}"), d).alias(f"{t}_{m}") for t in ("on", "off")
             for m, d in (("cost", 2), ("profit", 2), ("hit1", 4), ("hit3", 4))]
    return both.agg(F.count("*").alias("n_nodes"), *means,
                    F.count_if(F.col("on_top1") != F.col("off_top1")).alias("changed_top1"),
                    F.count_if(F.col("has_aux") == 1).alias("aux_nodes"))


def amplification(recs_top1: DataFrame, truth: DataFrame) -> DataFrame:
    """Share among first choices against share among true bests; the ratio is null when truth has none."""
    rec = recs_top1.groupBy("business").agg(F.count("*").alias("rec_n"))
    real = truth.groupBy(F.col("true_best").alias("business")).agg(F.count("*").alias("true_n"))
    rec_total = rec.agg(F.sum("rec_n")).scalar()
    real_total = real.agg(F.sum("true_n")).scalar()
    both = rec.join(real, "business", "full_outer").select(
        "business", (F.coalesce("rec_n", F.lit(0)) * 100.0 / rec_total).alias("rec_pct"),
        (F.coalesce("true_n", F.lit(0)) * 100.0 / real_total).alias("true_pct"))
    return both.select("business", F.round("rec_pct", 1).alias("rec_pct"), F.round("true_pct", 1).alias("true_pct"),
                       F.round(ratio_or_null("rec_pct", "true_pct"), 2).alias("ratio"))
