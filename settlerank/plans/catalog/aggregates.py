"""A01-A34 aggregations."""

from pyspark.sql import functions as F

from settlerank.operators import candidates, daybits, evaluation, ledger, ranking, reports, stats
from settlerank.operators.daystore import DayStore
from settlerank.plans.catalog.columns import FAMILIES, MISSING, sparse_attrs, two_runs
from settlerank.plans.catalog.joins import PAIR_BW
from settlerank.plans.flow import flow_of
from settlerank.plans.registry import query
from settlerank.plans.twins import twin
from settlerank.session import cut_lineage, stage_path
from settlerank.sources import tables


def rounded(df, digits=4):
    """All double columns rounded, the rest as they are."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("q_a01_business_stats", twin("""
    SELECT business, round(cost_mean, 4) AS cost_mean, round(cost_p90, 4) AS cost_p90,
           round(profit_mean, 4) AS profit_mean, support, round(cost_mean_log, 6) AS cost_mean_log,
           round(cost_p90_log, 6) AS cost_p90_log, round(profit_mean_log, 6) AS profit_mean_log,
           round(support_log, 6) AS support_log FROM stats""", "stats"))
def a01(spark, sf):
    logs = ["cost_mean_log", "cost_p90_log", "profit_mean_log", "support_log"]
    return stats.business_stats(flow_of(spark, sf).train).select(
        "business", *[F.round(c, 4).alias(c) for c in ("cost_mean", "cost_p90", "profit_mean")], "support",
        *[F.round(c, 6).alias(c) for c in logs])


@query("q_a02_profit_floor", twin("SELECT business, round(profit_p10, 4) AS profit_p10 FROM stats", "stats"))
def a02(spark, sf):
    return rounded(stats.profit_floor(flow_of(spark, sf).train))


@query("q_a03_support", twin("""
    SELECT business, count(DISTINCT node_id) AS support FROM daily GROUP BY 1""", "daily"))
def a03(spark, sf):
    return stats.business_support(tables.daily_settlement(spark, sf))


@query("q_a04_first_seen", twin("""
    SELECT node_id, strftime(intro_day, '%Y-%m-%d') AS intro_day FROM nodes""", "nodes"))
def a04(spark, sf):
    days = tables.ledger_totals(spark, sf).groupBy("node_id").agg(F.min("online_day").alias("intro_day"))
    return days.join(tables.node_keys(spark, sf), "node_id", "left_semi").select(
        "node_id", F.date_format("intro_day", "yyyy-MM-dd").alias("intro_day"))


@query("q_a05_ledger_7d", twin("""
    SELECT node_id, business, strftime(business_online_day, '%Y-%m-%d') AS business_online_day,
           CAST(outcome_days AS INT) AS outcome_days, round(cum_cost_7d, 2) AS cum_cost_7d,
           round(cum_revenue_7d, 2) AS cum_revenue_7d FROM led7""", "led7"))
def a05(spark, sf):
    led = ledger.first_window_ledger(tables.daily_settlement(spark, sf))
    return led.select("node_id", "business", F.date_format("business_online_day", "yyyy-MM-dd").alias(
        "business_online_day"), "outcome_days", F.round("cum_cost_7d", 2).alias("cum_cost_7d"),
        F.round("cum_revenue_7d", 2).alias("cum_revenue_7d"))


@query("q_a05_ledger_by_days", twin("""
    SELECT node_id, business, strftime(business_online_day, '%Y-%m-%d') AS business_online_day,
           CAST(outcome_days AS INT) AS outcome_days, round(cum_cost_7d, 2) AS cum_cost_7d,
           round(cum_revenue_7d, 2) AS cum_revenue_7d FROM led7""", "led7"))
def a05_by_days(spark, sf):
    """The same ledger from a day store that takes in three parts, the last one first."""
    daily = cut_lineage(tables.daily_settlement(spark, sf).select("node_id", "business", "day", "cost", "revenue"), "daily")
    low, high = daily.agg(F.min("day"), F.max("day")).first()
    third, store = (high - low) // 3, DayStore(spark, stage_path(spark, "day-store"))
    day, ends = F.col("day"), (low + third, low + 2 * third)
    for part in (day >= F.lit(ends[1]), day < F.lit(ends[0]), (day >= F.lit(ends[0])) & (day < F.lit(ends[1]))):
        store.load(daily.where(part))
    return store.ledger.select("node_id", "business", F.date_format("business_online_day", "yyyy-MM-dd").alias(
        "business_online_day"), "outcome_days", F.round("cum_cost_7d", 2).alias("cum_cost_7d"),
        F.round("cum_revenue_7d", 2).alias("cum_revenue_7d"))


@query("q_a06_ledger_scale", twin("""
    SELECT count(*) AS full_pairs, count(DISTINCT node_id) AS full_nodes, count(DISTINCT business) AS businesses
    FROM led7 WHERE outcome_days >= 3""", "led7"))
def a06(spark, sf):
    return ledger.scale_summary(ledger.first_window_ledger(tables.daily_settlement(spark, sf)), 3)


@query("q_a07_segment_sums", twin("""
    SELECT seg, business, seg_rows, round(seg_cost_sum, 4) AS seg_cost_sum FROM segstat""", "segstat"))
def a07(spark, sf):
    return flow_of(spark, sf).segment_stats.select("seg", "business", "seg_rows",
                                                   F.round("seg_cost_sum", 4).alias("seg_cost_sum"))


@query("q_a08_global_means", twin("""
    SELECT round((SELECT avg(cost_mean) FROM stats), 4) AS mean_of_means,
           round((SELECT avg(cum_cost_7d) FROM pool_train), 4) AS mean_of_rows""", "stats", "pool_train"))
def a08(spark, sf):
    flow = flow_of(spark, sf)
    means = stats.prior_of_means(flow.stats).withColumnRenamed("global_mean", "m")
    return means.select(F.round("m", 4).alias("mean_of_means"),
                        F.round(stats.prior_of_rows(flow.pool_train).scalar(), 4).alias("mean_of_rows"))


@query("q_a09_family_merge", twin("""
    SELECT node_id, business, round(sum(cum_cost_7d), 4) AS cum_cost_7d, round(sum(cum_revenue_7d), 4) AS cum_revenue_7d,
           CAST(max(outcome_days) AS INT) AS outcome_days, strftime(min(online_day), '%Y-%m-%d') AS online_day,
           min(business_name) AS business_name FROM fams GROUP BY 1, 2""", "fams"))
def a09(spark, sf):
    merged = ledger.merge_families(tables.ledger_totals(spark, sf), rules=FAMILIES)
    return rounded(merged.drop("cum_profit_7d").withColumn("online_day", F.date_format("online_day", "yyyy-MM-dd")))


@query("q_a10_prefix_share", twin("""
    SELECT business, round(avg(CAST(starts_with(node_id, '1') AS INT)), 6) AS prefix_share, count(*) AS n_rows
    FROM totals GROUP BY 1""", "totals"))
def a10(spark, sf):
    return rounded(ledger.prefix_shares(tables.ledger_totals(spark, sf), "1"), 6)


@query("q_a11_peak_per_pair", twin("SELECT node_id, business, round(peak_mbps, 2) AS peak_mbps FROM peaks", "peaks"))
def a11(spark, sf):
    return rounded(flow_of(spark, sf).peaks, 2)


@query("q_a12_run_history", twin("SELECT DISTINCT node_id, business FROM daily", "daily"))
def a12(spark, sf):
    return candidates.run_history(tables.daily_settlement(spark, sf))


REACH = twin("""
    SELECT node_id, bw_days, biz_count, round(peak_max, 4) AS peak_max, round(peak_p50, 4) AS peak_p50,
           round(bw_days / 7.0, 6) AS days_ratio_7, round(peak_p50 / nullif(n_orders, 0) * 100, 4) AS util_p50,
           round(peak_max / nullif(n_orders, 0) * 100, 4) AS util_max
    FROM (SELECT node_id, count(DISTINCT day) AS bw_days, count(DISTINCT business) AS biz_count, max(peak) AS peak_max,
                 median(peak) AS peak_p50 FROM daily GROUP BY 1) LEFT JOIN attrs USING (node_id)""", "daily", "attrs")


def reach(flow):
    daily = tables.daily_settlement(flow.spark, flow.sf_dir).withColumnRenamed("peak", "peak_mbps")
    return reports.reachability(daily, flow.nominal)


@query("q_a13_reachability", REACH)
def a13(spark, sf):
    feats = reach(flow_of(spark, sf))
    return feats.select("node_id", "bw_days", "biz_count", *[F.round(c, 4).alias(c) for c in ("peak_max", "peak_p50")],
                        F.round("days_ratio_7", 6).alias("days_ratio_7"),
                        *[F.round(c, 4).alias(c) for c in ("util_p50", "util_max")])


@query("q_a14_capacity_bandwidth", f"""
    SELECT p.node_id, p.business, p.cap_bw AS pair_median, n.cap_bw AS node_max FROM {PAIR_BW} p
    JOIN (SELECT CAST(o_custkey AS VARCHAR) AS node_id, max(l_quantity) AS cap_bw
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) n USING (node_id)""")
def a14(spark, sf):
    records = tables.build_bandwidth(spark, sf)
    node = reports.node_bandwidth(records).select(F.col("bw_node").alias("node_id"), F.col("cap_bw").alias("node_max"))
    return reports.pair_bandwidth(records).withColumnRenamed("cap_bw", "pair_median").join(node, "node_id")


DISTRIBUTION = twin("""
    ,c AS (SELECT business, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, business) AS rn
            FROM rec_off WHERE rank = 1 GROUP BY 1)
    SELECT CASE WHEN rn <= 10 THEN business ELSE 'rest' END AS business, CAST(sum(n) AS BIGINT) AS n,
           CAST(rn > 10 AS INT) AS is_rest, round(sum(n) * 100.0 / (SELECT sum(n) FROM c), 1) AS pct
    FROM c GROUP BY 1, 3""", "rec_off")


@query("q_a15_distribution", DISTRIBUTION)
def a15(spark, sf):
    return reports.distribution(flow_of(spark, sf).recs("score_off").where("rank = 1"))


@query("q_a16_top12", """
    SELECT event_type || '-' || (user_id % 7) AS business, count(*) AS n_nodes FROM events GROUP BY 1
    ORDER BY n_nodes DESC, business LIMIT 12""")
def a16(spark, sf):
    key = F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string"))
    return ranking.top_businesses(tables.table(spark, sf, "events").select(key.alias("business")))


@query("q_a17_hit_crosstab", twin("""
    SELECT a.hit1 AS a_hit1, count(*) FILTER (b.hit1 = 0) AS b_miss, count(*) FILTER (b.hit1 = 1) AS b_hit
    FROM hits_off a JOIN (SELECT node_id, CAST(first.business = true_best AS INT) AS hit1 FROM truth JOIN (
        SELECT node_id, business FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY business_online_day,
            business) AS rn FROM test) WHERE rn = 1) first USING (node_id)) b USING (node_id) GROUP BY 1""",
                                  "hits_off", "truth", "test"))
def a17(spark, sf):
    return evaluation.hit_crosstab(two_runs(flow_of(spark, sf)))


@query("q_a18_stratified_hits", twin("""
    SELECT CASE WHEN grouping(p) = 1 THEN 'all' WHEN p THEN 'prefix' ELSE 'other' END AS stratum, count(*) AS n,
           round(count(*) * 100.0 / (SELECT count(*) FROM hits_off), 1) AS share_pct,
           round(avg(hit1) * 100, 2) AS hit1_pct, round(avg(hit3) * 100, 2) AS hit3_pct
    FROM (SELECT *, starts_with(node_id, '1') AS p FROM hits_off) GROUP BY ROLLUP (p)""", "hits_off"))
def a18(spark, sf):
    flow = flow_of(spark, sf)
    return evaluation.stratified(evaluation.hits(flow.recs("score_off"), flow.truth), "1")


UNIT_ROWS = twin(f"""
    ,m AS (SELECT t.*, cap_bw, cum_cost_7d / nullif(cap_bw, 0) AS unit_cost
            FROM totals t JOIN {PAIR_BW} USING (node_id, business)),
    a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY cum_cost_7d DESC, business) AS rn
                         FROM m) WHERE rn = 1),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY unit_cost DESC NULLS LAST, business)
                         AS rn FROM m) WHERE rn = 1),
    best AS (SELECT a.node_id, a.business AS abs_best, u.business AS unit_best,
                    CAST(a.business = u.business AS INT) AS same, a.cum_cost_7d AS ca, u.cum_cost_7d AS cu,
                    a.unit_cost AS ua, u.unit_cost AS uu FROM a JOIN u USING (node_id))
    """, "totals")


@query("q_a19_unit_strata", UNIT_ROWS + """
    SELECT stratum, count(*) AS nodes, round(avg(same) * 100, 1) AS same_pct, count(*) FILTER (same = 0) AS different,
           round(median(uu / nullif(ua, 0) - 1) FILTER (same = 0) * 100, 1) AS unit_gain_pct,
           round(median(cu / nullif(ca, 0) - 1) FILTER (same = 0) * 100, 1) AS cost_drop_pct
    FROM (SELECT *, 'all' AS stratum FROM best UNION ALL
          SELECT *, CASE WHEN starts_with(node_id, '1') THEN 'prefix' ELSE 'other' END FROM best) GROUP BY 1""")
def a19(spark, sf):
    rows = reports.unit_yield(flow_of(spark, sf).totals, reports.pair_bandwidth(tables.build_bandwidth(spark, sf)))
    return reports.unit_summary(reports.best_by_cost_and_unit(rows), "1")


@query("q_a20_five_numbers", """
    SELECT 'value' AS field, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std,
           min(value) AS min, round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50,
           round(quantile_cont(value, 0.75), 4) AS p75, max(value) AS max FROM events""")
def a20(spark, sf):
    return rounded(reports.five_numbers(tables.table(spark, sf, "events"), "value"))


@query("q_a21_coverage", f"""
    SELECT field, rows_non_null, rows_total, round(rows_non_null * 1.0 / rows_total, 4) AS coverage FROM (
        SELECT 'acctbal' AS field, count(acctbal) AS rows_non_null, count(*) AS rows_total FROM ({MISSING}) UNION ALL
        SELECT 'nation', count(nation), count(*) FROM ({MISSING}) UNION ALL
        SELECT 'segment', count(segment), count(*) FROM ({MISSING}))""")
def a21(spark, sf):
    return reports.coverage(sparse_attrs(spark, sf), ["acctbal", "nation", "segment"])


@query("q_a22_missing_histogram", f"""
    SELECT n_missing, count(*) AS n_nodes FROM (
        SELECT CAST(acctbal IS NULL AS INT) + CAST(nation IS NULL AS INT) + CAST(segment IS NULL AS INT) AS n_missing
        FROM ({MISSING})) WHERE n_missing > 0 GROUP BY 1""")
def a22(spark, sf):
    return reports.missing_histogram(sparse_attrs(spark, sf), ["acctbal", "nation", "segment"])


@query("q_a23_candidate_profile", twin("""
    ,p AS (SELECT c.node_id, is_test, n_cand, n_neigh_biz
            FROM (SELECT node_id, count(*) AS n_cand FROM cand GROUP BY 1) c JOIN split USING (node_id)
            JOIN (SELECT near.node_id, count(DISTINCT business) AS n_neigh_biz
                  FROM near JOIN train ON train.node_id = neighbour_id GROUP BY 1) USING (node_id))
    SELECT count(*) AS n, round(median(n_cand), 1) AS median_candidates, CAST(0 AS DOUBLE) AS fallback_rate,
           round(avg(n_neigh_biz), 2) AS mean_neigh_biz FROM p WHERE is_test""",
                                       "cand", "near", "train", "split"))
def a23(spark, sf):
    flow = flow_of(spark, sf)
    return candidates.profile_summary(candidates.candidate_profile(
        flow.candidates, flow.profile_near, flow.train, flow.split, flow.profiles[0]))


@query("q_a24_name_map", """
    SELECT p_brand AS business, min(p_name) AS business_name FROM part
    WHERE p_size > 10 GROUP BY 1""")
def a24(spark, sf):
    named = tables.table(spark, sf, "part").select(
        F.col("p_brand").alias("business"), F.when(F.col("p_size") > 10, F.col("p_name")).alias("business_name"))
    return ledger.name_map(named)


@query("q_a25_weighted_mean", """
    SELECT o_custkey AS node, round(coalesce(sum(o_totalprice * w) / nullif(sum(w), 0), avg(o_totalprice)), 4) AS value
    FROM (SELECT *, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000 ELSE 0 END AS w FROM orders) GROUP BY 1""")
def a25(spark, sf):
    w = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") / 1000).otherwise(F.lit(0.0))
    orders = tables.table(spark, sf, "orders").select("o_custkey", "o_totalprice", w.alias("w"))
    weighted = F.try_divide(F.sum(F.col("o_totalprice") * F.col("w")), F.sum("w"))
    return orders.groupBy(F.col("o_custkey").alias("node")).agg(
        F.round(F.coalesce(weighted, F.avg("o_totalprice")), 4).alias("value"))


@query("q_a26_regression_error", twin("""
    SELECT count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
           round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
           round(sum(abs(y - p)) / greatest(sum(abs(y)), 1e-12), 6) AS wape
    FROM (SELECT cum_cost_7d AS y, greatest(pred_cost, 0) AS p FROM predicted WHERE is_test)""", "predicted"))
def a26(spark, sf):
    rows = flow_of(spark, sf).predicted.where("is_test")
    error = evaluation.regression_error(rows, "cum_cost_7d", "pred_cost")
    return error.select("n", F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"),
                        F.round("r2", 6).alias("r2"), F.round("wape", 6).alias("wape"))


@query("q_a27_hit_rates", twin("""
    SELECT count(*) AS n, round(avg(hit1), 4) AS hit_at_1, round(avg(hit3), 4) AS hit_at_3,
           round(avg(CAST(profit1 > 0 AS INT)), 4) AS top1_profit_positive_rate FROM hits_off""", "hits_off"))
def a27(spark, sf):
    flow = flow_of(spark, sf)
    return evaluation.hit_rates(evaluation.hits(flow.recs("score_off"), flow.truth))


@query("q_a28_ab_summary", twin("""
    SELECT count(*) AS n_nodes, round(avg(round(a.cost1, 2)), 2) AS on_cost, round(avg(round(a.profit1, 2)), 2) AS on_profit,
           round(avg(a.hit1), 4) AS on_hit1, round(avg(a.hit3), 4) AS on_hit3,
           round(avg(round(b.cost1, 2)), 2) AS off_cost, round(avg(round(b.profit1, 2)), 2) AS off_profit,
           round(avg(b.hit1), 4) AS off_hit1, round(avg(b.hit3), 4) AS off_hit3,
           count(*) FILTER (a.top1 <> b.top1) AS changed_top1,
           count(*) FILTER (node_id IN (SELECT node_id FROM onoff WHERE bw_aux > 0)) AS aux_nodes
    FROM hits_on a JOIN hits_off b USING (node_id)""", "hits_on", "hits_off"))
def a28(spark, sf):
    flow = flow_of(spark, sf)
    return evaluation.ab_summary(flow.recs("score_on"), flow.recs("score_off"), flow.truth, flow.on_off)


@query("q_a29_variant_deltas", twin("""
    ,e AS (SELECT v AS variant, count(*) AS n, avg(abs(y - p)) AS mae,
                   1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2, sum(abs(y - p)) / sum(abs(y)) AS wape
            FROM (SELECT 'direct' AS v, cum_cost_7d AS y, pred_cost AS p FROM predicted WHERE is_test UNION ALL
                  SELECT 'prior', cum_cost_7d, cost_mean FROM predicted JOIN pool USING (business) WHERE is_test)
            GROUP BY 1)
    SELECT variant, n, round(mae, 4) AS mae, round(r2, 6) AS r2, round(wape, 6) AS wape,
           round((SELECT wape FROM e WHERE variant = 'direct') - wape, 4) AS wape_gain FROM e""",
                                    "predicted", "pool"))
def a29(spark, sf):
    flow = flow_of(spark, sf)
    rows = flow.predicted.where("is_test").select("business", "cum_cost_7d", "pred_cost")
    priors = rows.drop("pred_cost").join(flow.pool.select("business", F.col("cost_mean").alias("pred_cost")), "business")
    both = rows.withColumn("variant", F.lit("direct")).unionByName(priors.withColumn("variant", F.lit("prior")))
    errors = evaluation.regression_error(both, "cum_cost_7d", "pred_cost", ("variant",))
    return evaluation.error_deltas(errors).select(
        "variant", "n", F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"), F.round("wape", 6).alias("wape"),
        "wape_gain")


@query("q_a30_amplification", twin("""
    SELECT coalesce(r.business, t.business) AS business, round(coalesce(rec_pct, 0), 1) AS rec_pct,
           round(coalesce(true_pct, 0), 1) AS true_pct,
           round(coalesce(rec_pct, 0) / nullif(coalesce(true_pct, 0), 0), 2) AS ratio
    FROM (SELECT top1 AS business, count(*) * 100.0 / sum(count(*)) OVER () AS rec_pct FROM hits_off GROUP BY 1) r
    FULL JOIN (SELECT true_best AS business, count(*) * 100.0 / sum(count(*)) OVER () AS true_pct
               FROM hits_off GROUP BY 1) t ON r.business = t.business""", "hits_off"))
def a30(spark, sf):
    flow = flow_of(spark, sf)
    hit = evaluation.hits(flow.recs("score_off"), flow.truth)
    return evaluation.amplification(hit.select(F.col("top1").alias("business")), hit)


@query("q_a31_unique_nodes", """
    SELECT CAST(o_custkey AS VARCHAR) AS node_id, o_orderdate_text AS day, o_totalprice AS amount, o_orderstatus AS state
    FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate_text, row_number() OVER (
              PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def a31(spark, sf):
    rows = tables.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("node_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        "o_orderkey", F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("state"))
    return ledger.unique_nodes(rows, ["day", "o_orderkey"]).drop("o_orderkey")


@query("q_a32_business_capacity", twin("""
    SELECT business, days, sample_nodes, round(traffic_p75_mbps, 4) AS traffic_p75_mbps,
           round(capacity_upper_mbps, 4) AS capacity_upper_mbps, util_at_capacity,
           round(current_daily_peak95_sum_mbps, 4) AS current_daily_peak95_sum_mbps,
           round(can_add_mbps, 4) AS can_add_mbps, round(over_capacity_mbps, 4) AS over_capacity_mbps
    FROM capacity""", "capacity"))
def a32(spark, sf):
    return rounded(reports.business_capacity(flow_of(spark, sf).daily_peaks))


@query("q_a33_ledger_rollup", twin("""
    SELECT node_id, business, strftime(online_day, '%Y-%m-%d') AS online_day, CAST(business_count AS INT)
           AS business_count FROM totals""", "totals"))
def a33(spark, sf):
    return ledger.ledger_rollup(tables.ledger_totals(spark, sf)).select(
        "node_id", "business", F.date_format("online_day", "yyyy-MM-dd").alias("online_day"), "business_count")


@query("q_a34_coverage_counts", twin("""
    SELECT count(*) AS n_rows, count(DISTINCT node_id) AS n_nodes,
           count(DISTINCT CASE WHEN starts_with(node_id, '1') THEN node_id END) AS n_prefix_nodes FROM daily""", "daily"))
def a34(spark, sf):
    return reports.prefix_counts(tables.daily_settlement(spark, sf), "1")


@query("q_a34_distinct_by_day_bitmaps", twin("""
    SELECT business, count(DISTINCT node_id) AS n_nodes,
           count(DISTINCT CASE WHEN day < DATE '2026-01-01' OR day(day) <= 15 THEN node_id END) AS n_some_days
    FROM daily GROUP BY 1""", "daily"))
def a34_bitmaps(spark, sf):
    """Distinct nodes per business over all days and over some, from bitmaps that are stored by day and merged."""
    daily = cut_lineage(tables.daily_settlement(spark, sf).select("node_id", "business", "day"), "daily")
    path = stage_path(spark, "day-bitmaps")
    daybits.day_bitmaps(daily, daybits.numbered_ids(daily), ["business"]).write.partitionBy("day").parquet(path)
    stored = spark.read.parquet(path)
    some = (F.col("day") < F.lit("2026-01-01").cast("date")) | (F.dayofmonth("day") <= 15)
    every = daybits.merged_counts(stored, ["business"], name="n_nodes")
    part = daybits.merged_counts(stored, ["business"], some, "n_some_days")
    return every.join(part, "business", "left").select("business", "n_nodes", F.coalesce("n_some_days", F.lit(0)).alias("n_some_days"))


@query("q_a18_grouping_sets", twin("""
    ,h AS (SELECT CASE WHEN starts_with(node_id, '1') THEN 'prefix' ELSE 'other' END AS side, true_best, hit1, hit3 FROM hits_off),
    sides AS (SELECT unnest(['prefix', 'other', 'none', 'all']) AS side), bests AS (SELECT DISTINCT true_best FROM h UNION ALL SELECT 'all')
    SELECT s.side, b.true_best, count(h.side) AS n, round(avg(hit1) * 100, 2) AS hit1_pct, round(avg(hit3) * 100, 2) AS hit3_pct
    FROM sides s CROSS JOIN bests b LEFT JOIN h ON (s.side = 'all' OR h.side = s.side) AND (b.true_best = 'all' OR h.true_best = b.true_best)
    GROUP BY 1, 2""", "hits_off"))
def a18_sets(spark, sf):
    """Hit rates by side and true best and all their totals, one aggregate; strata without a row are kept."""
    flow = flow_of(spark, sf)
    rows = evaluation.hits(flow.recs("score_off"), flow.truth).withColumn(
        "side", F.when(F.col("node_id").startswith("1"), "prefix").otherwise("other"))
    rates = [F.round(F.avg(c) * 100, 2).alias(f"{c}_pct") for c in ("hit1", "hit3")]
    return evaluation.strata(rows, ["side", "true_best"], rates, {"side": ["prefix", "other", "none"]})
