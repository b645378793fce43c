"""P01-P28 projections and cleaning, F01-F14 filters."""

from pyspark.sql import functions as F

from settlerank.functions import (any_of, business_id, capacity_penalty, clipped, display_label,
                                  has_prefix, known, log1p_floored, mapped, mbps, missing_count, missing_fields, piped,
                                  positive_flag, positive_or_null, profit_of, ratio_or_null, rounded_money,
                                  rounded_rate, segment_key, share_flag, streak_label, to_day, to_number, unpiped,
                                  utilisation_aux, zero_filled)
from settlerank.functions.sql_functions import register_functions
from settlerank.operators import evaluation, ledger, ranking, reports, scoring, split, stats
from settlerank.plans.flow import flow_of
from settlerank.plans.registry import query
from settlerank.plans.twins import twin
from settlerank.sources import tables

FAMILIES = [("Brand#1", "FAM1"), ("Brand#2", "FAM2")]


# -- projections and cleaning ------------------------------------------------------------------------------

@query("q_p01_business_id", """
    SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS business,
           CAST(p_partkey AS VARCHAR) || '.0.5' AS inner_kept FROM part""")
def p01(spark, sf):
    key = F.col("p_partkey").cast("string")
    return tables.table(spark, sf, "part").select("p_partkey", business_id(F.concat(key, F.lit(".0"))).alias("business"),
                                                  business_id(F.concat(key, F.lit(".0.5"))).alias("inner_kept"))


@query("q_p02_lenient_number", """
    SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS amount FROM part""")
def p02(spark, sf):
    text = F.when(F.col("p_size") % 3 == 0, F.format_string(" %s ", F.col("p_retailprice").cast("string"))).when(
        F.col("p_size") % 3 == 1, F.lit("NaN")).otherwise(F.col("p_brand"))
    return tables.table(spark, sf, "part").select("p_partkey", to_number(text).alias("amount"))


@query("q_p03_lenient_date", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def p03(spark, sf):
    text = F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).when(
        F.col("o_orderstatus") == "O", F.lit("")).otherwise(F.col("o_orderpriority"))
    return tables.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(to_day(text), "yyyy-MM-dd").alias("day"))


@query("q_p04_profit", """
    SELECT event_id, round(value - CASE WHEN event_type <> 'error'
                                        THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END, 4) AS profit
    FROM events""")
def p04(spark, sf):
    cost = F.when(F.col("event_type") != "error", F.get_json_object("props", "$.k").try_cast("double"))
    return tables.table(spark, sf, "events").select("event_id", F.round(profit_of("value", cost), 4).alias("profit"))


@query("q_p05_unknown_category", """
    SELECT coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, '__UNK__') AS category, count(*) AS n
    FROM customer GROUP BY 1""")
def p05(spark, sf):
    value = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    return tables.table(spark, sf, "customer").groupBy(known(value).alias("category")).agg(F.count("*").alias("n"))


@query("q_p06_zero_filled", """
    SELECT c_custkey, coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END, 0) AS feature FROM customer""")
def p06(spark, sf):
    value = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).otherwise(F.lit(float("nan")))
    return tables.table(spark, sf, "customer").select("c_custkey", zero_filled(value).alias("feature"))


@query("q_p07_positive_or_missing", """
    SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS attribute FROM customer""")
def p07(spark, sf):
    return tables.table(spark, sf, "customer").select("c_custkey", positive_or_null("c_acctbal").alias("attribute"))


@query("q_p08_mbps", "SELECT event_id, round(value * 1e6 / 1e6, 4) AS peak_mbps FROM events")
def p08(spark, sf):
    return tables.table(spark, sf, "events").select(
        "event_id", F.round(mbps(F.col("value") * F.lit(1e6)), 4).alias("peak_mbps"))


@query("q_p09_prefix_flag", twin("""
    SELECT node_id, CAST(starts_with(node_id, '1') AS INT) AS is_prefix FROM attrs""", "attrs"))
def p09(spark, sf):
    return tables.node_keys(spark, sf).select("node_id", share_flag(has_prefix("node_id", "1")).alias("is_prefix"))


@query("q_p10_family_token", twin("""
    SELECT business, count(*) AS n_pairs FROM fams GROUP BY 1""", "fams"))
def p10(spark, sf):
    totals = tables.ledger_totals(spark, sf)
    return ledger.to_families(totals, rules=FAMILIES).groupBy("business").agg(F.count("*").alias("n_pairs"))


@query("q_p11_code_map", """
    SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'FAM1' WHEN 'Brand#2' THEN 'FAM2' ELSE p_brand END AS family,
           CASE p_brand WHEN 'Brand#1' THEN 'Brand#10' WHEN 'Brand#2' THEN 'Brand#20' ELSE p_brand END AS shown
    FROM part""")
def p11(spark, sf):
    fam = mapped("p_brand", {"Brand#1": "FAM1", "Brand#2": "FAM2"})
    return tables.table(spark, sf, "part").select("p_partkey", fam.alias("family"), mapped(
        fam, {"FAM1": "Brand#10", "FAM2": "Brand#20"}).alias("shown"))


@query("q_p12_segment_key", twin("SELECT seg, count(*) AS n FROM segs GROUP BY 1", "segs"))
def p12(spark, sf):
    attrs = tables.node_attributes(spark, sf)
    return attrs.groupBy(segment_key(*tables.SEGMENT).alias("seg")).agg(F.count("*").alias("n"))


@query("q_p13_log_transforms", """
    SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS log_amount,
           round(exp(ln(1 + greatest(c_acctbal, 0))) - 1, 4) AS back FROM customer""")
def p13(spark, sf):
    return tables.table(spark, sf, "customer").select(
        "c_custkey", F.round(log1p_floored("c_acctbal"), 6).alias("log_amount"),
        F.round(F.expm1(log1p_floored("c_acctbal")), 4).alias("back"))


@query("q_p14_clip", """
    SELECT c_custkey, greatest(c_acctbal, 0) AS floored, least(greatest(round(c_acctbal / 3000, 6), 0), 2) AS banded
    FROM customer""")
def p14(spark, sf):
    return tables.table(spark, sf, "customer").select(
        "c_custkey", clipped("c_acctbal").alias("floored"),
        clipped(F.round(F.col("c_acctbal") / F.lit(3000.0), 6), 0, 2).alias("banded"))


@query("q_p15_capacity_penalty", twin("""
    SELECT business, round(CASE WHEN capacity_upper_mbps > 0 THEN least(1.0, over_capacity_mbps / capacity_upper_mbps)
                                ELSE 0 END, 6) AS penalty,
           round(CASE WHEN capacity_upper_mbps > 0 THEN
                 CASE WHEN over_capacity_mbps > 0 THEN least(1.0, over_capacity_mbps / capacity_upper_mbps) ELSE 1 END
                 ELSE 0 END, 6) AS strict_penalty
    FROM capacity""", "capacity"))
def p15(spark, sf):
    over = F.when(F.col("over_capacity_mbps") > 0, F.col("over_capacity_mbps"))
    return flow_of(spark, sf).capacity.select(
        "business", F.round(capacity_penalty("over_capacity_mbps", "capacity_upper_mbps"), 6).alias("penalty"),
        F.round(capacity_penalty(over, "capacity_upper_mbps", missing_over=1.0), 6).alias("strict_penalty"))


@query("q_p16_utilisation_aux", twin("""
    SELECT node_id, business, round(least(greatest(coalesce(
               CASE WHEN n_orders > 8 THEN peak_mbps / (n_orders - 8) END, 0), 0), 2), 6) AS bw_aux
    FROM peaks LEFT JOIN attrs USING (node_id)""", "peaks", "attrs"))
def p16(spark, sf):
    flow = flow_of(spark, sf)
    peaks = scoring.peak_per_pair(flow.daily_peaks)
    return peaks.join(flow.nominal, "node_id", "left").select(
        "node_id", "business", F.round(utilisation_aux("peak_mbps", F.col("nominal_bw") - 8), 6).alias("bw_aux"))


@query("q_p17_ratio_without_inf", """
    SELECT p_partkey, round(p_retailprice / nullif(p_size % 4, 0), 6) AS ratio FROM part""")
def p17(spark, sf):
    return tables.table(spark, sf, "part").select(
        "p_partkey", F.round(ratio_or_null("p_retailprice", (F.col("p_size") % 4).cast("double")), 6).alias("ratio"))


@query("q_p18_rounding", """
    SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / 7, 2) AS money,
           round(l_extendedprice / 70001, 4) AS rate FROM lineitem""")
def p18(spark, sf):
    price = F.col("l_extendedprice")
    return tables.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded_money(price / F.lit(7.0)).alias("money"),
        rounded_rate(price / F.lit(70001.0)).alias("rate"))


MISSING = """
    SELECT CAST(c_custkey AS VARCHAR) AS node_id, CASE WHEN c_acctbal > 500 THEN c_acctbal END AS acctbal,
           CASE WHEN c_nationkey < 20 THEN c_nationkey END AS nation,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment FROM customer"""


def sparse_attrs(spark, sf):
    """Attributes with holes, as the coverage operators need them."""
    c = tables.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("node_id"),
                    F.when(F.col("c_acctbal") > 500, F.col("c_acctbal")).alias("acctbal"),
                    F.when(F.col("c_nationkey") < 20, F.col("c_nationkey")).alias("nation"),
                    F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"))


@query("q_p19_missing_fields", f"""
    SELECT node_id, concat_ws('|', CASE WHEN acctbal IS NULL THEN 'acctbal' END,
                              CASE WHEN nation IS NULL THEN 'nation' END,
                              CASE WHEN segment IS NULL THEN 'segment' END) AS missing_fields FROM ({MISSING})""")
def p19(spark, sf):
    return sparse_attrs(spark, sf).select("node_id", missing_fields(["acctbal", "nation", "segment"]).alias(
        "missing_fields"))


@query("q_p20_missing_count", f"""
    SELECT node_id, CAST(acctbal IS NULL AS INT) + CAST(nation IS NULL AS INT) + CAST(segment IS NULL AS INT)
           AS n_missing, CAST(acctbal IS NULL OR nation IS NULL OR segment IS NULL AS INT) AS any_missing
    FROM ({MISSING})""")
def p20(spark, sf):
    n = missing_count(["acctbal", "nation", "segment"])
    return sparse_attrs(spark, sf).select("node_id", n.alias("n_missing"), (n > 0).cast("int").alias("any_missing"))


@query("q_p21_display_labels", """
    SELECT p_partkey, CASE WHEN length(label) > 12 THEN substr(label, 1, 12) || '…' ELSE label END AS label,
           CASE WHEN p_size % 10 >= 7 THEN '近7天' WHEN p_size % 10 > 0 THEN '近' || (p_size % 10) || '天' END AS streak
    FROM (SELECT p_partkey, p_size, trim(p_name || ' ' || p_brand) AS label FROM part)""")
def p21(spark, sf):
    return tables.table(spark, sf, "part").select(
        "p_partkey", display_label("p_name", "p_brand", 12).alias("label"),
        streak_label(F.col("p_size") % 10).alias("streak"))


@query("q_p22_positive_flag", twin("""
    SELECT node_id, business, CAST(cum_profit_7d > 0 AS INT) AS profit_positive FROM totals""", "totals"))
def p22(spark, sf):
    return tables.ledger_totals(spark, sf).select("node_id", "business",
                                                  positive_flag("cum_profit_7d").alias("profit_positive"))


@query("q_p23_predicted_minus_actual", twin("""
    SELECT node_id, business, round(pred_cost - cum_cost_7d, 4) AS diff_cost,
           round(pred_profit - cum_profit_7d, 4) AS diff_profit FROM predicted""", "predicted"))
def p23(spark, sf):
    return flow_of(spark, sf).predicted.select(
        "node_id", "business", F.round(F.col("pred_cost") - F.col("cum_cost_7d"), 4).alias("diff_cost"),
        F.round(F.col("pred_profit") - F.col("cum_profit_7d"), 4).alias("diff_profit"))


@query("q_p24_truth_in_top3", twin("SELECT node_id, hit1, hit3 FROM hits_off", "hits_off"))
def p24(spark, sf):
    flow = flow_of(spark, sf)
    wide = ranking.widen(flow.recs("score_off")).join(flow.truth, "node_id")
    return wide.select("node_id", any_of("true_best", "top1_business").cast("int").alias("hit1"),
                       any_of("true_best", "top1_business", "top2_business", "top3_business").cast("int").alias("hit3"))


@query("q_p25_unit_yield", twin("""
    SELECT node_id, business, round(cum_cost_7d / nullif(cap_bw, 0), 4) AS unit_cost
    FROM totals JOIN (SELECT CAST(o_custkey AS VARCHAR) AS node_id, max(l_quantity) - 45 AS cap_bw
                      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) USING (node_id)""", "totals"))
def p25(spark, sf):
    orders = tables.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    widest = (tables.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
              .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
              .groupBy(F.col("o_custkey").cast("string").alias("bw_node"))
              .agg((F.max("l_quantity") - 45).alias("cap_bw")))
    return reports.unit_yield(tables.ledger_totals(spark, sf), widest).select(
        "node_id", "business", F.round("unit_cost", 4).alias("unit_cost"))


@query("q_p26_piped_lists", twin("""
    SELECT node_id, string_agg(business, '|' ORDER BY business) AS cand, count(*) AS n_cand,
           CAST(bool_or(business = 'Brand#7') AS INT) AS has_brand FROM totals GROUP BY 1""", "totals"))
def p26(spark, sf):
    lists = tables.ledger_totals(spark, sf).groupBy("node_id").agg(
        piped(F.array_sort(F.collect_set("business"))).alias("cand"))
    parts = unpiped("cand")
    return lists.select("node_id", "cand", F.size(parts).cast("long").alias("n_cand"),
                        F.array_contains(parts, "Brand#7").cast("int").alias("has_brand"))


@query("q_p27_rename_select", """
    SELECT CAST(o_custkey AS VARCHAR) AS node_id, o_orderstatus AS state, o_totalprice AS amount FROM orders""")
def p27(spark, sf):
    renamed = tables.table(spark, sf, "orders").withColumnsRenamed(
        {"o_custkey": "node_id", "o_orderstatus": "state", "o_totalprice": "amount"})
    return renamed.withColumn("node_id", F.col("node_id").cast("string")).select("node_id", "state", "amount")


@query("q_p28_recomputed_profit", twin("""
    SELECT node_id, business, round(sum(cum_revenue_7d) - sum(cum_cost_7d), 4) AS cum_profit_7d
    FROM fams GROUP BY 1, 2""", "fams"))
def p28(spark, sf):
    merged = ledger.merge_families(tables.ledger_totals(spark, sf), rules=FAMILIES)
    return merged.select("node_id", "business", F.round("cum_profit_7d", 4).alias("cum_profit_7d"))


# -- filters -------------------------------------------------------------------------------------------------

@query("q_f01_complete_windows", twin("""
    SELECT node_id, business, outcome_days, round(cum_cost_7d, 2) AS cum_cost_7d FROM led7 WHERE outcome_days >= 3""",
                                      "led7"))
def f01(spark, sf):
    led = ledger.first_window_ledger(tables.daily_settlement(spark, sf))
    odd = led.withColumn("outcome_days", F.col("outcome_days").cast("double"))
    return ledger.complete_windows(odd, 3).select("node_id", "business", F.col("outcome_days").cast("int").alias(
        "outcome_days"), F.round("cum_cost_7d", 2).alias("cum_cost_7d"))


@query("q_f02_support_pool", twin("SELECT business, support FROM stats WHERE support >= 920", "stats"))
def f02(spark, sf):
    return stats.support_pool(flow_of(spark, sf).stats, 920).select("business", "support")


@query("q_f03_pool_side", twin("""
    SELECT business, count(*) FILTER (starts_with(node_id, '1')) AS inside,
           count(*) FILTER (NOT starts_with(node_id, '1')) AS outside FROM totals GROUP BY 1""", "totals"))
def f03(spark, sf):
    totals = tables.ledger_totals(spark, sf)
    side = [ledger.pick_pool_side(totals, s, "1").groupBy("business").agg(F.count("*").alias(n))
            for s, n in (("1", "inside"), ("non1", "outside"))]
    return side[0].join(side[1], "business", "full_outer").select(
        "business", F.coalesce("inside", F.lit(0)).alias("inside"), F.coalesce("outside", F.lit(0)).alias("outside"))


@query("q_f04_gate", twin("""
    SELECT node_id, business FROM totals WHERE business NOT IN (
        SELECT business FROM totals GROUP BY 1 HAVING avg(CAST(starts_with(node_id, '1') AS INT)) >= 0.4)""", "totals"))
def f04(spark, sf):
    totals = tables.ledger_totals(spark, sf)
    gated = ledger.gated_businesses(totals, 0.4, "1")
    return ledger.drop_gated(totals, gated).select("node_id", "business")


@query("q_f05_membership", twin("SELECT is_test::INT AS is_test, count(*) AS n_pairs FROM sided GROUP BY 1", "sided"))
def f05(spark, sf):
    flow = flow_of(spark, sf)
    test_ids = flow.split.where("is_test").select("node_id")
    inside = flow.frame.join(test_ids, "node_id", "left_semi").withColumn("is_test", F.lit(1))
    outside = flow.frame.join(test_ids, "node_id", "left_anti").withColumn("is_test", F.lit(0))
    return inside.unionByName(outside).groupBy("is_test").agg(F.count("*").alias("n_pairs"))


@query("q_f06_drop_missing_keys", f"""
    SELECT segment, count(*) AS n FROM ({MISSING}) WHERE acctbal IS NOT NULL AND segment IS NOT NULL GROUP BY 1""")
def f06(spark, sf):
    return sparse_attrs(spark, sf).dropna(subset=["acctbal", "segment"]).groupBy("segment").agg(
        F.count("*").alias("n"))


@query("q_f07_inside_pool", twin("""
    SELECT node_id, business FROM totals WHERE business IN (SELECT business FROM stats WHERE support >= 920)""",
                                 "totals", "stats"))
def f07(spark, sf):
    flow = flow_of(spark, sf)
    return ranking.restrict_to_pool(flow.totals, stats.support_pool(flow.stats, 920)).select("node_id", "business")


@query("q_f08_gate_with_fallback", twin("""
    SELECT node_id, business FROM (
        SELECT *, max(e) OVER (PARTITION BY node_id) AS any_e FROM (
            SELECT *, CAST(pred_profit > 0 AND profit_p10 + 1500 > 0 AS INT) AS e FROM predicted))
    WHERE e = 1 OR any_e = 0""", "predicted"))
def f08(spark, sf):
    pairs = flow_of(spark, sf).predicted.withColumn("profit_p10", F.col("profit_p10") + 1500)
    scored = scoring.score_full_pool(pairs)
    return scored.where((F.col("eligible") == 1) | (F.col("any_eligible") == 0)).select("node_id", "business")


@query("q_f09_compound_counts", twin("""
    SELECT count(*) AS n, count(*) FILTER (cum_profit_7d < 0) AS losing,
           count(*) FILTER (cum_profit_7d < 0 AND pred_profit > 0) AS turns_positive FROM predicted""", "predicted"))
def f09(spark, sf):
    losing = F.col("cum_profit_7d") < 0
    return flow_of(spark, sf).predicted.agg(F.count("*").alias("n"), F.count_if(losing).alias("losing"),
                                              F.count_if(losing & (F.col("pred_profit") > 0)).alias("turns_positive"))


@query("q_f10_threshold_counts", """
    SELECT count(value) AS n, count(*) FILTER (value < 5) AS below_5, count(*) FILTER (value < 20) AS below_20
    FROM events""")
def f10(spark, sf):
    return reports.below_counts(tables.table(spark, sf, "events"), "value", [5, 20])


@query("q_f11_many_business_nodes", twin("""
    SELECT node_id, count(DISTINCT business) AS n_businesses FROM totals
    WHERE node_id IN (SELECT node_id FROM attrs) GROUP BY 1 HAVING count(DISTINCT business) >= 20""", "totals", "attrs"))
def f11(spark, sf):
    rich = tables.ledger_totals(spark, sf).groupBy("node_id").agg(
        F.count_distinct("business").alias("n_businesses")).where("n_businesses >= 20")
    return rich.join(tables.node_keys(spark, sf), "node_id", "left_semi")


@query("q_f12_disagreements", twin("""
    SELECT CASE WHEN a.hit1 = 1 THEN 'only_a' ELSE 'only_b' END AS side, count(*) AS n,
           count(*) FILTER (starts_with(a.node_id, '1')) AS n_prefix
    FROM hits_off a JOIN (SELECT node_id, CAST(first.business = true_best AS INT) AS hit1 FROM truth JOIN (
        SELECT node_id, business FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY business_online_day,
            business) AS rn FROM test) WHERE rn = 1) first USING (node_id)) b USING (node_id)
    WHERE a.hit1 <> b.hit1 GROUP BY 1""", "hits_off", "test", "truth"))
def f12(spark, sf):
    flow = flow_of(spark, sf)
    return evaluation.disagreements(two_runs(flow), "1")


def first_started(flow):
    """A second run to compare with: the business a test node started first."""
    recs = ranking.top_k(flow.test, "node_id", [F.asc("business_online_day"), F.asc("business")], 1)
    return recs.select("node_id", "rank", "business")


def two_runs(flow):
    a = evaluation.hits(flow.recs("score_off"), flow.truth)
    return evaluation.compare_runs(a, evaluation.hits(first_started(flow), flow.truth))


@query("q_f13_time_cut", twin("""
    SELECT node_id, CAST(intro_day >= DATE '1995-06-01' AS INT) AS is_test FROM nodes WHERE intro_day IS NOT NULL""",
                              "nodes"))
def f13(spark, sf):
    nodes = split.first_days(flow_of(spark, sf).frame)
    return split.temporal_split(nodes, cut_day="1995-06-01").select("node_id", share_flag(F.col("is_test")).alias(
        "is_test"))


@query("q_f14_truth_in_pool", twin("""
    SELECT node_id, true_best FROM truth WHERE true_best IN (SELECT business FROM stats WHERE support >= 920)""",
                                   "truth", "stats"))
def f14(spark, sf):
    flow = flow_of(spark, sf)
    return ranking.restrict_to_pool(flow.truth, stats.support_pool(flow.stats, 920), "true_best").select(
        "node_id", "true_best")


@query("q_p_sql_functions", """
    SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS business, CASE WHEN p_size % 3 = 0 THEN p_retailprice END AS amount,
           CASE p_brand WHEN 'Brand#1' THEN 'FAM1' WHEN 'Brand#2' THEN 'FAM2' ELSE CAST(p_partkey AS VARCHAR) END AS family,
           CASE WHEN p_size % 4 = 0 THEN '__UNK__' ELSE p_brand END || '|' || p_type || '|__UNK__' AS segment,
           CASE WHEN p_size % 10 >= 7 THEN '近7天' WHEN p_size % 10 > 0 THEN '近' || (p_size % 10) || '天' END AS streak,
           CASE WHEN length(trim(p_name || ' ' || p_brand)) > 12 THEN substr(trim(p_name || ' ' || p_brand), 1, 12) || '…'
                ELSE trim(p_name || ' ' || p_brand) END AS label,
           round(CASE WHEN p_size - 3 > 0 THEN least(1.0, p_retailprice / 777 / (p_size - 3)) ELSE 0 END, 6) AS penalty FROM part""")
def p_sql_functions(spark, sf):
    """The rules called from SQL text; their bodies are inlined in the plan."""
    register_functions(spark, (("#1 ", "FAM1"), ("#2 ", "FAM2")))
    return spark.sql("""
        SELECT p_partkey, settle_business_id(concat(p_partkey, '.0')) AS business,
               settle_number(CASE p_size % 3 WHEN 0 THEN concat(' ', p_retailprice, ' ') WHEN 1 THEN 'n/a' ELSE 'NaN' END) AS amount,
               settle_family(CAST(p_partkey AS STRING), concat(p_brand, ' ')) AS family,
               settle_segment(CASE WHEN p_size % 4 <> 0 THEN p_brand END, p_type, NULL) AS segment,
               settle_streak_label(CAST(p_size % 10 AS INT)) AS streak, settle_label(p_name, p_brand, 12) AS label,
               round(settle_capacity_penalty(CAST(p_retailprice AS DOUBLE) / 777, CAST(p_size - 3 AS DOUBLE)), 6) AS penalty
        FROM {part}""", part=tables.table(spark, sf, "part"))
