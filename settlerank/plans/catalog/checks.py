"""Q01-Q06 readiness and acceptance checks, and the review tables behind the report pages."""

from pyspark.sql import functions as F

from settlerank.functions import share_flag
from settlerank.operators import candidates, checks, evaluation, ranking, reports, streaks
from settlerank.plans.catalog.aggregates import rounded
from settlerank.plans.catalog.columns import MISSING, sparse_attrs
from settlerank.plans.flow import flow_of
from settlerank.plans.registry import query
from settlerank.plans.twins import twin
from settlerank.session import stage_path
from settlerank.sources import files, metrics, tables


@query("q_q01_required_columns", twin("""
    SELECT 'node_id' AS "column", 1 AS present, count(node_id) AS filled FROM attrs UNION ALL
    SELECT 'segment', 1, count(segment) FROM attrs UNION ALL SELECT 'acctbal', 1, count(acctbal) FROM attrs UNION ALL
    SELECT 'bw', 0, 0""", "attrs"))
def q01(spark, sf):
    return checks.required_columns(tables.node_attributes(spark, sf), ["node_id", "segment", "acctbal", "bw"])


@query("q_q02_row_floors", twin("""
    SELECT 'ledger' AS part, count(*) AS n_rows, count(*) FILTER (outcome_days >= 2) AS counted,
           CAST(count(*) FILTER (outcome_days >= 2) >= 100 AS INT) AS ok FROM totals UNION ALL
    SELECT 'attrs', count(*), count(*) FILTER (starts_with(node_id, '1')), CAST(count(*) >= 100 AS INT) FROM attrs""",
                                "totals", "attrs"))
def q02(spark, sf):
    flow = flow_of(spark, sf)
    left = checks.ledger_readiness(flow.totals, 100, 2).select(
        F.lit("ledger").alias("part"), "n_rows", F.col("full_rows").alias("counted"), "ok")
    right = checks.attrs_readiness(tables.node_keys(spark, sf), 100, "1").select(
        F.lit("attrs").alias("part"), "n_rows", F.col("prefix_rows").alias("counted"), "ok")
    return left.unionByName(right)


RANGES = [("hit_at_1", 0.0, 0.5), ("hit_at_3", 0.9, 1.0), ("n", 1.0, 1e12), ("wape", 0.0, 0.46)]


@query("q_q03_metric_ranges", twin("""
    ,m AS (SELECT avg(hit1) AS h1, avg(hit3) AS h3, count(*) AS n FROM hits_off)
    SELECT 'hit_at_1' AS "check", 0.0::DOUBLE AS low, 0.5::DOUBLE AS high, round((SELECT h1 FROM m), 4) AS actual,
           CAST((SELECT h1 FROM m) BETWEEN 0 AND 0.5 AS INT) AS ok UNION ALL
    SELECT 'hit_at_3', 0.9, 1.0, round((SELECT h3 FROM m), 4), CAST((SELECT h3 FROM m) BETWEEN 0.9 AND 1 AS INT) UNION ALL
    SELECT 'n', 1, 1e12, (SELECT n FROM m), CAST((SELECT n FROM m) BETWEEN 1 AND 1e12 AS INT) UNION ALL
    SELECT 'wape', 0, 0.46, NULL, 0""", "hits_off"))
def q03(spark, sf):
    flow = flow_of(spark, sf)
    rates = evaluation.hit_rates(evaluation.hits(flow.recs("score_off"), flow.truth))
    return checks.in_range(checks.metric_rows(rates, ["hit_at_1", "hit_at_3", "n"]), RANGES)


@query("q_q04_table_shape", twin("""
    SELECT 1 AS missing_columns, count(*) AS n_rows, round(avg(CAST(top3 IS NULL AS INT)), 6) AS null_rate, 0 AS ok
    FROM wide_off""", "wide_off"))
def q04(spark, sf):
    wide = ranking.widen(flow_of(spark, sf).recs("score_off"))
    return rounded(checks.table_shape(wide, ["node_id", "top1_business", "top1_label"], "top3_business"), 6)


@query("q_q05_structure", twin("""
    ,v AS (SELECT (SELECT count(*) FROM split WHERE NOT is_test) AS a, (SELECT count(*) FROM split WHERE is_test) AS b,
                  (SELECT count(*) FROM wide_off) AS c, (SELECT count(DISTINCT top1) FROM wide_off) AS d,
                  (SELECT sum(abs(cum_cost_7d - pred_cost)) / sum(abs(cum_cost_7d)) FROM predicted WHERE is_test) AS w)
    SELECT 'train_nodes' AS "check", CAST(a AS DOUBLE) AS actual, CAST(a > 0 AS INT) AS ok FROM v UNION ALL
    SELECT 'test_nodes', b, CAST(b > 0 AS INT) FROM v UNION ALL
    SELECT 'nodes_with_rec', c, CAST(c > 0 AS INT) FROM v UNION ALL
    SELECT 'top1_kinds', d, CAST(d >= 5 AS INT) FROM v UNION ALL
    SELECT 'wape', round(w, 6), CAST(w >= 0 AND w < 10 AS INT) FROM v UNION ALL
    SELECT 'filled_rate', 1, 1""", "split", "wide_off", "predicted"))
def q05(spark, sf):
    flow = flow_of(spark, sf)
    first = flow.recs("score_off").where("rank = 1")
    kinds = first.groupBy("business").agg(F.count("*").alias("n"))
    own = candidates.with_fallback(flow.split, candidates.run_history(flow.frame),
                                   candidates.fallback_businesses(flow.pool))
    empty = own.groupBy("node_id").agg(F.max("is_fallback").alias("fb"))
    error = evaluation.regression_error(flow.predicted.where("is_test"), "cum_cost_7d", "pred_cost")
    metrics = flow.split.agg(F.count_if(~F.col("is_test")).alias("train_nodes"),
                             F.count_if(F.col("is_test")).alias("test_nodes")).select(
        "*", kinds.agg(F.sum("n")).scalar().alias("nodes_with_rec"),
        kinds.agg(F.count("*")).scalar().alias("top1_kinds"), error.select("wape").scalar().alias("wape"),
        empty.agg(1 - F.avg("fb")).scalar().alias("filled_rate"))
    return rounded(checks.structure(metrics), 6)


@query("q_q06_attribute_coverage", f"""
    SELECT node_id, CAST(acctbal IS NULL AS INT) + CAST(nation IS NULL AS INT) + CAST(segment IS NULL AS INT)
           AS n_missing, concat_ws('|', CASE WHEN acctbal IS NULL THEN 'acctbal' END,
           CASE WHEN nation IS NULL THEN 'nation' END, CASE WHEN segment IS NULL THEN 'segment' END) AS missing_fields
    FROM ({MISSING}) WHERE acctbal IS NULL OR nation IS NULL OR segment IS NULL""")
def q06(spark, sf):
    return reports.incomplete_rows(sparse_attrs(spark, sf), ["acctbal", "nation", "segment"])


@query("q_q06_key_overlap", twin("""
    SELECT count(*) AS target_nodes, count(*) FILTER (node_id IN (SELECT node_id FROM daily)) AS in_attrs,
           count(*) FILTER (node_id NOT IN (SELECT node_id FROM daily)) AS not_in_attrs
    FROM (SELECT DISTINCT node_id FROM totals)""", "totals", "daily"))
def q06_overlap(spark, sf):
    return reports.key_overlap(flow_of(spark, sf).totals, tables.daily_settlement(spark, sf))


# -- review tables behind the report pages -------------------------------------------------------------------

def review(flow):
    """Wide recommendations beside each node's current run on the daily settlement."""
    now = streaks.current_seven_days(tables.daily_settlement(flow.spark, flow.sf_dir), unnamed="error")
    return reports.review_table(ranking.widen(flow.recs("score_off")), now, flow.names)


NOW = """
    ,valid AS (SELECT * FROM daily WHERE (cost <> 0 OR revenue <> 0) AND day > (SELECT max(day) FROM daily) - 30),
    isl AS (SELECT node_id, day, day - CAST(row_number() OVER (PARTITION BY node_id ORDER BY day) AS INT) AS island
            FROM (SELECT DISTINCT node_id, day FROM valid)),
    ends AS (SELECT node_id, max(e) AS cur_end FROM (
        SELECT node_id, max(day) AS e FROM isl GROUP BY node_id, island HAVING count(*) >= 7) GROUP BY 1),
    sums AS (SELECT node_id, business, sum(cost) AS cost, sum(revenue) AS revenue, sum(profit) AS profit
             FROM valid JOIN ends USING (node_id) WHERE day <= cur_end AND day > cur_end - 7 GROUP BY 1, 2),
    pick AS (SELECT node_id, business AS cur_business FROM (
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY CAST(business <> 'error' AS INT) DESC, cost DESC,
                                     business) AS rn FROM sums) WHERE rn = 1 AND business <> 'error'),
    now AS (SELECT node_id, sum(cost) AS cur_cost7, sum(profit) AS cur_profit7 FROM sums JOIN pick USING (node_id)
            WHERE business = cur_business OR (business = 'error' AND revenue > 0) GROUP BY 1)"""


@query("q_f09_review_table", twin(NOW + """
    SELECT node_id, top1 AS top1_business, n.business_name AS top1_name,
           round(round(cost1, 2) - cur_cost7, 2) AS diff_cost, round(round(profit1, 2) - cur_profit7, 2) AS diff_profit
    FROM wide_off w LEFT JOIN now USING (node_id) LEFT JOIN names n ON n.business = top1""",
                                  "daily", "wide_off", "names"))
def review_rows(spark, sf):
    return review(flow_of(spark, sf)).select("node_id", "top1_business", "top1_name",
                                             *[F.round(c, 2).alias(c) for c in ("diff_cost", "diff_profit")])


@query("q_f09_review_counts", twin(NOW + """
    SELECT count(*) AS nodes, count(cur_cost7) AS with_current, count(*) FILTER (cur_profit7 < 0) AS losing,
           count(*) FILTER (cur_profit7 < 0 AND profit1 > 0) AS turns_positive
    FROM wide_off LEFT JOIN now USING (node_id)""", "daily", "wide_off"))
def review_summary(spark, sf):
    return reports.review_counts(review(flow_of(spark, sf)))


@query("q_p11_family_review", twin("""
    SELECT node_id, true_best, fam(true_best) AS tb_fam, shown AS top1_business_id,
           trim(coalesce(n.business_name, '') || ' ' || shown) AS top1_label,
           CAST(fam(top1) = fam(true_best) AS INT) AS hit1,
           CAST(fam(true_best) IN (fam(top1), coalesce(fam(top2), ''), coalesce(fam(top3), '')) AS INT) AS hit3
    FROM (SELECT *, CASE top1 WHEN 'Brand#2' THEN 'Brand#1' ELSE top1 END AS shown FROM hits_off)
    LEFT JOIN names n ON n.business = shown""", "hits_off", "names").replace(
    "fam(true_best)", "CASE true_best WHEN 'Brand#1' THEN 'FAM1' WHEN 'Brand#2' THEN 'FAM1' ELSE true_best END").replace(
    "fam(top1)", "CASE top1 WHEN 'Brand#1' THEN 'FAM1' WHEN 'Brand#2' THEN 'FAM1' ELSE top1 END").replace(
    "fam(top2)", "CASE top2 WHEN 'Brand#1' THEN 'FAM1' WHEN 'Brand#2' THEN 'FAM1' ELSE top2 END").replace(
    "fam(top3)", "CASE top3 WHEN 'Brand#1' THEN 'FAM1' WHEN 'Brand#2' THEN 'FAM1' ELSE top3 END"))
def family_review(spark, sf):
    flow = flow_of(spark, sf)
    wide = ranking.widen(flow.recs("score_off"))
    return reports.family_review(wide, flow.truth, flow.names, {"Brand#2": "Brand#1"},
                                 {"Brand#1": "FAM1", "Brand#2": "FAM1"})


@query("q_p21_current_cells", twin("""
    SELECT node_id, top1, coalesce(days, 0) AS days FROM wide_off LEFT JOIN (
        SELECT node_id, least(7, count(*)) AS days FROM (
            SELECT node_id, day, row_number() OVER (PARTITION BY node_id ORDER BY day DESC) AS rn,
                   max(day) OVER (PARTITION BY node_id) AS last_day FROM (SELECT DISTINCT node_id, day FROM daily))
        WHERE day + CAST(rn - 1 AS INT) = last_day GROUP BY 1) USING (node_id)""", "wide_off", "daily"))
def current_cells(spark, sf):
    flow = flow_of(spark, sf)
    now = streaks.current_business(tables.daily_settlement(spark, sf))
    cells = reports.with_current_cell(ranking.widen(flow.recs("score_off")), now)
    return cells.select("node_id", F.col("top1_business").alias("top1"),
                        F.coalesce("days", share_flag(F.col("current") != "—")).cast("long").alias("days"))


@query("q_q03_metrics_by_path", twin("""
    ,m AS (SELECT avg(hit1) AS h1, avg(hit3) AS h3, count(*) AS n FROM hits_off)
    SELECT 'test.n' AS metric, (SELECT n FROM m)::DOUBLE AS value, TRUE AS passed UNION ALL
    SELECT 'rates.0.value', round((SELECT h1 FROM m), 4), (SELECT h1 FROM m) <= 0.5 UNION ALL
    SELECT 'rates.1.value', round((SELECT h3 FROM m), 4), (SELECT h3 FROM m) >= 0.9 UNION ALL
    SELECT 'rates.0.name', NULL, FALSE UNION ALL SELECT 'test.wape', NULL, FALSE""", "hits_off"))
def q03_by_path(spark, sf):
    """A metrics document of any shape is read back and checked by dotted paths; a missing path and a text fail."""
    flow = flow_of(spark, sf)
    rates = evaluation.hit_rates(evaluation.hits(flow.recs("score_off"), flow.truth))
    document = rates.select(F.struct(F.col("n")).alias("test"), F.array(
        F.struct(F.lit("hit1").alias("name"), F.col("hit_at_1").alias("value")),
        F.struct(F.lit("hit3").alias("name"), F.col("hit_at_3").alias("value"))).alias("rates"))
    path = files.write_metrics_json(document, stage_path(spark, "metrics_by_path"))
    expected = [("test.n", 1, 1e12), ("rates.0.value", 0, 0.5), ("rates.1.value", 0.9, 1), ("rates.0.name", 0, 1), ("test.wape", 0, 1)]
    return metrics.within(metrics.read_metrics(spark, path), expected).select("metric", F.round("value", 4).alias("value"), "passed")
