"""W01-W14 windows, ranking and frames."""

from pyspark.sql import functions as F

from settlerank.functions import share_flag
from settlerank.operators import ranking, reports, scoring, split, streaks
from settlerank.operators.encoder import AttributeEncoder
from settlerank.plans.catalog.aggregates import UNIT_ROWS
from settlerank.plans.flow import flow_of
from settlerank.plans.registry import query
from settlerank.plans.twins import twin
from settlerank.sources import tables


@query("q_w01_top3", twin("SELECT node_id, business, rank, round(score_on, 4) AS score FROM rec_on", "rec_on"))
def w01(spark, sf):
    top = scoring.best_by_score(flow_of(spark, sf).on_off, "score_on")
    return top.select("node_id", "business", "rank", F.round("score_on", 4).alias("score"))


@query("q_w02_true_best", twin("""
    SELECT node_id, true_best, round(true_value, 4) AS true_value FROM truth""", "truth"))
def w02(spark, sf):
    return flow_of(spark, sf).truth.select("node_id", "true_best", F.round("true_value", 4).alias("true_value"))


@query("q_w03_norm_within_node", twin("""
    SELECT node_id, business, round(cost_norm, 6) AS cost_norm FROM normed""", "normed"))
def w03(spark, sf):
    return flow_of(spark, sf).predicted.select(
        "node_id", "business", F.round(ranking.norm_within("pred_cost"), 6).alias("cost_norm"))


@query("q_w04_norm_by_node_max", twin("""
    SELECT node_id, business, round(coalesce(v / CASE WHEN mx > 0 THEN mx ELSE 1 END, 0), 6) AS bw_norm
    FROM (SELECT *, max(v) OVER (PARTITION BY node_id) AS mx FROM (
        SELECT node_id, t.business, peak_mbps AS v FROM totals t
        LEFT JOIN peaks p USING (node_id, business)))""", "totals", "peaks"))
def w04(spark, sf):
    flow = flow_of(spark, sf)
    rows = flow.totals.select("node_id", "business").join(flow.peaks, ["node_id", "business"], "left")
    return rows.select("node_id", "business", F.round(ranking.norm_by_max("peak_mbps"), 6).alias("bw_norm"))


@query("q_w05_temporal_split", twin("""
    SELECT node_id, strftime(intro_day, '%Y-%m-%d') AS intro_day, CAST(is_test AS INT) AS is_test FROM split""",
                                    "split"))
def w05(spark, sf):
    nodes = split.first_days(flow_of(spark, sf).frame)
    return split.temporal_split(nodes, 0.8).select(
        "node_id", F.date_format("intro_day", "yyyy-MM-dd").alias("intro_day"),
        share_flag(F.col("is_test")).alias("is_test"))


STREAK = """
    ,last AS (SELECT node_id, max(day) AS last_day FROM daily GROUP BY 1),
    numbered AS (SELECT node_id, day, row_number() OVER (PARTITION BY node_id ORDER BY day DESC) AS rn
                 FROM (SELECT DISTINCT node_id, day FROM daily)),
    streak AS (SELECT node_id, last_day, least(7, count(*)) AS n FROM numbered JOIN last USING (node_id)
               WHERE day + CAST(rn - 1 AS INT) = last_day GROUP BY 1, 2)
    """


@query("q_w06_trailing_streak", twin(STREAK + """
    SELECT node_id, strftime(last_day, '%Y-%m-%d') AS last_day, CAST(n AS INT) AS streak FROM streak""", "daily"))
def w06(spark, sf):
    return streaks.trailing_streak(tables.daily_settlement(spark, sf)).select(
        "node_id", F.date_format("last_day", "yyyy-MM-dd").alias("last_day"), "streak")


CURRENT = STREAK.rstrip() + """,
    win AS (SELECT d.*, n, sum(revenue) OVER (PARTITION BY node_id) AS node_rev,
                   sum(revenue) OVER (PARTITION BY node_id, business) AS biz_rev
            FROM daily d JOIN streak USING (node_id) WHERE day > last_day - CAST(n AS INT))"""
CURRENT_SELECT = """,
    best AS (SELECT node_id, business AS cur_business FROM (
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY {weight} DESC, day, business) AS rn
        FROM win WHERE node_rev > 0) WHERE rn = 1)
    SELECT node_id, cur_business, CAST(n AS INT) AS days, round(sum(cost), 2) AS cur_cost,
           round(CASE WHEN abs(sum(profit)) > 1e-9 THEN sum(profit) ELSE sum(revenue) - sum(cost) END, 2) AS cur_profit,
           CASE WHEN n >= 7 THEN '近7天' ELSE '近' || n || '天' END AS streak_label
    FROM win JOIN best USING (node_id) WHERE business = cur_business GROUP BY 1, 2, n"""


@query("q_w07_current_business", twin(CURRENT + CURRENT_SELECT.format(weight="revenue"), "daily"))
def w07(spark, sf):
    return current(spark, sf, "row")


@query("q_w07_current_business_by_sum", twin(CURRENT + CURRENT_SELECT.format(weight="biz_rev"), "daily"))
def w07_sum(spark, sf):
    return current(spark, sf, "sum")


def current(spark, sf, by):
    out = streaks.current_business(tables.daily_settlement(spark, sf), by=by)
    return out.select("node_id", "cur_business", "days", F.round("cur_cost", 2).alias("cur_cost"),
                      F.round("cur_profit", 2).alias("cur_profit"), "streak_label")


@query("q_w08_current_seven_days", twin("""
    ,valid AS (SELECT * FROM daily WHERE (cost <> 0 OR revenue <> 0)
               AND day > (SELECT max(day) FROM daily) - 30),
    isl AS (SELECT node_id, day, day - CAST(row_number() OVER (PARTITION BY node_id ORDER BY day) AS INT) AS island
            FROM (SELECT DISTINCT node_id, day FROM valid)),
    runs AS (SELECT node_id, max(day) AS cur_end FROM isl GROUP BY node_id, island HAVING count(*) >= 7),
    ends AS (SELECT node_id, max(cur_end) AS cur_end FROM runs GROUP BY 1),
    sums AS (SELECT node_id, business, cur_end, sum(cost) AS cost, sum(revenue) AS revenue, sum(profit) AS profit
             FROM valid JOIN ends USING (node_id) WHERE day <= cur_end AND day > cur_end - 7 GROUP BY 1, 2, 3),
    paid AS (SELECT * FROM (SELECT *, sum(revenue) OVER (PARTITION BY node_id) AS r FROM sums) WHERE r > 0),
    pick AS (SELECT node_id, business AS cur_business FROM (
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY CAST(business <> 'error' AS INT) DESC, cost DESC,
                                     business) AS rn FROM paid) WHERE rn = 1 AND business <> 'error'),
    found AS (SELECT node_id, cur_business, cur_end, sum(cost) AS cur_cost7, sum(profit) AS cur_profit7
              FROM paid JOIN pick USING (node_id)
              WHERE business = cur_business OR (business = 'error' AND revenue > 0) GROUP BY 1, 2, 3)
    SELECT node_id, cur_business, strftime(cur_end - 6, '%Y-%m-%d') AS cur_start,
           strftime(cur_end, '%Y-%m-%d') AS cur_end, round(cur_cost7, 2) AS cur_cost7,
           round(cur_profit7, 2) AS cur_profit7, CAST(cur_business IS NOT NULL AS INT) AS has_cur
    FROM (SELECT DISTINCT node_id FROM daily) LEFT JOIN found USING (node_id)""", "daily"))
def w08(spark, sf):
    out = streaks.current_seven_days(tables.daily_settlement(spark, sf), unnamed="error")
    return out.select("node_id", "cur_business", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in
                                                   ("cur_start", "cur_end")],
                      *[F.round(c, 2).alias(c) for c in ("cur_cost7", "cur_profit7")], "has_cur")


@query("q_w09_top_neighbours", twin("""
    SELECT node_id, neighbour_id, rank FROM near WHERE rank <= 10""", "near"))
def w09(spark, sf):
    near = flow_of(spark, sf).near
    order = [F.desc("similarity"), F.asc("neighbour_id")]
    return ranking.top_k(near.drop("rank"), "node_id", order, 10).select("node_id", "neighbour_id", "rank")


@query("q_w10_rank_whole_pool", twin("""
    SELECT node_id, rank, business FROM (SELECT node_id FROM truth), (
        SELECT business, row_number() OVER (ORDER BY support DESC, business) AS rank FROM pool) WHERE rank <= 3""",
                                     "truth", "pool"))
def w10(spark, sf):
    from settlerank.operators.baselines import same_for_all
    flow = flow_of(spark, sf)
    return same_for_all(flow.truth, flow.pool.select("business", F.col("support").alias("score"))).select(
        "node_id", "rank", "business")


@query("q_w11_cost_and_unit_best", UNIT_ROWS + """
    SELECT node_id, abs_best, unit_best, same, round(ua, 4) AS unit_abs, round(uu, 4) AS unit_unit FROM best""")
def w11(spark, sf):
    pair = reports.pair_bandwidth(tables.build_bandwidth(spark, sf))
    best = reports.best_by_cost_and_unit(reports.unit_yield(flow_of(spark, sf).totals, pair))
    return best.select("node_id", "abs_best", "unit_best", "same", F.round("unit_abs", 4).alias("unit_abs"),
                       F.round("unit_unit", 4).alias("unit_unit"))


@query("q_w12_gated_first", twin("""
    ,e AS (SELECT *, cost_norm + profit_pen AS soft,
                  CAST(pred_profit > 3000 AND profit_p10 > -2000 AS INT) AS eligible FROM penalised),
    f AS (SELECT *, CAST(row_number() OVER (PARTITION BY node_id ORDER BY eligible DESC, soft DESC, pred_cost DESC,
                                            business) = 1 AS INT) AS lead FROM e)
    SELECT node_id, business, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY lead DESC, soft DESC, pred_cost DESC, business)
                  AS rank FROM f) WHERE rank <= 3""", "penalised"))
def w12(spark, sf):
    scored = scoring.score_full_pool(flow_of(spark, sf).predicted)
    strict = (F.col("pred_profit") > 3000) & (F.col("profit_p10") > -2000)
    return scoring.gated_top(scored.withColumn("eligible", share_flag(strict))).select("node_id", "business", "rank")


@query("q_w13_validation_flag", twin("""
    SELECT node_id, business, CAST(substr(md5('42|' || node_id || '|' || business), 1, 4) < '2666' AS INT) AS is_valid
    FROM totals""", "totals"))
def w13(spark, sf):
    flagged = split.validation_flag(tables.ledger_totals(spark, sf), 0.15, 42)
    return flagged.select("node_id", "business", share_flag(F.col("is_valid")).alias("is_valid"))


@query("q_w14_quantile_positions", twin("""
    SELECT node_id, field, round(pos, 6) AS pos FROM placed""", "placed"))
def w14(spark, sf):
    attrs = tables.node_attributes(spark, sf)
    placed = AttributeEncoder(tables.CATS, tables.NUMS).fit(attrs).quantile_positions(attrs)
    from settlerank.operators.percentiles import long_values
    return long_values(placed, tables.NUMS, ["node_id"]).select("node_id", "field", F.round("value", 6).alias("pos"))
