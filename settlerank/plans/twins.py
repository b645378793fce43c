"""Common table expressions for the SQL twins, resolved by name."""

from __future__ import annotations

CTES: dict[str, tuple[str, str]] = {
    # name: (needs, body)
    "daily": ("", """
        SELECT CAST(user_id AS VARCHAR) AS node_id, event_type AS business, CAST(ts AS DATE) AS day,
               sum(coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)) AS cost,
               sum(coalesce(value, 0)) AS revenue, max(value) AS peak, count(*) AS n_rows,
               sum(coalesce(value, 0)) - sum(coalesce(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0)) AS profit
        FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2, 3"""),
    "first_seen": ("daily", "SELECT *, min(day) OVER (PARTITION BY node_id, business) AS fd FROM daily"),
    "led7": ("first_seen", """
        SELECT node_id, business, fd AS business_online_day, count(DISTINCT day) AS outcome_days,
               sum(cost) AS cum_cost_7d, sum(revenue) AS cum_revenue_7d
        FROM first_seen WHERE day <= fd + 6 GROUP BY 1, 2, 3"""),
    "pairs": ("", """
        SELECT CAST(o_custkey AS VARCHAR) AS node_id, p_brand AS business,
               p_brand || ' ' || min(label) AS business_name, min(CAST(o_orderdate AS DATE)) AS business_online_day,
               count(DISTINCT CAST(o_orderdate AS DATE)) AS outcome_days,
               sum(0.8 * l_quantity * p_retailprice) AS cum_cost_7d,
               sum(l_extendedprice * (1 - l_discount)) AS cum_revenue_7d
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        JOIN (SELECT p_brand AS b, min(p_type) AS label FROM part GROUP BY 1) ON b = p_brand
        WHERE o_custkey IS NOT NULL AND p_brand IS NOT NULL GROUP BY 1, 2"""),
    "totals": ("pairs", """
        SELECT *, min(business_online_day) OVER (PARTITION BY node_id) AS online_day,
               count(*) OVER (PARTITION BY node_id) AS business_count, cum_revenue_7d - cum_cost_7d AS cum_profit_7d
        FROM pairs"""),
    "attrs": ("", """
        SELECT CAST(c_custkey AS VARCHAR) AS node_id, c_mktsegment AS segment, n_name AS nation, r_name AS region,
               c_acctbal AS acctbal, n_orders, avg_price
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
        LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n_orders, avg(o_totalprice) AS avg_price
                   FROM orders GROUP BY 1) s ON o_custkey = c_custkey"""),
    "frame": ("totals attrs", "SELECT totals.* FROM totals WHERE node_id IN (SELECT node_id FROM attrs)"),
    "nodes": ("frame", "SELECT node_id, min(online_day) AS intro_day FROM frame GROUP BY 1"),
    "split": ("nodes", """
        SELECT node_id, intro_day,
               row_number() OVER (ORDER BY intro_day NULLS LAST, md5(node_id), node_id)
               > CAST(floor(CAST(0.8 AS DOUBLE) * count(*) OVER ()) AS BIGINT) AS is_test
        FROM nodes"""),
    "sided": ("frame split", "SELECT frame.*, is_test FROM frame JOIN split USING (node_id)"),
    "train": ("sided", "SELECT * FROM sided WHERE NOT is_test"),
    "test": ("sided", "SELECT * FROM sided WHERE is_test"),
    "stats": ("train", """
        SELECT business, avg(cum_cost_7d) AS cost_mean, quantile_cont(cum_cost_7d, 0.9) AS cost_p90,
               avg(cum_profit_7d) AS profit_mean, quantile_cont(cum_profit_7d, 0.1) AS profit_p10,
               count(DISTINCT node_id) AS support, ln(1 + avg(cum_cost_7d)) AS cost_mean_log,
               ln(1 + quantile_cont(cum_cost_7d, 0.9)) AS cost_p90_log,
               ln(1 + greatest(avg(cum_profit_7d), 0)) AS profit_mean_log,
               ln(1 + count(DISTINCT node_id)) AS support_log
        FROM train GROUP BY 1"""),
    "pool": ("stats", "SELECT * FROM stats WHERE support >= 20"),
    "truth": ("test", """
        SELECT node_id, business AS true_best, cum_cost_7d AS true_value FROM (
            SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY cum_cost_7d DESC, business) AS rn FROM test)
        WHERE rn = 1"""),
    "pool_train": ("train pool", "SELECT * FROM train WHERE business IN (SELECT business FROM pool)"),
    "prior": ("pool_train", "SELECT business, avg(cum_cost_7d) AS prior FROM pool_train GROUP BY 1"),
    "segs": ("attrs", """
        SELECT node_id, coalesce(segment, '__UNK__') || '|' || coalesce(nation, '__UNK__') || '|'
               || coalesce(region, '__UNK__') AS seg FROM attrs"""),
    "segstat": ("pool_train segs", """
        SELECT seg, business, count(*) AS seg_rows, sum(cum_cost_7d) AS seg_cost_sum, avg(cum_cost_7d) AS seg_cost_mean,
               sum(cum_profit_7d) AS seg_profit_sum
        FROM pool_train JOIN segs USING (node_id) GROUP BY 1, 2"""),
    # surrogate predictions per own pair: the segment mean, with the business mean as one more row
    "predicted": ("sided segs segstat pool", """
        SELECT s.node_id, s.business, s.is_test, s.cum_cost_7d, s.cum_profit_7d,
               (coalesce(seg_cost_sum, 0) + p.cost_mean) / (coalesce(seg_rows, 0) + 1) AS pred_cost,
               (coalesce(seg_profit_sum, 0) + p.profit_mean) / (coalesce(seg_rows, 0) + 1) AS pred_profit, p.profit_p10
        FROM sided s JOIN pool p USING (business) JOIN segs USING (node_id)
        LEFT JOIN segstat g ON g.seg = segs.seg AND g.business = s.business"""),
    "normed": ("predicted", """
        SELECT *, CASE WHEN mx - mn > 1e-9 THEN (pred_cost - mn) / (mx - mn) ELSE 0.5 END AS cost_norm
        FROM (SELECT *, min(pred_cost) OVER w AS mn, max(pred_cost) OVER w AS mx FROM predicted
              WINDOW w AS (PARTITION BY node_id))"""),
    "penalised": ("normed", """
        SELECT *, CASE WHEN pred_profit <= 0 THEN -0.8 * cost_norm ELSE 0 END AS profit_pen FROM normed"""),
    "traffic": ("", """
        SELECT CAST(o_custkey AS VARCHAR) AS node_id, p_brand AS business, CAST(o_orderdate AS DATE) AS day,
               sum(l_quantity) AS peak_mbps
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"""),
    "per_day": ("traffic", "SELECT business, day, sum(peak_mbps) AS traffic FROM traffic GROUP BY 1, 2"),
    "capacity": ("per_day traffic", """
        SELECT business, days, sample_nodes, p75 AS traffic_p75_mbps, p75 / 0.7::DOUBLE AS capacity_upper_mbps,
               0.7::DOUBLE AS util_at_capacity, load AS current_daily_peak95_sum_mbps,
               greatest(0, p75 / 0.7::DOUBLE - load) AS can_add_mbps,
               greatest(0, load - p75 / 0.7::DOUBLE) AS over_capacity_mbps
        FROM (SELECT business, count(*) AS days, quantile_cont(traffic, 0.75) AS p75, arg_max(traffic, day) AS load
              FROM per_day GROUP BY 1)
        JOIN (SELECT business, count(DISTINCT node_id) AS sample_nodes FROM traffic GROUP BY 1) USING (business)"""),
    "peaks": ("traffic", "SELECT node_id, business, max(peak_mbps) AS peak_mbps FROM traffic GROUP BY 1, 2"),
    # v1 score, and the on/off scores with the utilisation aux
    "scored": ("penalised capacity peaks attrs", """
        SELECT p.*, -0.3 * CASE WHEN capacity_upper_mbps > 0 THEN least(1.0, over_capacity_mbps / capacity_upper_mbps)
                                ELSE 0 END AS cap_pen,
               least(greatest(coalesce(CASE WHEN n_orders > 0 THEN peak_mbps / n_orders END, 0), 0), 2) AS bw_aux
        FROM penalised p LEFT JOIN capacity USING (business) LEFT JOIN peaks USING (node_id, business)
        LEFT JOIN attrs USING (node_id)"""),
    "onoff": ("scored", """
        SELECT *, pred_cost + profit_pen + cap_pen AS score_off,
               pred_cost + profit_pen + cap_pen + 0.1 * bw_aux * cost_norm AS score_on FROM scored"""),
    "rec_off": ("onoff", """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score_off DESC, business) AS rank
                       FROM onoff) WHERE rank <= 3"""),
    "rec_on": ("onoff", """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score_on DESC, business) AS rank
                       FROM onoff) WHERE rank <= 3"""),
    "wide_off": ("rec_off", """
        SELECT node_id, max(CASE WHEN rank = 1 THEN business END) AS top1,
               max(CASE WHEN rank = 2 THEN business END) AS top2, max(CASE WHEN rank = 3 THEN business END) AS top3,
               max(CASE WHEN rank = 1 THEN pred_cost END) AS cost1, max(CASE WHEN rank = 1 THEN pred_profit END) AS profit1
        FROM rec_off GROUP BY 1"""),
    "wide_on": ("rec_on", """
        SELECT node_id, max(CASE WHEN rank = 1 THEN business END) AS top1,
               max(CASE WHEN rank = 2 THEN business END) AS top2, max(CASE WHEN rank = 3 THEN business END) AS top3,
               max(CASE WHEN rank = 1 THEN pred_cost END) AS cost1, max(CASE WHEN rank = 1 THEN pred_profit END) AS profit1
        FROM rec_on GROUP BY 1"""),
    "hits_off": ("wide_off truth", """
        SELECT w.*, true_best, CAST(coalesce(top1 = true_best, false) AS INT) AS hit1,
               CAST(coalesce(top1 = true_best, false) OR coalesce(top2 = true_best, false)
                    OR coalesce(top3 = true_best, false) AS INT) AS hit3
        FROM wide_off w JOIN truth USING (node_id)"""),
    "hits_on": ("wide_on truth", """
        SELECT w.*, true_best, CAST(coalesce(top1 = true_best, false) AS INT) AS hit1,
               CAST(coalesce(top1 = true_best, false) OR coalesce(top2 = true_best, false)
                    OR coalesce(top3 = true_best, false) AS INT) AS hit3
        FROM wide_on w JOIN truth USING (node_id)"""),
    "names": ("totals", """
        SELECT business, min(business_name) AS business_name FROM totals WHERE business_name IS NOT NULL GROUP BY 1"""),
    "fams": ("totals names", """
        SELECT t.node_id, CASE WHEN n.business_name LIKE '%Brand#1%' THEN 'FAM1'
                               WHEN n.business_name LIKE '%Brand#2%' THEN 'FAM2' ELSE t.business END AS business,
               cum_cost_7d, cum_revenue_7d, outcome_days, online_day, n.business_name
        FROM totals t LEFT JOIN names n USING (business)"""),
    # attribute encoding
    "folded": ("attrs", """
        SELECT node_id,
               CASE WHEN count(*) OVER (PARTITION BY coalesce(segment, '__UNK__')) < 2 THEN '__RARE__'
                    ELSE coalesce(segment, '__UNK__') END AS segment,
               CASE WHEN count(*) OVER (PARTITION BY coalesce(nation, '__UNK__')) < 2 THEN '__RARE__'
                    ELSE coalesce(nation, '__UNK__') END AS nation,
               CASE WHEN count(*) OVER (PARTITION BY coalesce(region, '__UNK__')) < 2 THEN '__RARE__'
                    ELSE coalesce(region, '__UNK__') END AS region
        FROM attrs"""),
    "positive": ("attrs", """
        SELECT node_id, 'acctbal' AS field, CASE WHEN acctbal > 0 THEN acctbal END AS v FROM attrs UNION ALL
        SELECT node_id, 'n_orders', CASE WHEN n_orders > 0 THEN n_orders END FROM attrs UNION ALL
        SELECT node_id, 'avg_price', CASE WHEN avg_price > 0 THEN avg_price END FROM attrs"""),
    "imputed": ("positive", """
        SELECT node_id, field, coalesce(v, median(v) OVER (PARTITION BY field)) AS v FROM positive"""),
    "knots": ("imputed", """
        SELECT field, i, CAST(i AS DOUBLE) / 499 AS ref, list_extract(qs, CAST(i + 1 AS BIGINT)) AS q
        FROM (SELECT field, quantile_cont(v, [%s]) AS qs FROM imputed GROUP BY field), range(500) t(i)"""
              % ", ".join(f"CAST({i} AS DOUBLE) / 499" for i in range(500))),
    "placed": ("imputed knots", """
        SELECT node_id, field, v,
               CASE WHEN v = lo THEN 0 WHEN v = hi THEN 1
                    WHEN q_dn = v THEN (r_dn + r_up) / 2
                    ELSE r_dn + (v - q_dn) / (q_up - q_dn) * (r_up - r_dn) END AS pos
        FROM (SELECT x.node_id, x.field, x.v, min(k.q) AS lo, max(k.q) AS hi,
                     max(k.q) FILTER (k.q <= x.v) AS q_dn, max(k.ref) FILTER (k.q <= x.v) AS r_dn,
                     min(k.q) FILTER (k.q >= x.v) AS q_up, min(k.ref) FILTER (k.q >= x.v) AS r_up
              FROM imputed x JOIN knots k USING (field) GROUP BY 1, 2, 3)"""),
    "lengths": ("placed", "SELECT node_id, sqrt(sum(pos * pos)) AS len FROM placed GROUP BY 1"),
    "unit": ("placed lengths", """
        SELECT node_id, len, max(CASE WHEN field = 'acctbal' THEN u END) AS u1,
               max(CASE WHEN field = 'n_orders' THEN u END) AS u2, max(CASE WHEN field = 'avg_price' THEN u END) AS u3
        FROM (SELECT node_id, field, len, CASE WHEN len > 0 THEN pos / len ELSE 0 END AS u
              FROM placed JOIN lengths USING (node_id)) GROUP BY 1, 2"""),
    "vectors": ("folded unit", "SELECT * FROM folded JOIN unit USING (node_id)"),
    "sims": ("vectors split", """
        SELECT a.node_id, b.node_id AS neighbour_id,
               round((0.65 * (CAST(a.segment = b.segment AS INT) + CAST(a.nation = b.nation AS INT)
                              + CAST(a.region = b.region AS INT)) / 3.0
                      + 0.35 * (a.u1 * b.u1 + a.u2 * b.u2 + a.u3 * b.u3))
                     / (sqrt(0.65 + 0.35 * CAST(a.len > 0 AS INT)) * sqrt(0.65 + 0.35 * CAST(b.len > 0 AS INT))), 9)
               AS similarity
        FROM vectors a JOIN split sa ON sa.node_id = a.node_id, vectors b JOIN split sb ON sb.node_id = b.node_id
        WHERE NOT sb.is_test"""),
    "near": ("sims", """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY similarity DESC, neighbour_id) AS rank
                       FROM sims) WHERE rank <= 15"""),
    "cand": ("near train sided pool", """
        SELECT DISTINCT node_id, business FROM (
            SELECT near.node_id, business FROM near JOIN train ON train.node_id = near.neighbour_id
            UNION ALL SELECT node_id, business FROM sided)
        WHERE business IN (SELECT business FROM pool)"""),
}


def twin(select: str, *names: str) -> str:
    """``WITH`` every named expression and what it needs, in order, then the select."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for need in CTES[name][0].split():
            add(need)
        order.append(name)

    for name in names:
        add(name)
    select = select.lstrip()       # a select that starts with a comma adds expressions of its own
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + select
