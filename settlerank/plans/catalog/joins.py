"""J01-J19 joins, U01-U05 set operations, O01-O05 sorts, limits and sampling."""

from pyspark.sql import functions as F

from settlerank.functions import display_label
from settlerank.operators import baselines, candidates, evaluation, knn, ledger, models, ranking, reports, scoring, split
from settlerank.plans.catalog.columns import two_runs
from settlerank.plans.flow import flow_of
from settlerank.plans.registry import query
from settlerank.plans.twins import twin
from settlerank.sources import tables


@query("q_j01_ledger_attributes", twin("""
    SELECT node_id, business, segment, nation, round(acctbal, 2) AS acctbal FROM totals JOIN attrs USING (node_id)""",
                                       "totals", "attrs"))
def j01(spark, sf):
    joined = ledger.join_attributes(tables.ledger_totals(spark, sf), tables.node_attributes(spark, sf), check=True)
    return joined.select("node_id", "business", "segment", "nation", F.round("acctbal", 2).alias("acctbal"))


@query("q_j02_pairs_left_attributes", twin("""
    SELECT d.node_id, d.business, segment, n_orders FROM (SELECT DISTINCT node_id, business FROM daily) d
    LEFT JOIN attrs a USING (node_id)""", "daily", "attrs"))
def j02(spark, sf):
    pairs = tables.daily_settlement(spark, sf).select("node_id", "business").distinct()
    attrs = tables.node_attributes(spark, sf)
    return pairs.join(attrs.select("node_id", "segment", "n_orders"), "node_id", "left")


@query("q_j03_pairs_left_stats", twin("""
    SELECT node_id, t.business, round(coalesce(s.support_log, 0), 6) AS support_log,
           round(coalesce(s.cost_mean, (SELECT avg(cost_mean) FROM stats)), 4) AS biz_prior
    FROM totals t LEFT JOIN stats s ON s.business = t.business""",
                                  "totals", "stats"))
def j03(spark, sf):
    flow = flow_of(spark, sf)
    known = flow.stats
    mean = known.agg(F.avg("cost_mean")).scalar()
    return flow.totals.join(known.select("business", "support_log", "cost_mean"), "business", "left").select(
        "node_id", "business", F.round(F.coalesce("support_log", F.lit(0.0)), 6).alias("support_log"),
        F.round(F.coalesce("cost_mean", mean), 4).alias("biz_prior"))


@query("q_j04_features_left_labels", twin("""
    SELECT p.node_id, p.business, round(t.cum_cost_7d, 4) AS label FROM led7 p
    LEFT JOIN totals t ON t.node_id = p.node_id AND t.business = 'Brand#' || length(p.business)""", "led7", "totals"))
def j04(spark, sf):
    pairs = ledger.first_window_ledger(tables.daily_settlement(spark, sf)).select(
        "node_id", "business", F.concat(F.lit("Brand#"), F.length("business")).alias("brand"))
    labels = tables.ledger_totals(spark, sf).select("node_id", F.col("business").alias("brand"), "cum_cost_7d")
    return pairs.join(labels, ["node_id", "brand"], "left").select("node_id", "business",
                                                                   F.round("cum_cost_7d", 4).alias("label"))


@query("q_j05_semi", twin("""
    SELECT node_id, count(*) AS n_pairs FROM totals WHERE node_id IN (SELECT node_id FROM daily) GROUP BY 1""",
                          "totals", "daily"))
def j05(spark, sf):
    active = tables.daily_settlement(spark, sf).select("node_id")
    return tables.ledger_totals(spark, sf).join(active, "node_id", "left_semi").groupBy("node_id").agg(
        F.count("*").alias("n_pairs"))


@query("q_j06_anti", twin("""
    SELECT node_id FROM attrs WHERE node_id NOT IN (SELECT node_id FROM daily)""", "attrs", "daily"))
def j06(spark, sf):
    return tables.node_keys(spark, sf).join(tables.daily_settlement(spark, sf).select("node_id"), "node_id",
                                            "left_anti")


@query("q_j07_lookup_with_default", twin("""
    SELECT node_id, business, CAST(coalesce(capacity_upper_mbps, 0) > 0 AS INT) AS has_capacity,
           round(coalesce(peak_mbps, 0), 2) AS peak_mbps
    FROM totals LEFT JOIN capacity c USING (business)
    LEFT JOIN peaks p USING (node_id, business)""",
                                     "totals", "capacity", "peaks"))
def j07(spark, sf):
    flow = flow_of(spark, sf)
    cap, peaks = flow.capacity.select("business", "capacity_upper_mbps"), flow.peaks
    return (flow.totals.join(cap, "business", "left").join(peaks, ["node_id", "business"], "left")
            .select("node_id", "business", (F.coalesce("capacity_upper_mbps", F.lit(0.0)) > 0).cast("int").alias("has_capacity"),
                    F.round(F.coalesce("peak_mbps", F.lit(0.0)), 2).alias("peak_mbps")))


@query("q_j08_whole_pool", twin("""
    SELECT node_id, count(*) AS n_businesses, min(business) AS first_id, max(business) AS last_id
    FROM (SELECT node_id FROM split WHERE is_test), pool GROUP BY 1""", "split", "pool"))
def j08(spark, sf):
    flow = flow_of(spark, sf)
    pairs = baselines.spread_pool(flow.split.where("is_test").select("node_id"), flow.pool)
    return pairs.groupBy("node_id").agg(F.count("*").alias("n_businesses"), F.min("business").alias("first_id"),
                                        F.max("business").alias("last_id"))


EMBEDDING_NEAR = """
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
    u AS (SELECT vec_id, [v / sqrt(list_dot_product(x, x)) FOR v IN x] AS x FROM e),
    s AS (SELECT CAST(a.vec_id AS VARCHAR) AS node_id, CAST(b.vec_id AS VARCHAR) AS neighbour_id,
                 round(list_dot_product(a.x, b.x), 9) AS similarity FROM u a, u b)
    SELECT node_id, neighbour_id, rank, round(similarity, 6) AS similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY similarity DESC, neighbour_id) AS rank FROM s)
    WHERE rank <= 15"""


@query("q_j09_cosine_top_k", EMBEDDING_NEAR)
def j09(spark, sf):
    vectors = knn.dense_vectors(tables.table(spark, sf, "embeddings"), "vec_id", "embedding")
    near = knn.nearest(vectors, vectors, 15)
    return near.select("node_id", "neighbour_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("q_j10_neighbour_rows", twin("""
    SELECT near.node_id, count(*) AS n_rows, round(sum(cum_cost_7d), 2) AS cost
    FROM near JOIN train ON train.node_id = neighbour_id GROUP BY 1""", "near", "train"))
def j10(spark, sf):
    flow = flow_of(spark, sf)
    rows = candidates.neighbour_ledger(flow.near, flow.train, "cum_cost_7d")
    return rows.groupBy("node_id").agg(F.count("*").alias("n_rows"), F.round(F.sum("cum_cost_7d"), 2).alias("cost"))


@query("q_j11_recs_to_truth", twin("""
    SELECT w.node_id, top1, true_best FROM wide_off w LEFT JOIN truth USING (node_id)""", "wide_off", "truth"))
def j11(spark, sf):
    flow = flow_of(spark, sf)
    return evaluation.hits(flow.recs("score_off"), flow.truth, how="left").select("node_id", "top1", "true_best")


@query("q_j12_aligned_runs", twin("""
    SELECT a.node_id, a.top1 AS a_top1, b.top1 AS b_top1, CAST(a.top1 = b.top1 AS INT) AS same_top1
    FROM hits_off a JOIN hits_on b USING (node_id)""", "hits_off", "hits_on"))
def j12(spark, sf):
    flow = flow_of(spark, sf)
    a, b = (evaluation.hits(flow.recs(s), flow.truth) for s in ("score_off", "score_on"))
    return evaluation.compare_runs(a, b).select("node_id", "a_top1", "b_top1", "same_top1")


@query("q_j13_first_week_range", """
    WITH d AS (SELECT o_custkey, o_orderpriority, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders),
    f AS (SELECT o_custkey, o_orderpriority, min(day) AS fd FROM d GROUP BY 1, 2)
    SELECT CAST(f.o_custkey AS VARCHAR) AS node_id, f.o_orderpriority AS business, strftime(fd, '%Y-%m-%d') AS first_day,
           count(DISTINCT day) AS ndays, round(sum(o_totalprice), 2) AS total
    FROM f JOIN d ON d.o_custkey = f.o_custkey AND d.o_orderpriority = f.o_orderpriority
                  AND day BETWEEN fd AND fd + 6 GROUP BY 1, 2, 3""")
def j13(spark, sf):
    orders = tables.table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("node_id"), F.col("o_orderpriority").alias("business"),
        F.to_date("o_orderdate").alias("day"), "o_totalprice")
    daily = orders.groupBy("node_id", "business", "day").agg(F.sum("o_totalprice").alias("cost"),
                                                             F.lit(0.0).alias("revenue"))
    return ledger.first_window_ledger(daily).select(
        "node_id", "business", F.date_format("business_online_day", "yyyy-MM-dd").alias("first_day"),
        F.col("outcome_days").cast("long").alias("ndays"), F.round("cum_cost_7d", 2).alias("total"))


@query("q_j14_distribution_difference", twin("""
    SELECT business, coalesce(rec_n, 0) AS rec_n, coalesce(cur_n, 0) AS cur_n,
           coalesce(rec_n, 0) - coalesce(cur_n, 0) AS delta
    FROM (SELECT business, count(*) AS rec_n FROM rec_off WHERE rank = 1 GROUP BY 1)
    FULL JOIN (SELECT true_best AS business, count(*) AS cur_n FROM truth GROUP BY 1) USING (business)
    ORDER BY coalesce(rec_n, 0) + coalesce(cur_n, 0) DESC, business LIMIT 20""", "rec_off", "truth"))
def j14(spark, sf):
    flow = flow_of(spark, sf)
    current = flow.truth.select(F.col("true_best").alias("business"))
    return reports.distribution_difference(flow.recs("score_off").where("rank = 1"), current)


@query("q_j15_keyed_concat", twin("""
    SELECT business, round(cost_mean, 4) AS cost_mean, sample_nodes FROM stats JOIN capacity USING (business)""",
                                  "stats", "capacity"))
def j15(spark, sf):
    flow = flow_of(spark, sf)
    return flow.stats.select("business", F.round("cost_mean", 4).alias("cost_mean")).join(
        flow.capacity.select("business", "sample_nodes"), "business")


SAME_BUSINESS = twin("""
    SELECT business, node_id, round(sum(w * cum_cost_7d) / sum(w), 4) AS neighbour_cost, count(*) AS n
    FROM (SELECT t.node_id, t.business, n.cum_cost_7d, pow(greatest(similarity, 0), 4) AS w,
                 row_number() OVER (PARTITION BY t.node_id, t.business
                                    ORDER BY similarity DESC, s.neighbour_id) AS rn
          FROM sided t JOIN sims s ON s.node_id = t.node_id
          JOIN train n ON n.node_id = s.neighbour_id AND n.business = t.business
          WHERE s.neighbour_id <> t.node_id)
    WHERE rn <= 10 GROUP BY 1, 2""", "sided", "sims", "train")


def same_business_neighbours(flow):
    """The ten most similar other training nodes per own (node, business) pair."""
    asked = flow.sided.select("node_id", "business").join(flow.vectors, "node_id")
    known = flow.train.select("node_id", "business", "cum_cost_7d").join(flow.vectors, "node_id")
    return knn.nearest(asked, known, flow.settings.knn_feature_k, flow.space, group="business", exclude_self=True, carry="cum_cost_7d")


@query("q_j16_same_business_neighbours", SAME_BUSINESS)
def j16(spark, sf):
    flow = flow_of(spark, sf)
    costs = candidates.neighbour_features(same_business_neighbours(flow), flow.train, flow.settings.similarity_power, count="n")
    return costs.select("business", "node_id", F.round("neighbour_cost", 4).alias("neighbour_cost"), "n")


@query("q_j17_different_key_names", twin("""
    SELECT node_id, business, cap_bw FROM totals
    JOIN (SELECT CAST(o_custkey AS VARCHAR) AS nodeId, max(l_quantity) AS cap_bw
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON nodeId = node_id""", "totals"))
def j17(spark, sf):
    widest = reports.node_bandwidth(tables.build_bandwidth(spark, sf))
    return reports.unit_yield(tables.ledger_totals(spark, sf), widest).select("node_id", "business", "cap_bw")


PAIR_BW = """(SELECT CAST(o_custkey AS VARCHAR) AS node_id, p_brand AS business, median(l_quantity) AS cap_bw
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


@query("q_j18_pair_capacity", twin(f"""
    SELECT node_id, business, cap_bw, round(cum_cost_7d / nullif(cap_bw, 0), 4) AS unit_cost
    FROM totals JOIN {PAIR_BW} USING (node_id, business)""", "totals"))
def j18(spark, sf):
    pair = reports.pair_bandwidth(tables.build_bandwidth(spark, sf))
    return reports.unit_yield(tables.ledger_totals(spark, sf), pair).select(
        "node_id", "business", "cap_bw", F.round("unit_cost", 4).alias("unit_cost"))


@query("q_j19_recs_left_current", twin("""
    SELECT w.node_id, top1, coalesce(n_days, 0) AS n_days FROM wide_off w
    LEFT JOIN (SELECT node_id, count(DISTINCT day) AS n_days FROM daily GROUP BY 1) USING (node_id)""",
                                   "wide_off", "daily"))
def j19(spark, sf):
    days = tables.daily_settlement(spark, sf).groupBy("node_id").agg(F.count_distinct("day").alias("n_days"))
    wide = ranking.widen(flow_of(spark, sf).recs("score_off"))
    return wide.join(days, "node_id", "left").select("node_id", F.col("top1_business").alias("top1"),
                                                     F.coalesce("n_days", F.lit(0)).alias("n_days"))


# -- set operations ------------------------------------------------------------------------------------------

@query("q_u01_union_all", twin("""
    SELECT node_id, count(*) AS n_rows FROM (SELECT node_id FROM daily UNION ALL SELECT node_id FROM totals)
    GROUP BY 1""", "daily", "totals"))
def u01(spark, sf):
    daily = tables.daily_settlement(spark, sf).select("node_id")
    return daily.unionByName(tables.ledger_totals(spark, sf).select("node_id")).groupBy("node_id").agg(
        F.count("*").alias("n_rows"))


@query("q_u02_candidate_union", twin("SELECT node_id, business FROM cand", "cand"))
def u02(spark, sf):
    return flow_of(spark, sf).candidate_pairs


@query("q_u03_id_set_operations", twin("""
    SELECT 'both' AS part, count(*) AS n FROM (SELECT node_id FROM daily INTERSECT SELECT node_id FROM totals)
    UNION ALL SELECT 'only_totals', count(*) FROM (SELECT node_id FROM totals EXCEPT SELECT node_id FROM daily)""",
                                       "daily", "totals"))
def u03(spark, sf):
    daily = tables.daily_settlement(spark, sf).select("node_id")
    totals = tables.ledger_totals(spark, sf).select("node_id")
    both, only = daily.intersect(totals), totals.subtract(daily)
    return both.agg(F.lit("both").alias("part"), F.count("*").alias("n")).unionByName(
        only.agg(F.lit("only_totals").alias("part"), F.count("*").alias("n")))


@query("q_u04_category_domain", twin("""
    SELECT DISTINCT field, value FROM (
        SELECT node_id, 'segment' AS field, segment AS value FROM attrs UNION ALL
        SELECT node_id, 'nation', nation FROM attrs UNION ALL SELECT node_id, 'region', region FROM attrs)
    WHERE node_id IN (SELECT node_id FROM split)""", "attrs", "split"))
def u04(spark, sf):
    flow = flow_of(spark, sf)
    sides = [flow.attrs.join(flow.split.where(c).select("node_id"), "node_id", "left_semi")
             for c in ("is_test", "NOT is_test")]
    return models.category_domain(sides, tables.CATS)


@query("q_u05_key_union_of_counts", twin("""
    SELECT business, coalesce(a, 0) AS n_train, coalesce(b, 0) AS n_test
    FROM (SELECT business, count(*) AS a FROM train GROUP BY 1)
    FULL JOIN (SELECT business, count(*) AS b FROM test GROUP BY 1) USING (business)""",
                                         "train", "test"))
def u05(spark, sf):
    flow = flow_of(spark, sf)
    a = flow.train.groupBy("business").agg(F.count("*").alias("a"))
    b = flow.test.groupBy("business").agg(F.count("*").alias("b"))
    return a.join(b, "business", "full_outer").select("business", F.coalesce("a", F.lit(0)).alias("n_train"),
                                                      F.coalesce("b", F.lit(0)).alias("n_test"))


# -- sorts, limits, sampling ---------------------------------------------------------------------------------

@query("q_o01_two_key_order", twin("""
    SELECT node_id, business, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY cost_norm + profit_pen DESC, pred_cost DESC,
                                     business) AS rank FROM penalised) WHERE rank <= 3""", "penalised"))
def o01(spark, sf):
    scored = scoring.score_full_pool(flow_of(spark, sf).predicted)
    order = [F.desc("soft_score"), F.desc("pred_cost"), F.asc("business")]
    return ranking.top_k(scored, "node_id", order, 3).select("node_id", "business", "rank")


@query("q_o02_pool_in_id_order", twin("""
    SELECT business, row_number() OVER (ORDER BY business) AS place FROM pool""", "pool"))
def o02(spark, sf):
    pool = flow_of(spark, sf).pool.select("business", F.lit(0.0).alias("score"))
    return baselines.ranked_pool(pool).orderBy("business").select("business", "place")


FALLBACK = twin("""
    SELECT n.node_id, p.business FROM (SELECT node_id FROM attrs WHERE node_id NOT IN (SELECT node_id FROM daily)) n,
        (SELECT business FROM pool WHERE business <> 'Brand#1' ORDER BY business LIMIT 3) p
    UNION ALL SELECT DISTINCT node_id, business FROM daily""", "attrs", "daily", "pool")


@query("q_o03_empty_candidate_fallback", FALLBACK)
def o03(spark, sf):
    flow = flow_of(spark, sf)
    own = tables.daily_settlement(spark, sf).select("node_id", "business").distinct()
    gated = flow.pool.where("business = 'Brand#1'").select("business")
    fallback = candidates.fallback_businesses(flow.pool, gated)
    return candidates.with_fallback(tables.node_keys(spark, sf), own, fallback).select("node_id", "business")


@query("q_o04_global_top_n", """
    SELECT p_brand || ' ' || p_name AS label, count(*) AS n_nodes FROM part GROUP BY 1 ORDER BY n_nodes DESC, label
    LIMIT 12""")
def o04(spark, sf):
    parts = tables.table(spark, sf, "part").select(display_label("p_brand", "p_name").alias("label"))
    return ranking.top_businesses(parts, 12, "label")


@query("q_o05_seeded_sample", twin("""
    SELECT node_id, n_businesses FROM (
        SELECT node_id, count(DISTINCT business) AS n_businesses FROM totals
        WHERE node_id IN (SELECT node_id FROM attrs) GROUP BY 1 HAVING count(DISTINCT business) >= 2)
    ORDER BY md5('20260909|' || node_id), node_id LIMIT 350""", "totals", "attrs"))
def o05(spark, sf):
    flow = flow_of(spark, sf)
    return split.seeded_sample(flow.totals, tables.node_keys(spark, sf), 350, flow.settings.sample_seed)
