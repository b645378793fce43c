"""M01-M24 similarity, candidates, scores, baselines and learned models."""

from dataclasses import replace

from pyspark.sql import functions as F

from settlerank.config import COLDSTART, FIRST_GENERATION, Settings
from settlerank.operators import candidates, evaluation, knn, lsh, models, ranking, scoring
from settlerank.operators.encoder import AttributeEncoder, fold_rare, rare_values
from settlerank.operators.percentiles import long_values
from settlerank.plans.catalog.joins import EMBEDDING_NEAR, SAME_BUSINESS, same_business_neighbours
from settlerank.plans.coldstart import sales_coldstart
from settlerank.plans.flow import flow_of
from settlerank.plans.recommend import Recommender
from settlerank.plans.registry import query
from settlerank.plans.twins import twin
from settlerank.session import cut_lineage
from settlerank.sources import tables

#: All trees of the library are allowed; a larger step and less patience let early stopping end the fits sooner.
QUICK = replace(FIRST_GENERATION, learning_rate=0.3, patience=10, full_window_days=1)
_PLANS: dict[tuple, object] = {}


def recommender(spark, sf, settings: Settings = QUICK, **options) -> Recommender:
    """The end-to-end plan over the sales tables, one per application and option set."""
    key = (spark.sparkContext.applicationId, sf, settings, tuple(sorted(options.items())))
    if key not in _PLANS:
        flow = flow_of(spark, sf)
        _PLANS[key] = Recommender(flow.totals, flow.attrs, settings, flow.capacity, flow.stored_peaks, flow.totals,
                                  tuple(tables.CATS), tuple(tables.NUMS), nominal="n_orders", **options)
    return _PLANS[key]


def coldstart(spark, sf, settings: Settings = COLDSTART):
    key = ("coldstart", spark.sparkContext.applicationId, sf, settings)
    if key not in _PLANS:
        _PLANS[key] = sales_coldstart(spark, sf, settings)
    return _PLANS[key]


def forget_plans() -> None:
    _PLANS.clear()


# -- encoding ------------------------------------------------------------------------------------------------

@query("q_m01_rare_categories", """
    WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS node_id, c_mktsegment || '-' || c_nationkey || '-'
                      || CAST(floor(c_acctbal / 500) AS INT) AS cell, c_mktsegment AS segment FROM customer)
    SELECT node_id, CASE WHEN count(*) OVER (PARTITION BY cell) < 2 THEN '__RARE__' ELSE cell END AS cell,
           CASE WHEN count(*) OVER (PARTITION BY segment) < 2 THEN '__RARE__' ELSE segment END AS segment FROM c""")
def m01(spark, sf):
    cell = F.concat_ws("-", "c_mktsegment", "c_nationkey", F.floor(F.col("c_acctbal") / 500).cast("int"))
    attrs = tables.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("node_id"),
                                                       cell.alias("cell"), F.col("c_mktsegment").alias("segment"))
    return fold_rare(attrs, ["cell", "segment"], rare_values(attrs, ["cell", "segment"])).select(
        "node_id", "cell", "segment")


@query("q_m02_median_imputation", twin("SELECT node_id, field, round(v, 6) AS v FROM imputed", "imputed"))
def m02(spark, sf):
    attrs = tables.node_attributes(spark, sf)
    medians = AttributeEncoder(tables.CATS, tables.NUMS).fit(attrs).medians
    filled = attrs.select("node_id", *[F.coalesce(F.when(F.col(c) > 0, F.col(c)), F.lit(m)).alias(c)
                                       for c, m in medians.items()])
    return long_values(filled, list(medians), ["node_id"]).select("node_id", "field", F.round("value", 6).alias("v"))


@query("q_m03_quantile_knots", twin("SELECT field, i, round(q, 6) AS q FROM knots", "knots"))
def m03(spark, sf):
    attrs = tables.node_attributes(spark, sf)
    knots = AttributeEncoder(tables.CATS, tables.NUMS).fit(attrs).knots
    rows = [(c, i, float(q)) for c, values in knots.items() for i, q in enumerate(values)]    # 500 per column
    return spark.createDataFrame(rows, "field string, i long, q double").select(
        "field", "i", F.round("q", 6).alias("q"))


@query("q_m04_node_vectors", twin("""
    SELECT node_id, segment || '|' || nation || '|' || region AS codes, round(u1, 6) AS u1, round(u2, 6) AS u2,
           round(u3, 6) AS u3 FROM vectors""", "vectors"))
def m04(spark, sf):
    vectors = flow_of(spark, sf).vectors
    return vectors.select("node_id", F.array_join("codes", "|").alias("codes"), *[
        F.round(F.element_at("numbers", i), 6).alias(f"u{i}") for i in (1, 2, 3)])


@query("q_m05_pair_similarity", twin("""
    SELECT a.node_id, b.node_id AS other_id,
           round((0.65 * (CAST(a.segment = b.segment AS INT) + CAST(a.nation = b.nation AS INT)
                          + CAST(a.region = b.region AS INT)) / 3.0
                  + 0.35 * (a.u1 * b.u1 + a.u2 * b.u2 + a.u3 * b.u3))
                 / (sqrt(0.65 + 0.35 * CAST(a.len > 0 AS INT)) * sqrt(0.65 + 0.35 * CAST(b.len > 0 AS INT))), 6)
           AS similarity
    FROM vectors a JOIN vectors b ON CAST(b.node_id AS BIGINT) = CAST(a.node_id AS BIGINT) + 1""", "vectors"))
def m05(spark, sf):
    v = flow_of(spark, sf).vectors
    a = v.select("node_id", F.col("codes").alias("a_codes"), F.col("numbers").alias("a_numbers"),
                 (F.col("node_id").cast("long") + 1).alias("k"))
    b = v.select(F.col("node_id").alias("other_id"), F.col("codes").alias("b_codes"),
                 F.col("numbers").alias("b_numbers"), F.col("node_id").cast("long").alias("k"))
    return knn.pair_similarity(a.join(b, "k")).select("node_id", "other_id",
                                                      F.round("similarity", 6).alias("similarity"))


@query("q_m06_nearest_training_nodes", twin("""
    SELECT node_id, neighbour_id, rank, round(similarity, 6) AS similarity FROM near""", "near"))
def m06(spark, sf):
    return flow_of(spark, sf).near.select("node_id", "neighbour_id", "rank",
                                          F.round("similarity", 6).alias("similarity"))


@query("q_m06_hyperplane_neighbours", """
    SELECT count(*) AS queries, 15 * count(*) AS wanted, TRUE AS recall_reached FROM embeddings WHERE embedding IS NOT NULL""")
def m06_planes(spark, sf):
    """The 15 nearest of every vector by hyperplane tables, held against the exact ones."""
    vectors = cut_lineage(knn.dense_vectors(tables.table(spark, sf, "embeddings"), "vec_id", "embedding"))
    found = knn.nearest(vectors, vectors, 15, method="lsh")
    measured = lsh.recall_of(found, knn.nearest(vectors, vectors, 15))
    return measured.select("queries", "wanted", (F.col("recall") >= 0.9).alias("recall_reached"))


@query("q_m06_pruned_dense_neighbours", EMBEDDING_NEAR)
def m06_pruned(spark, sf):
    """The same search with many cells and small chunks, as it runs on large inputs."""
    vectors = knn.dense_vectors(tables.table(spark, sf, "embeddings"), "vec_id", "embedding")
    near = knn.nearest(vectors, vectors, 15, n_cells=12, query_chunk=32, train_chunk=100)
    return near.select("node_id", "neighbour_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("q_m07_candidates", twin("""
    SELECT node_id, string_agg(business, '|' ORDER BY business) AS cand, count(*) AS n_cand FROM cand GROUP BY 1""",
                                "cand"))
def m07(spark, sf):
    return candidates.candidate_lists(flow_of(spark, sf).candidates)


# -- features ------------------------------------------------------------------------------------------------

@query("q_m08_feature_frame", twin("""
    SELECT t.node_id, t.business, coalesce(segment, '__UNK__') AS segment, coalesce(acctbal, 0) AS acctbal,
           coalesce(n_orders, 0) AS n_orders, round(coalesce(cost_mean_log, 0), 6) AS cost_mean_log,
           round(coalesce(cost_p90_log, 0), 6) AS cost_p90_log,
           round(coalesce(profit_mean_log, 0), 6) AS profit_mean_log, round(coalesce(support_log, 0), 6) AS support_log,
           round(coalesce(cost_mean, (SELECT avg(cost_mean) FROM stats)), 4) AS biz_prior
    FROM (SELECT node_id, business FROM totals UNION ALL SELECT DISTINCT node_id, business FROM daily) t
    LEFT JOIN attrs USING (node_id) LEFT JOIN stats s ON s.business = t.business""",
                                   "totals", "daily", "attrs", "stats"))
def m08(spark, sf):
    flow = flow_of(spark, sf)
    pairs = flow.totals.select("node_id", "business").unionByName(
        tables.daily_settlement(spark, sf).select("node_id", "business").distinct())
    frame = models.feature_frame(pairs, flow.attrs, flow.stats, tables.CATS, tables.NUMS)
    return frame.select("node_id", "business", "segment", "acctbal", "n_orders", *[
        F.round(c, 6).alias(c) for c in models.STATS], F.round("biz_prior", 4).alias("biz_prior"))


@query("q_m09_labelled_features", twin("""
    SELECT s.node_id, s.business, CAST(is_test AS INT) AS is_test, round(biz.cost_mean, 4) AS biz_prior,
           round(cum_cost_7d, 4) AS cum_cost_7d, round(cum_revenue_7d, 4) AS cum_revenue_7d
    FROM sided s JOIN pool biz USING (business)""", "sided", "pool"))
def m09(spark, sf):
    flow = flow_of(spark, sf)
    rows = ranking.restrict_to_pool(flow.sided, flow.pool)
    frame = models.feature_frame(rows.select("node_id", "business", "is_test"), flow.attrs, flow.stats, tables.CATS,
                                 tables.NUMS)
    return models.labelled(frame, flow.sided).select(
        "node_id", "business", F.col("is_test").cast("int").alias("is_test"), F.round("biz_prior", 4).alias("biz_prior"),
        F.round("cum_cost_7d", 4).alias("cum_cost_7d"), F.round("cum_revenue_7d", 4).alias("cum_revenue_7d"))


@query("q_m10_amount_models")
def m10(spark, sf):
    """Errors of the cost, revenue and profit models on the test pairs."""
    plan = recommender(spark, sf)
    fitted = {**plan.amount_models, "revenue": plan.revenue_model()}
    rows = [evaluation.regression_error(m.predict(plan.training_rows.where("is_test"), "predicted"), m.target,
                                        "predicted").withColumn("target", F.lit(name)) for name, m in fitted.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("q_m11_early_stopping")
def m11(spark, sf):
    """Trees kept by early stopping on the training slice, beside the allowed number."""
    plan = recommender(spark, sf)
    rows = plan.training_rows.where(~F.col("is_test"))
    model = models.fit_amount(rows, "cum_cost_7d", tables.CATS, [*tables.NUMS, *models.STATS, "biz_prior"], QUICK,
                              domain=plan.training_rows.select(*tables.CATS))
    kept = model.pipeline.stages[-1].getNumTrees
    return rows.agg(F.count("*").alias("n_rows")).withColumn("trees_kept", F.lit(kept)).withColumn(
        "trees_allowed", F.lit(QUICK.n_trees))


@query("q_m12_log_target")
def m12(spark, sf):
    """Per test pair: the cost predicted through a log target, never negative."""
    plan = recommender(spark, sf)
    rows = plan.training_rows
    model = models.fit_amount(rows.where(~F.col("is_test")), "cum_cost_7d", tables.CATS,
                              [*tables.NUMS, *models.STATS, "biz_prior"], QUICK, log_target=True,
                              domain=rows.select(*tables.CATS))
    return model.predict(rows.where("is_test"), "pred_cost").select("node_id", "business", "cum_cost_7d", "pred_cost")


@query("q_m13_neighbour_features", SAME_BUSINESS.replace("count(*) AS n\n", "min(support_log) AS neighbour_support_log\n")
       .replace("FROM (SELECT t.node_id", """FROM (SELECT
                 round(ln(1 + (SELECT count(*) FROM train p WHERE p.business = t.business)
                          - CAST(NOT t.is_test AS INT)), 6) AS support_log, t.node_id"""))
def m13(spark, sf):
    flow = flow_of(spark, sf)
    near = same_business_neighbours(flow)
    costs = cut_lineage(candidates.neighbour_features(near, flow.train, flow.settings.similarity_power), "neighbour-costs", "zstd")
    peers = candidates.peer_counts(flow.sided.select("node_id", "business"), flow.train)
    return costs.join(peers, ["business", "node_id"]).select(
        "business", "node_id", F.round("neighbour_cost", 4).alias("neighbour_cost"),
        F.round("neighbour_support_log", 6).alias("neighbour_support_log"))


# -- scores --------------------------------------------------------------------------------------------------

@query("q_m14_full_pool_score", twin("""
    SELECT node_id, business, round(cost_norm + profit_pen, 6) AS soft_score,
           CAST(pred_profit > 0 AND profit_p10 > 0 AS INT) AS eligible FROM penalised""", "penalised"))
def m14(spark, sf):
    scored = scoring.score_full_pool(flow_of(spark, sf).predicted)
    return scored.select("node_id", "business", F.round("soft_score", 6).alias("soft_score"), "eligible")


@query("q_m15_capacity_score", twin("""
    SELECT node_id, business, round(pred_cost + profit_pen + cap_pen, 4) AS score FROM scored""", "scored"))
def m15(spark, sf):
    flow = flow_of(spark, sf)
    return scoring.score_v1(flow.predicted, flow.capacity).select("node_id", "business",
                                                                  F.round("score", 4).alias("score"))


@query("q_m16_aux_score", twin("""
    SELECT node_id, business, round(bw_aux, 6) AS bw_aux, round(score_off, 4) AS score_off,
           round(score_on, 4) AS score_on FROM onoff""", "onoff"))
def m16(spark, sf):
    return flow_of(spark, sf).on_off.select("node_id", "business", F.round("bw_aux", 6).alias("bw_aux"),
                                            *[F.round(c, 4).alias(c) for c in ("score_off", "score_on")])


@query("q_m17_second_score", twin("""
    SELECT node_id, business, round(pred_cost + profit_pen + 0.1 * coalesce(peak_mbps / top_peak, 0) * cost_norm, 4)
           AS score_on, round(pred_cost + profit_pen, 4) AS score_off
    FROM (SELECT p.*, peak_mbps, max(peak_mbps) OVER (PARTITION BY node_id) AS top_peak
          FROM penalised p LEFT JOIN peaks USING (node_id, business))""", "penalised", "peaks"))
def m17(spark, sf):
    flow = flow_of(spark, sf)
    return scoring.score_v2(flow.predicted, flow.peaks).select(
        "node_id", "business", *[F.round(c, 4).alias(c) for c in ("score_on", "score_off")])


@query("q_m17_legacy_switch", twin("""
    SELECT node_id, business, round(pred_cost + profit_pen + cap_pen, 4) AS score_on FROM scored""", "scored"))
def m17_legacy(spark, sf):
    flow = flow_of(spark, sf)
    legacy = scoring.score_v2(flow.predicted, flow.peaks, replace(flow.settings, legacy_score=True), flow.capacity)
    return legacy.select("node_id", "business", F.round("score_on", 4).alias("score_on"))


# -- baselines -------------------------------------------------------------------------------------------------

COLD = """
    ,cpool AS (SELECT * FROM stats WHERE support >= 30),
    ctrain AS (SELECT * FROM train WHERE business IN (SELECT business FROM cpool)),
    cprior AS (SELECT business, avg(cum_cost_7d) AS prior FROM ctrain GROUP BY 1),
    ctruth AS (SELECT * FROM truth WHERE true_best IN (SELECT business FROM cpool)),
    cseg AS (SELECT seg, business, count(*) AS n, sum(cum_cost_7d) AS s FROM ctrain JOIN segs USING (node_id)
             GROUP BY 1, 2)"""
RANKED = """
    SELECT node_id, business, rank, round(score, 4) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, business) AS rank FROM ({scores}))
    WHERE rank <= 3"""
GLOBAL_SCORES = "SELECT node_id, business, support AS score FROM ctruth, cpool"
PRIOR_SCORES = "SELECT node_id, business, prior AS score FROM ctruth, cprior"
SEGMENT_SCORES = """SELECT t.node_id, p.business, CASE WHEN n >= 3 THEN s ELSE prior END AS score
    FROM ctruth t JOIN segs ON segs.node_id = t.node_id CROSS JOIN cprior p
    LEFT JOIN cseg g ON g.seg = segs.seg AND g.business = p.business"""
KNN_SCORES = """SELECT t.node_id, p.business, coalesce(v, prior) AS score FROM ctruth t CROSS JOIN cprior p LEFT JOIN (
        SELECT near.node_id, business, sum(greatest(similarity, 0) * cum_cost_7d)
               / nullif(sum(greatest(similarity, 0)), 0) AS v
        FROM near JOIN ctrain ON ctrain.node_id = neighbour_id WHERE rank <= 10 GROUP BY 1, 2) k
    ON k.node_id = t.node_id AND k.business = p.business"""


def ranked_rows(df):
    return df.select("node_id", "business", F.col("rank").cast("int").alias("rank"),
                     F.round(F.col("score").cast("double"), 4).alias("score"))


@query("q_m18_popularity_baseline", twin(COLD + RANKED.format(scores=GLOBAL_SCORES), "stats", "train", "truth", "segs"))
def m18(spark, sf):
    return ranked_rows(coldstart(spark, sf).popularity())


@query("q_m19_prior_baseline", twin(COLD + RANKED.format(scores=PRIOR_SCORES), "stats", "train", "truth", "segs"))
def m19(spark, sf):
    return ranked_rows(coldstart(spark, sf).business_prior())


@query("q_m20_segment_baseline", twin(COLD + RANKED.format(scores=SEGMENT_SCORES), "stats", "train", "truth", "segs"))
def m20(spark, sf):
    return ranked_rows(coldstart(spark, sf).by_segment())


@query("q_m20_segment_mean_baseline", twin(COLD + RANKED.format(scores=SEGMENT_SCORES.replace("THEN s ELSE", "THEN s / n ELSE")),
                                           "stats", "train", "truth", "segs"))
def m20_mean(spark, sf):
    return ranked_rows(coldstart(spark, sf).by_segment("mean"))


@query("q_m21_knn_baseline", twin(COLD + RANKED.format(scores=KNN_SCORES), "stats", "train", "truth", "segs", "near"))
def m21(spark, sf):
    return ranked_rows(coldstart(spark, sf).by_neighbours())


COLD_METRICS = COLD + ",\n    ranked AS (" + "\n    UNION ALL ".join(
    f"SELECT '{m}' AS method, * FROM ({RANKED.format(scores=s)})" for m, s in (
        ("global", GLOBAL_SCORES), ("biz_prior", PRIOR_SCORES), ("segment", SEGMENT_SCORES), ("knn", KNN_SCORES))) + """)
    SELECT method, count(*) AS n, round(avg(h1), 4) AS hit_at_1, round(avg(h3), 4) AS hit_at_3 FROM (
        SELECT method, node_id, max(CAST(business = true_best AND rank = 1 AS INT)) AS h1,
               max(CAST(business = true_best AS INT)) AS h3 FROM ranked JOIN ctruth USING (node_id) GROUP BY 1, 2)
    GROUP BY 1"""


@query("q_m18_m21_coldstart_metrics", twin(COLD_METRICS, "stats", "train", "truth", "segs", "near"))
def cold_metrics(spark, sf):
    return coldstart(spark, sf).metrics(("global", "biz_prior", "segment", "knn"))


@query("q_m22_model_baseline")
def m22(spark, sf):
    return ranked_rows(coldstart(spark, sf, replace(COLDSTART, learning_rate=0.3, patience=10)).by_model())


@query("q_m22_signature_scoring", twin(COLD + """
    SELECT 3 * count(*) AS ranked_rows, 3 * count(*) AS equal_rows, TRUE AS no_more_than_pairs FROM ctruth""",
                                      "stats", "train", "truth", "segs"))
def m22_signatures(spark, sf):
    """The model's ranking from scored signatures, held against scoring every pair."""
    plan = coldstart(spark, sf, replace(COLDSTART, learning_rate=0.3, patience=10))
    found, pairs = cut_lineage(plan.by_model(), "signature-ranking"), plan.by_model_pairs()    # read twice
    keys = ["node_id", "rank", "business", "score"]
    sizes = plan.signature_pool.sizes()
    fewer = sizes["pairs_scored"] <= sizes["nodes"] * plan.support.count()
    equal = found.select(*keys).join(pairs.select(*keys), keys, "left_semi").agg(F.count("*").alias("equal_rows"))
    return found.agg(F.count("*").alias("ranked_rows")).join(equal, F.lit(True)).withColumn("no_more_than_pairs", F.lit(fewer))


# -- end to end ------------------------------------------------------------------------------------------------

@query("q_m23_wide_recommendations", twin("""
    SELECT node_id, top1 AS top1_business, top2 AS top2_business, top3 AS top3_business,
           round(cost1, 2) AS top1_pred_cost, round(profit1, 2) AS top1_pred_profit,
           CAST(profit1 > 0 AS INT) AS top1_profit_positive FROM wide_off""", "wide_off"))
def m23(spark, sf):
    wide = ranking.widen(flow_of(spark, sf).recs("score_off"))
    return wide.select("node_id", *[f"top{i}_business" for i in (1, 2, 3)], "top1_pred_cost", "top1_pred_profit",
                       "top1_profit_positive")


@query("q_m23_end_to_end_recommendations")
def m23_full(spark, sf):
    """Learned amounts, all nodes, first-generation score."""
    return recommender(spark, sf).recs


@query("q_m23_second_generation")
def m23_v2(spark, sf):
    """Non-prefix nodes, families merged, gate on, bandwidth term in the score; the metrics row."""
    settings = replace(QUICK, generation=2, pool_side="non1", pool_prefix="1", merge_families=True, gate=True)
    return recommender(spark, sf, settings, family_rules=(("Brand#1", "FAM1"), ("Brand#2", "FAM2"))).metrics()


@query("q_m23_full_pool_recommendations")
def m23_pool(spark, sf):
    """The whole pool ranked for test nodes with the first-rank profit gate."""
    return recommender(spark, sf, replace(QUICK, min_support=30)).full_pool()


@query("q_m24_compare_variants")
def m24(spark, sf):
    """Hit rates on test nodes: direct cost model against neighbour features with a log target."""
    first = recommender(spark, sf)
    second = recommender(spark, sf, neighbour_features=True, log_cost=True, all_nodes=False, skip_empty=True)
    both = first.recs.withColumn("variant", F.lit("direct")).unionByName(
        second.recs.withColumn("variant", F.lit("log_neighbour")))
    return evaluation.hit_rates(evaluation.hits(both, first.truth, keys=("variant",)), ("variant",))


__all__ = ["recommender", "coldstart", "forget_plans"]
