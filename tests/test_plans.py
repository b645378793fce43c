"""End-to-end plans on small derived data, and registered queries against their SQL twins."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from settlerank.config import FIRST_GENERATION, SECOND_GENERATION, Settings
from settlerank.operators import checks, evaluation, models
from settlerank.plans.catalog import CATALOG
from settlerank.plans.recommend import Recommender
from twin_check import compare, duck

SF = "/root/testdata/sf0.01"
SOME = ["q_p15", "q_f04", "q_f08", "q_j13", "q_j16", "q_a01_", "q_a05", "q_a17", "q_a18", "q_a19", "q_w05", "q_w06",
        "q_w07", "q_w08", "q_w12", "q_w14", "q_m05", "q_m06", "q_m16", "q_m18_m21", "q_o03", "q_s03", "q_s07", "q_q03"]
CHOSEN = [n for n in CATALOG if CATALOG[n].sql and (os.environ.get("TWINS") == "all" or any(s in n for s in SOME))]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_twin(spark, con, name):
    ok, message, _ = compare(spark, con, CATALOG[name], SF)
    assert ok, message


def small_inputs(spark, n=400):
    """A ledger whose cost depends on a category and a number, so that a model can learn it."""
    nodes = spark.range(n).select(
        F.format_string("n%04d", "id").alias("node_id"), (F.col("id") % 4).cast("string").alias("province"),
        (F.col("id") % 3).cast("string").alias("isp"), (F.col("id") % 50 + 1).cast("double").alias("bw"),
        F.date_add(F.lit("2026-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("online_day"))
    pairs = nodes.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(4)))).where(
        F.pmod(F.xxhash64("node_id", "b"), F.lit(3)) != 0)
    cost = F.col("bw") * (F.col("b") + 1) + F.when(F.col("province") == "2", 200).otherwise(0)
    ledger = pairs.select("node_id", F.concat(F.lit("b"), "b").alias("business"), F.concat(F.lit("name"), "b").alias(
        "business_name"), "online_day", F.lit(7).alias("outcome_days"), cost.alias("cum_cost_7d"),
        (cost * F.when(F.col("b") == 4, 0.8).otherwise(1.3)).alias("cum_revenue_7d"))
    return ledger, nodes.select("node_id", "province", "isp", "bw")


@pytest.fixture(scope="module")
def plan(spark):
    ledger, attrs = small_inputs(spark)
    return Recommender(ledger, attrs, replace(FIRST_GENERATION, n_trees=15, knn_k=5, learning_rate=0.3),
                       cats=("province", "isp"), nums=("bw",))


def test_recommendations_keep_their_invariants(plan):
    recs = plan.recs
    per_node = recs.groupBy("node_id").agg(F.count("*").alias("n"), F.max("rank").alias("m"),
                                           F.count_distinct("business").alias("d")).collect()
    assert len(per_node) == plan.split.count() and all(r.n == r.m == r.d and 1 <= r.n <= 3 for r in per_node)
    assert recs.join(plan.pool, "business", "left_anti").count() == 0
    metrics = plan.metrics().first()
    assert metrics.hit_at_1 <= metrics.hit_at_3 and metrics.train_nodes + metrics.test_nodes == len(per_node)
    assert metrics.wape < 0.4 and metrics.r2 > 0.5
    verdict = {r.check: r.ok for r in plan.acceptance().collect()}
    assert verdict["wape"] == 1 and verdict["test_nodes"] == 0 and len(verdict) == 8


def test_data_readiness(spark):
    ledger, attrs = small_inputs(spark, 50)
    got = {r.check: (r.actual, r.ok) for r in checks.data_readiness(ledger, attrs, ledger_floor=10).collect()}
    assert got["ledger_missing_columns"] == (0, 1) and got["attrs_missing_columns"] == (12, 0)
    assert got["ledger_full_rows"][1] == 1 and got["attrs_rows"] == (50, 0)


def test_models_beat_the_mean_and_log_target_stays_positive(plan):
    rows = plan.training_rows
    train = rows.where(~F.col("is_test"))
    mean = train.agg(F.avg("cum_cost_7d")).first()[0]
    base = evaluation.regression_error(train.withColumn("p", F.lit(mean)), "cum_cost_7d", "p").first()
    cost = plan.amount_models["cost"].predict(train, "p")
    assert evaluation.regression_error(cost, "cum_cost_7d", "p").first().wape < base.wape
    logged = models.fit_amount(train, "cum_cost_7d", ["province", "isp"], ["bw", "biz_prior"],
                               replace(FIRST_GENERATION, n_trees=5), log_target=True)
    assert logged.predict(rows, "p").where("p < 0 OR p IS NULL").count() == 0
    tree = plan.amount_models["cost"].pipeline.stages[-1].toDebugString
    assert " in {" in tree                                       # categories split as sets


def test_second_generation_and_ablation(spark):
    ledger, attrs = small_inputs(spark, 200)
    mixed = ledger.withColumn("node_id", F.when(F.col("business") == "b3", F.concat(F.lit("ant"), "node_id"))
                              .otherwise(F.col("node_id")))
    quick = replace(SECOND_GENERATION, n_trees=3, knn_k=3, min_support=5)
    plan = Recommender(ledger, attrs, quick, gate_ledger=mixed, cats=("province", "isp"), nums=("bw",),
                       family_rules=(("name0", "FAM"), ("name1", "FAM")))
    shown = {r.business for r in plan.recs.select("business").distinct().collect()}
    assert "b3" not in shown and "b0" not in shown and "FAM" in shown
    wide = Recommender(ledger, attrs, replace(FIRST_GENERATION, n_trees=3, knn_k=3, min_support=5),
                       cats=("province", "isp"), nums=("bw",), neighbour_features=True, log_cost=True, all_nodes=False,
                       skip_empty=True)
    assert wide.recs.select("node_id").distinct().count() == wide.split.where("is_test").count()
    assert wide.training_rows.where("neighbour_cost IS NULL").count() == 0
    assert isinstance(wide.settings, Settings)
