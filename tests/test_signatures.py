"""Scoring by signature against scoring all pairs, and trees walked by hand against the model's predictions."""

import math
import re
from dataclasses import replace

import pytest
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from settlerank.config import COLDSTART
from settlerank.operators.models import first_trees
from settlerank.plans.catalog.recommend import QUICK, recommender
from settlerank.plans.coldstart import sales_coldstart

SF = "/root/testdata/sf0.001"
FAST = {"learning_rate": 0.3, "patience": 5, "n_trees": 40}


@pytest.fixture(scope="module")
def cold(spark):
    return sales_coldstart(spark, SF, replace(COLDSTART, min_support=5, **FAST))


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()))


def test_model_ranking_equals_all_pairs(cold):
    by_signature, by_pair = rows(cold.by_model()), rows(cold.by_model_pairs())
    assert by_signature == by_pair and len(by_pair) > 0
    sizes = cold.signature_pool.sizes()
    assert sizes["pairs_scored"] <= sizes["nodes"] * cold.support.count()


def test_full_pool_equals_all_pairs(spark):
    plan = recommender(spark, SF, replace(QUICK, min_support=5, n_trees=40))
    assert rows(plan.full_pool()) == rows(plan.full_pool_pairs())


def test_few_thresholds_need_few_pairs(spark):
    plan = sales_coldstart(spark, SF, replace(COLDSTART, min_support=5, n_trees=1, max_depth=1))
    sizes = plan.signature_pool.sizes()
    assert sizes["pairs_scored"] <= 4 and rows(plan.by_model()) == rows(plan.by_model_pairs())


def walk(lines, x):
    """The value of one printed tree for the feature vector."""
    at = 0
    while True:
        text = lines[at].strip()
        if text.startswith("Predict:"):
            return float(text.split(":")[1])
        number = re.match(r"(If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", text)
        if number:
            value, limit = x[int(number[2])], float(number[4])
            true = value <= limit if number[3] == "<=" else value > limit
        else:
            inside = re.match(r"(If|Else) \(feature (\d+) (in|not in) \{([^}]*)\}\)", text)
            true = (x[int(inside[2])] in {float(v) for v in inside[4].split(",")}) == (inside[3] == "in")
        if not true:                                          # skip the branch: on to the line of the same depth
            depth = len(lines[at]) - len(lines[at].lstrip())
            at += 1
            while len(lines[at]) - len(lines[at].lstrip()) > depth:
                at += 1
        else:
            at += 1


def walked(model, x):
    blocks = re.split(r"\n\s*Tree \d+ \(weight ([-\d.eE]+)\):\n", model.toDebugString)
    return sum(float(w) * walk(b.split("\n"), x) for w, b in zip(blocks[1::2], blocks[2::2]))


def test_predictions_are_those_of_trees_walked_by_hand(cold):
    model = cold.cost_model.pipeline
    features = model.transform(cold.signature_pool.pairs).select("features", "prediction").limit(200).collect()
    assert features and all(math.isclose(r["prediction"], walked(model.stages[-1], r["features"].toArray()), rel_tol=1e-9, abs_tol=1e-9)
                            for r in features)


@pytest.mark.parametrize("log_target", [False, True])
def test_amounts_of_the_ablation_models(spark, log_target):
    """M10 and M12: the predicted amount is the walked sum, taken back from the logarithm where the target was one."""
    plan = recommender(spark, SF, replace(QUICK, min_support=5, n_trees=30), log_cost=log_target)
    model = plan.amount_models["cost"]
    raw = model.pipeline.transform(plan.training_rows).select("node_id", "business", "features")
    got = model.predict(plan.training_rows, "amount").select("node_id", "business", "amount").join(raw, ["node_id", "business"]).limit(150).collect()
    for r in got:
        value = walked(model.pipeline.stages[-1], r["features"].toArray())
        assert math.isclose(r["amount"], max(0.0, math.expm1(value) if log_target else value), rel_tol=1e-9, abs_tol=1e-9)


def test_cut_ensemble_equals_fewer_rounds(cold):
    """The first trees of a longer fit are the trees of a shorter one."""
    rows = cold.cost_model.pipeline.transform(cold.signature_pool.pairs).select("features", F.col("prediction").alias("label"))
    trainer = GBTRegressor(maxIter=12, maxDepth=3, stepSize=0.3, seed=42, subsamplingRate=0.85, maxBins=64)
    cut = first_trees(trainer.fit(rows), 5)
    short = trainer.copy({trainer.maxIter: 5}).fit(rows)
    assert cut.getNumTrees == 5 and cut.toDebugString.split("\n")[1:] == short.toDebugString.split("\n")[1:]
    both = cut.transform(rows).withColumnRenamed("prediction", "cut").drop("label")
    assert both.withColumn("features", F.col("features")).select("cut").collect() == \
        [type(r)(cut=r["prediction"]) for r in short.transform(rows).select("prediction").collect()]


def test_the_ranking_by_signatures_is_scored_once(spark, monkeypatch):
    from types import SimpleNamespace
    from settlerank.plans.catalog import CATALOG, recommend
    scored = spark.sparkContext.accumulator(0)

    def score(x):
        scored.add(1)
        return float(x)
    rows = spark.range(30).select(F.col("id").cast("string").alias("node_id"), F.lit(1).alias("rank"), F.lit("b").alias("business"),
                                  F.col("id").cast("double").alias("score"))
    found = rows.withColumn("score", F.udf(score, "double").asNondeterministic()("score")).where("score >= 0")
    plan = SimpleNamespace(by_model=lambda: found, by_model_pairs=lambda: rows, support=rows.limit(5),
                           signature_pool=SimpleNamespace(sizes=lambda: {"pairs_scored": 40, "nodes": 30}))
    monkeypatch.setattr(recommend, "coldstart", lambda *_: plan)
    result = CATALOG["q_m22_signature_scoring"].build(spark, "")
    assert [tuple(r) for r in result.collect()] == [(30, 30, True)] and scored.value == 30
