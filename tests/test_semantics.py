"""Edge rows: files with other column orders, missing keys, copies, absent cells, early stopping, hot percentile groups."""

import numpy as np
import pytest

from settlerank.operators import baselines, evaluation, ledger, models, percentiles, ranking
from settlerank.sources import files


def test_files_of_one_glob_are_united_by_name(spark, tmp_path):
    for name, text in {"a": "node_id,bw\nn1,5\n", "b": "bw,node_id\n7,n2\n", "c": "node_id,bw,extra\nn3,9,x\n", "d": ""}.items():
        (tmp_path / f"{name}.csv").write_text(text)
    rows = files.read_csv(spark, f"{tmp_path}/*.csv").select("node_id", "bw", "extra").collect()
    assert sorted(map(tuple, rows), key=str) == [("n1", "5", None), ("n2", "7", None), ("n3", "9", "x")]


def test_line_breaks_inside_quotes(spark, tmp_path):
    (tmp_path / "q.csv").write_text('node_id,note\nn1,"two\nlines"\n')
    assert files.read_csv(spark, f"{tmp_path}/q.csv", multi_line=True).first()["note"] == "two\nlines"


def test_rows_without_keys_leave_the_ledger(spark):
    daily = spark.createDataFrame([("n", "b", "2024-01-01", 1.0, 2.0), (None, "b", "2024-01-01", 1.0, 2.0), ("n", None, "2024-01-01", 1.0, 2.0)],
                                  "node_id string, business string, day string, cost double, revenue double")
    rows = ledger.first_window_ledger(daily.withColumn("day", daily["day"].cast("date"))).collect()
    assert [(r["node_id"], r["business"]) for r in rows] == [("n", "b")]


def test_the_fullest_copy_stays(spark):
    rows = spark.createDataFrame([("a", "x", 5), ("a", None, None), ("a", None, 9), ("b", None, None)], "node_id string, s string, n int")
    assert sorted(map(tuple, ledger.unique_nodes(rows, []).collect())) == [("a", "x", 5), ("b", None, None)]


def test_cross_table_and_strata_are_complete(spark):
    pairs = spark.createDataFrame([(0, 1), (0, 0), (0, 1)], "a_hit1 int, b_hit1 int")
    assert sorted(map(tuple, evaluation.hit_crosstab(pairs).collect())) == [(0, 1, 2), (1, 0, 0)]
    hit = spark.createDataFrame([("node1", 1, 1), ("node2", 0, 1)], "node_id string, hit1 int, hit3 int")
    rows = {r["stratum"]: tuple(r)[1:] for r in evaluation.stratified(hit).collect()}
    assert rows == {"all": (2, 100.0, 50.0, 100.0), "prefix": (0, 0.0, None, None), "other": (2, 100.0, 50.0, 100.0)}


def test_best_round_has_patience():
    assert models.best_round([5, 4, 4.5, 4.4, 3, 3.5, 3.6, 2], 3) == 8
    assert models.best_round([5, 4, 4.5, 4.4, 4.3, 3], 3) == 2
    assert models.best_round([1.0], 3) == 1


def test_more_than_one_tree_is_kept_and_helps(spark):
    from dataclasses import replace
    from pyspark.sql import functions as F
    from settlerank.config import Settings
    rng = np.random.default_rng(3)
    rows = [(f"n{i}", "b", float(x), float(y), 100 + 50 * float(x) + 20 * float(y) * float(x))
            for i, (x, y) in enumerate(rng.random((400, 2)))]
    train = spark.createDataFrame(rows, "node_id string, business string, x double, y double, cost double")
    settings = replace(Settings(), n_trees=24, learning_rate=0.3, max_depth=3, patience=6)

    def error(model):
        return model.predict(train, "p").agg(F.avg(F.abs(F.col("p") - F.col("cost")))).first()[0]
    many = models.fit_amount(train, "cost", [], ["x", "y"], settings)
    one = models.fit_amount(train, "cost", [], ["x", "y"], replace(settings, n_trees=1))
    assert many.pipeline.stages[-1].getNumTrees > 1 and error(many) < 0.8 * error(one)


def test_a_model_that_keeps_improving_is_fitted_again_few_times(spark, monkeypatch):
    from dataclasses import replace
    from pyspark.ml.regression import GBTRegressor
    from settlerank.config import Settings
    rows = [(f"n{i}", "b", float(i), float(i * i)) for i in range(300)]
    train = spark.createDataFrame(rows, "node_id string, business string, x double, cost double")
    fits, fit = [], GBTRegressor._fit
    monkeypatch.setattr(GBTRegressor, "_fit", lambda self, data: fits.append(self.getMaxIter()) or fit(self, data))
    settings = replace(Settings(), n_trees=50, learning_rate=0.02, max_depth=2, patience=5)
    model = models.fit_amount(train, "cost", [], ["x"], settings)
    assert fits == [10, 50] and model.pipeline.stages[-1].getNumTrees > 45


def test_the_steps_of_the_rounds_end_at_the_allowed_number():
    assert [models.next_rounds(20, 20, n) for n in (30, 120, 500, 700)] == [30, 120, 100, 100]
    assert [models.next_rounds(100, 100, n) for n in (500, 700, 5000)] == [500, 700, 500]
    assert models.next_rounds(20, 12, 500) == 40


def test_training_rows_lie_in_few_parts(spark, monkeypatch):
    many = spark.range(0, 1000, 1, 200)
    cores = spark.sparkContext.defaultParallelism
    found = models.training_parts(many)
    assert found.rdd.getNumPartitions() == 3 * cores and sorted(r.id for r in found.collect()) == list(range(1000))
    assert models.training_parts(spark.range(0, 10, 1, 2)).rdd.getNumPartitions() == 2
    monkeypatch.setattr(models, "_PART_ROWS", 10)
    assert models.training_parts(many).rdd.getNumPartitions() == 100


@pytest.mark.parametrize("probs", [[0.0, 0.1, 0.5, 0.9, 1.0]])
def test_percentiles_of_a_hot_group_and_ties(spark, probs):
    rng = np.random.default_rng(4)
    rows = [("hot", float(v)) for v in rng.normal(size=3000)] + [("ties", float(v)) for v in rng.integers(0, 3, 2000)]
    rows += [(f"g{i % 400}", float(i)) for i in range(3000)] + [("hot", None), (None, 1.0), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    found = {(r["g"], r["p"]): (r["n"], r["value"]) for r in percentiles.exact_percentiles(df, ["g"], "v", probs).collect()}
    groups = {}
    for g, v in rows:
        if g is not None and v is not None and v == v:
            groups.setdefault(g, []).append(v)
    assert found.keys() == {(g, p) for g in groups for p in probs}
    for (g, p), (n, value) in found.items():
        assert n == len(groups[g]) and abs(value - np.percentile(groups[g], 100 * p)) < 1e-9


def test_pool_places_and_whole_pool(spark):
    pool = spark.createDataFrame([(f"b{i:03d}", float(i % 7)) for i in range(150)], "business string, score double")
    placed = {r["business"]: r["place"] for r in baselines.ranked_pool(pool).collect()}
    order = sorted(placed, key=lambda b: (-(int(b[1:]) % 7), b))
    assert [placed[b] for b in order] == list(range(1, 151))
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(20)], "node_id string")
    pairs = baselines.spread_pool(nodes, pool, chunk=40).collect()
    assert len(pairs) == len(set(pairs)) == 20 * 150


def test_predicted_revenue_reaches_the_rows(spark):
    ranked = spark.createDataFrame([("n", 1, "b", 1.234, 5.678, 4.444)], "node_id string, rank int, business string, pred_cost double, pred_revenue double, pred_profit double")
    rows = ranking.recommendation_rows(ranked)
    assert rows.first()["pred_revenue"] == 5.68 and "top1_pred_revenue" in ranking.widen(rows).columns
