"""Exact neighbours against brute force: cells, chunks, copies, groups, ties."""

import numpy as np
import pytest

from settlerank.operators import knn


def make(spark, rng, n, dims=3, copies=0.0, prefix="n"):
    rows = []
    for i in range(n):
        hot = rng.random() < copies
        codes = ["a", "b"] if hot else [str(rng.integers(0, 4)), str(rng.integers(0, 3))]
        x = np.ones(dims) if hot else rng.random(dims)
        x = x / np.linalg.norm(x) if i % 17 or hot else np.zeros(dims)
        rows.append((f"{prefix}{i:04d}", codes, [float(v) for v in x], f"g{rng.integers(0, 3) if not hot else 0}"))
    return rows, spark.createDataFrame(rows, "node_id string, codes array<string>, numbers array<double>, g string")


def brute(queries, train, k, group=False, exclude_self=False):
    def sim(a, b):
        x, y = np.array(a[2]), np.array(b[2])
        raw = 0.65 * sum(p == q for p, q in zip(a[1], b[1])) / len(a[1]) + 0.35 * float(x @ y)
        na, nb = (np.sqrt(0.65 + 0.35 * bool(np.any(v))) for v in (x, y))
        return round(raw / (na * nb), 9)
    out = {}
    for q in queries:
        rows = [(-sim(q, t), t[0]) for t in train if (not group or t[3] == q[3]) and not (exclude_self and t[0] == q[0])]
        for rank, (s, t) in enumerate(sorted(rows)[:k], 1):
            out[(q[3] if group else "", q[0], rank)] = (t, -s)
    return out


@pytest.mark.parametrize("cells,copies,group,exclude", [
    (1, 0.0, False, False), (7, 0.0, False, False), (9, 0.4, False, True), (5, 0.4, True, True)])
def test_against_brute_force(spark, cells, copies, group, exclude):
    rng = np.random.default_rng(cells)
    train_rows, train = make(spark, rng, 300, copies=copies)
    other_rows, _ = make(spark, rng, 60, copies=copies, prefix="q")
    queries_rows = train_rows[::5] + other_rows
    queries = spark.createDataFrame(queries_rows, train.schema)
    got = knn.nearest(queries, train, 6, group="g" if group else None, exclude_self=exclude, n_cells=cells,
                      query_chunk=16, train_chunk=50)
    want = brute(queries_rows, train_rows, 6, group, exclude)
    found = {((r.g if group else ""), r.node_id, r["rank"]): (r.neighbour_id, r.similarity) for r in got.collect()}
    assert found.keys() == want.keys()
    for key, (ident, s) in want.items():
        assert found[key][0] == ident and abs(found[key][1] - s) < 2e-9


def test_clustered_vectors_are_pruned_and_exact(spark):
    """Well separated clusters: most training rows are not sent to a cell, and nothing is lost."""
    rng = np.random.default_rng(1)
    centres = np.eye(8)
    rows = []
    for i in range(400):
        x = centres[i % 8] + rng.normal(0, 0.01, 8)
        rows.append((f"n{i:04d}", [], [float(v) for v in x / np.linalg.norm(x)]))
    df = spark.createDataFrame(rows, "node_id string, codes array<string>, numbers array<double>")
    fast = knn.nearest(df, df, 5, n_cells=12, query_chunk=20, train_chunk=20)
    plain = knn.nearest(df, df, 5, n_cells=1)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, plain.collect()))


def test_best_in_block_breaks_ties_by_column():
    sims = np.array([[0.5, 0.9, 0.9, 0.9], [0.1, 0.1, 0.1, 0.1]])
    rows, cols, values = knn.best_in_block(sims, 2)
    assert list(zip(rows, cols)) == [(0, 1), (0, 2), (1, 0), (1, 1)]
    assert list(values) == [0.9, 0.9, 0.1, 0.1]


@pytest.mark.parametrize("cells,group,exclude", [(1, None, False), (4, None, True), (None, "g", True)])
def test_carried_numbers_belong_to_the_neighbours(spark, cells, group, exclude):
    from pyspark.sql import functions as F
    rng = np.random.default_rng(8)
    rows, df = make(spark, rng, 150, copies=0.3)
    number = (F.substring("node_id", 2, 4).cast("double") / 7).alias("cost")
    train = df.select("*", F.when(F.col("node_id") != "n0003", number).alias("cost"))
    near = knn.nearest(df, train, 6, group=group, exclude_self=exclude, n_cells=cells, query_chunk=16, train_chunk=32, carry="cost")
    plain = knn.nearest(df, df, 6, group=group, exclude_self=exclude, n_cells=cells, query_chunk=16, train_chunk=32)
    keys = ["node_id", "rank", "neighbour_id", "similarity"]
    assert sorted(map(tuple, near.select(*keys).collect())) == sorted(map(tuple, plain.select(*keys).collect()))
    for r in near.collect():
        assert r["cost"] == (None if r["neighbour_id"] == "n0003" else int(r["neighbour_id"][1:]) / 7)


def test_carried_costs_reach_the_features_without_a_join(spark):
    from pyspark.sql import functions as F
    from settlerank.operators.candidates import neighbour_features
    rows, df = make(spark, np.random.default_rng(9), 120, copies=0.3)
    train = df.select("*", F.col("g").alias("business"), F.substring("node_id", 2, 4).cast("double").alias("cum_cost_7d"))
    near = knn.nearest(train, train, 5, group="business", exclude_self=True, carry="cum_cost_7d")
    got = neighbour_features(near, train, count="n")
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[1].split("Generate")[0]
    want = neighbour_features(near.drop("cum_cost_7d"), train).collect()
    counts = {tuple(r) for r in near.groupBy("business", "node_id").count().collect()}
    found = {(r["business"], r["node_id"]): r for r in got.collect()}
    assert len(found) == len(want) == len(rows)
    assert {(r["business"], r["node_id"]): pytest.approx(r["neighbour_cost"]) for r in want} == {k: r["neighbour_cost"] for k, r in found.items()}
    assert {(*k, r["n"]) for k, r in found.items()} == counts
