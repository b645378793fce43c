"""What travels between tasks: no wanted positions in percentile rows, one shuffle per ledger, tiles instead of copies per chunk."""

import numpy as np
from pyspark.sql import functions as F

from settlerank.operators import knn, lsh, percentiles
from settlerank.sources import tables


def stored_by(monkeypatch, module):
    """(name, table) of every stage table that the module stores."""
    stored, write = [], module.cut_lineage

    def keep(df, name="stage"):
        out = write(df, name)
        stored.append((name, out))
        return out
    monkeypatch.setattr(module, "cut_lineage", keep)
    return stored


def test_many_percentiles_without_positions_in_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    probs = sorted({*np.linspace(0, 1, 200), 0.001, 0.9995, *rng.random(20)})
    groups = {"one": np.round(rng.exponential(5, 2500), 1), "two": rng.normal(size=900), "single": np.array([4.0])}
    df = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x], "g string, v double").repartition(3)
    stored = stored_by(monkeypatch, percentiles)
    got = {(r.g, r.p): r.value for r in percentiles.exact_percentiles(df, ["g"], "v", probs).collect()}
    assert got.keys() == {(g, p) for g in groups for p in probs}
    assert max(abs(got[g, p] - np.percentile(x, 100 * p)) for g, x in groups.items() for p in probs) < 1e-9
    assert [sorted(t.columns) for name, t in stored if name == "spans"] == [["_before", "_range", "g", "n"]]


def test_ledger_is_dealt_out_once(spark):
    days = spark.createDataFrame([("1", "B1", 3, 2.0, 5.0, 1.0), ("1", "B1", 2, 1.0, 1.0, 1.0), ("1", "B2", 4, 1.0, 0.0, 1.0),
                                  (None, "B1", 1, 9.0, 9.0, 1.0), ("2", None, 1, 9.0, 9.0, 1.0)],
                                 "node_id string, business string, d int, cost double, revenue double, quantity double")
    days = days.select("node_id", "business", F.date_add(F.lit("2024-01-01").cast("date"), "d").alias("day"), "cost", "revenue", "quantity")
    folder = f"{spark.conf.get('spark.checkpoint.dir')}/ledger-once"
    spark.createDataFrame([("B1", "T1"), ("B1", "A"), ("B2", "T2")], "p_brand string, p_type string").write.mode("overwrite").parquet(f"{folder}/part.parquet")
    ledger = tables.ledger_totals(spark, folder, days)
    got = {(r.node_id, r.business): (r.outcome_days, r.cum_cost_7d, r.cum_profit_7d, r.business_count, str(r.online_day), r.business_name)
           for r in ledger.collect()}
    assert got == {("1", "B1"): (2, 3.0, 3.0, 2, "2024-01-03", "B1 A"), ("1", "B2"): (1, 1.0, -1.0, 2, "2024-01-03", "B2 T2")}
    plan = ledger._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning(node_id") == 1


def vectors(spark, x, copies=1):
    rows = [(f"{c:02d}-{i:04d}", [], [float(a) for a in v]) for c in range(copies) for i, v in enumerate(x)]
    return knn.unit_length(spark.createDataFrame(rows, "node_id string, codes array<string>, numbers array<double>")).repartition(4)


def test_small_chunks_do_not_copy_rows_for_each_chunk(spark, monkeypatch):
    df = vectors(spark, np.random.default_rng(2).standard_normal((600, 8)))
    stored = stored_by(monkeypatch, knn)
    few = knn.nearest(df, df, 4, n_cells=3, query_chunk=8, train_chunk=20)
    tiles = [t for name, t in stored if name == "tiles"][-1].agg(F.max("q_parts"), F.max("t_parts")).first()
    assert tuple(tiles) == (1, 1)
    many = knn.nearest(df, df, 4, n_cells=3, query_chunk=8, train_chunk=20, tile=30)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    assert [t for name, t in stored if name == "tiles"][-1].agg(F.max("t_parts")).first()[0] > 3


def test_copies_are_one_training_row(spark, monkeypatch):
    df = vectors(spark, np.random.default_rng(3).standard_normal((40, 5)), copies=6)
    stored = stored_by(monkeypatch, knn)
    got = knn.nearest(df, df, 5, exclude_self=True).collect()
    assert [t for name, t in stored if name == "profiles"][0].count() == 40
    assert len(got) == 240 * 5
    for r in got:
        assert r["neighbour_id"][3:] == r["node_id"][3:] and r["similarity"] == 1.0
        others = [f"{c:02d}" for c in range(6) if f"{c:02d}" != r["node_id"][:2]]
        assert r["neighbour_id"][:2] == others[r["rank"] - 1]


def test_node_that_asks_twice_is_ranked_over_both(spark):
    train = vectors(spark, np.eye(4))
    asked = train.where("node_id = '00-0001'").unionByName(train.where("node_id IN ('00-0001', '00-0002')"))
    got = knn.nearest(asked, train, 2, exclude_self=True).collect()
    ranked = sorted((r["node_id"], r["rank"], r["neighbour_id"]) for r in got)
    assert ranked == [("00-0001", 1, "00-0000"), ("00-0001", 2, "00-0000"), ("00-0002", 1, "00-0000"), ("00-0002", 2, "00-0001")]


def test_far_neighbours_take_one_bucket_instead_of_all(spark):
    df = vectors(spark, np.random.default_rng(4).standard_normal((1500, 48)))
    planes = lsh.tuned_probes(df, df, 10, knn.CosineSpace(), lsh.Hyperplanes().for_rows(1500), rows=1500)
    assert planes.tables * planes.probes <= 16
    found = knn.nearest(df, df, 10, method="lsh", planes=planes)
    assert lsh.recall_of(found, knn.nearest(df, df, 10)).first()["recall"] >= 0.9
