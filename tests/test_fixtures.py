"""The small published fixtures: families, gate, split, encoder, statistics."""

import math
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from settlerank.operators import ledger, split, stats
from settlerank.operators.encoder import AttributeEncoder


def ids(df, column="node_id"):
    return {r[0] for r in df.select(column).collect()}


def test_family_tokens(spark):
    names = spark.createDataFrame([("1001", "七牛CDN-虚拟-A"), ("1002", "七牛特招-虚拟"), ("1003", "普通客户")],
                                  "business string, business_name string")
    rows = spark.createDataFrame([("n", b) for b in ("1001", "1002", "1003", "1004")], "node_id string, business string")
    got = sorted(r.business for r in ledger.to_families(rows, names).collect())
    assert got == ["1003", "1004", "FQCDNV", "FQTZV"]
    unnamed = ledger.to_families(rows, names.where("false"))
    assert ids(unnamed, "business") == {"1001", "1002", "1003", "1004"}


def test_gate(spark):
    rows = ([("ant0001", "B1"), ("ant0002", "B1"), ("ant0003", "B1"), ("node0004", "B1"), ("node0005", "B2"),
             ("node0006", "B2")] + [(f"ant{i}", "B3") for i in range(6)] + [("n1", "B4"), ("n2", "B4")])
    df = spark.createDataFrame(rows, "node_id string, business string")
    assert ids(ledger.gated_businesses(df, 0.9), "business") == {"B3"}
    assert ids(ledger.drop_gated(df, ledger.gated_businesses(df, 0.9)), "business") == {"B1", "B2", "B4"}


def test_split_by_ratio_and_day(spark):
    rows = [(f"n{i}", date(2026, 1, i)) for i in (3, 5, 1, 4, 2)]
    nodes = spark.createDataFrame(rows, "node_id string, intro_day date")
    got = split.temporal_split(nodes, 0.8)
    assert ids(got.where("NOT is_test")) == {"n1", "n2", "n3", "n4"} and ids(got.where("is_test")) == {"n5"}
    got = split.temporal_split(nodes, cut_day="2026-01-03")
    assert ids(got.where("NOT is_test")) == {"n1", "n2"} and ids(got.where("is_test")) == {"n3", "n4", "n5"}


def test_split_with_one_hot_day_and_missing_days(spark):
    """Most nodes share one day, some have none: sizes are exact and the sides are disjoint and complete."""
    rows = [(f"n{i}", date(2026, 1, 5) if i % 3 else date(2026, 1, 1 + i % 9)) for i in range(3000)]
    rows += [(f"m{i}", None) for i in range(7)]
    nodes = spark.createDataFrame(rows, "node_id string, intro_day date")
    got = split.temporal_split(nodes, 0.8).collect()
    assert len(got) == 3007 and sum(not r.is_test for r in got) == int(3007 * 0.8)
    last_train = max((r.intro_day for r in got if not r.is_test))
    assert all(r.intro_day is None or r.intro_day >= last_train for r in got if r.is_test)
    for ratio, n_train in ((0.0, 0), (1.0, 3007)):
        assert split.temporal_split(nodes, ratio).where("NOT is_test").count() == n_train
    nobody = split.split_at_day(nodes, "2026-01-02")
    assert nobody.where("intro_day IS NULL").count() == 0


def test_encoder(spark):
    cols = "node_id province isp resourcetype deliverytype nattype dialtype device_type os".split()
    cats = [["浙", "浙", "粤", "粤", "京", "京"], ["电信", "联通"] * 3, ["dedicated"] * 6, ["idc"] * 6,
            ["公网", "公网", "锥型", "锥型", "对称", "对称"], ["静态", "静态", "拨号", "拨号", "拨号", "静态"],
            ["d1", "d1", "d1", "d2", "d2", "d2"], ["linux"] * 6]
    rows = [(f"n{i}", *[c[i] for c in cats], bw, core) for i, (bw, core) in enumerate(
        zip([1000, 2000, 1000, 3000, 1000, 4000], [8, 16, 8, 32, 8, 64]))]
    schema = ", ".join(f"{c} string" for c in cols) + ", bw int, corenum int"
    attrs = spark.createDataFrame(rows, schema)
    for frame, width in ((attrs, 2), (attrs.withColumn("corenum", F.lit(None).cast("int")), 1)):
        out = AttributeEncoder().fit(frame).transform(frame).collect()
        assert len(out) == 6
        for r in out:
            assert len(r.codes) == 8 and len(r.numbers) == width
            assert math.isclose(sum(x * x for x in r.numbers), 1.0) or sum(r.numbers) == 0


def test_quantile_positions_follow_the_knot_formula(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(1, 40, 900).astype(float), rng.gamma(2, 30, 600)])
    attrs = spark.createDataFrame([(f"n{i}", float(v)) for i, v in enumerate(x)], "node_id string, bw double")
    model = AttributeEncoder(cats=[], nums=["bw"]).fit(attrs)
    q, ref = np.percentile(x, np.linspace(0, 100, 500)), np.linspace(0, 1, 500)
    assert np.allclose(model.knots["bw"], q)
    got = {r.node_id: r.bw for r in model.quantile_positions(attrs).collect()}
    want = (np.interp(x, q, ref) - np.interp(-x, -q[::-1], -ref[::-1])) / 2
    want = np.where(x == q[0], 0.0, np.where(x == q[-1], 1.0, want))
    assert np.allclose([got[f"n{i}"] for i in range(len(x))], want)


def test_business_stats(spark):
    rows = [("a", "X", 100.0, 10.0), ("a", "X", 200.0, 20.0), ("b", "X", 300.0, 30.0), ("c", "X", 400.0, 40.0),
            ("d", "Y", 999.0, 5.0)]
    df = spark.createDataFrame(rows, "node_id string, business string, cum_cost_7d double, cum_profit_7d double")
    got = {r.business: r for r in stats.business_stats(df).collect()}
    assert got["X"].support == 3 and got["Y"].support == 1
    assert abs(got["X"].cost_mean - 250) < 1e-6 and got["X"].profit_mean_log > 0
    assert abs(got["X"].cost_p90 - np.quantile([100, 200, 300, 400], 0.9)) < 1e-9
    assert got["Y"].cost_p90 == 999.0
    assert ids(stats.support_pool(stats.business_stats(df), 2), "business") == {"X"}
