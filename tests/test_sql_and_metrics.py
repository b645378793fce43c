"""SQL functions against their Column forms, metrics by dotted path, distinct counts from bitmaps."""

import json
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from settlerank.functions import (business_id, capacity_penalty, display_label, family_token, segment_key, streak_label, text_or_null,
                                  to_number)
from settlerank.functions.sql_functions import register_functions
from settlerank.fixed_values import FAMILY_RULES
from settlerank.operators import daybits
from settlerank.session import stage_path
from settlerank.sources import metrics

TEXTS = [None, "", "12.0", "12.0.0", "1.0x", "NaN", " 4.5 ", "n/a", "-1e3", "abc", "七牛CDN-虚拟-A", "七牛特招-虚拟", "it's a long label, longer than 26", "\\d"]


def test_sql_functions_equal_column_forms(spark):
    register_functions(spark)
    rows = [(a, b, None if i % 5 == 0 else float(i - 3), [None, -1, 0, 3, 7, 9][i % 6]) for i, (a, b) in enumerate((a, b) for a in TEXTS for b in TEXTS)]
    df = spark.createDataFrame(rows, "a string, b string, x double, d int")
    got = df.select(
        F.expr("settle_business_id(a)").alias("s1"), business_id("a").alias("c1"), F.expr("settle_text(a)").alias("s2"), text_or_null("a").alias("c2"),
        F.expr("settle_number(a)").alias("s3"), to_number("a").alias("c3"), F.expr("settle_family(a, b)").alias("s4"), family_token("a", "b", FAMILY_RULES).alias("c4"),
        F.expr("settle_segment(a, b, a)").alias("s5"), segment_key("a", "b", "a").alias("c5"),
        F.expr("settle_capacity_penalty(x, x - 4)").alias("s6"), capacity_penalty("x", F.col("x") - 4).alias("c6"),
        F.expr("settle_streak_label(d)").alias("s7"), streak_label("d").alias("c7"), F.expr("settle_label(a, b, 26)").alias("s8"), display_label("a", "b", 26).alias("c8"))
    for r in got.collect():
        assert [r[f"s{i}"] for i in range(1, 9)] == [r[f"c{i}"] for i in range(1, 9)]


def test_sql_functions_are_inlined(spark):
    register_functions(spark)
    df = spark.createDataFrame([("12.0",)], "a string")
    plan = df.select(F.expr("settle_business_id(a)"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "settle_business_id(a" not in plan.split("AS")[0]


@pytest.fixture
def documents(spark, tmp_path):
    docs = {"a.json": {"metrics": {"hit@1": 0.4, "n": 7, "none": None, "names": ["x", "y"], "deep": {"er": [{"v": 1.5}]}}}, "b.json": {"metrics": {"n": "seven"}}}
    for name, doc in docs.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=2))
    (tmp_path / "c.json").write_text("{ no json")
    return metrics.read_metrics(spark, str(tmp_path))


def test_dotted_paths(documents):
    paths = ["metrics.hit@1", "metrics.n", "metrics.none", "metrics.deep.er.0.v", "metrics.deep.er.1.v", "metrics.names.1", "other"]
    got = {(r["file"].rsplit("/", 1)[1], r["path"]): (r["present"], r["value"]) for r in metrics.metrics_at(documents, paths).collect()}
    assert [got["a.json", p] for p in paths] == [(True, 0.4), (True, 7.0), (True, None), (True, 1.5), (False, None), (True, None), (False, None)]
    assert got["b.json", "metrics.n"] == (True, None) and got["c.json", "metrics.n"] == (False, None)
    assert metrics.metrics_at(documents, ["metrics.names.1"], "string").where("value = 'y'").count() == 1
    with pytest.raises(ValueError):
        metrics.json_path("a..b")


def test_a_missing_path_fails(documents, spark, tmp_path):
    got = {(r["file"].rsplit("/", 1)[1], r["metric"]): r["passed"] for r in metrics.within(documents, [("metrics.n", 1, 10), ("metrics.hit@1", 0.5, 1), ("gone", 0, 1)]).collect()}
    assert got == {(f, m): f == "a.json" and m == "metrics.n" for f in ("a.json", "b.json", "c.json") for m in ("metrics.n", "metrics.hit@1", "gone")}
    with pytest.raises(FileNotFoundError):
        metrics.read_metrics(spark, str(tmp_path / "nowhere"))


def test_bitmaps_stored_by_day(spark):
    dice, start = random.Random(2), date(2026, 1, 1)
    rows = [(None if i % 50 == 0 else f"n{dice.randrange(90_000)}", f"b{dice.randrange(3)}", start + timedelta(days=dice.randrange(10))) for i in range(40_000)]
    df = spark.createDataFrame(rows, "node_id string, business string, day date")
    half = F.col("day") < F.lit(start + timedelta(days=5))
    first = daybits.numbered_ids(df.where(half))
    path = stage_path(spark, "bits")
    daybits.day_bitmaps(df.where(half), first, ["business"]).write.partitionBy("day").parquet(path)
    second = daybits.numbered_ids(df, first)                         # known numbers stay, new ids follow
    assert second.select("number").distinct().count() == second.count() == len({r[0] for r in rows} - {None})
    assert first.join(second, ["node_id", "number"]).count() == first.count()
    daybits.day_bitmaps(df.where(~half), second, ["business"]).write.mode("append").partitionBy("day").parquet(path)
    stored = spark.read.parquet(path)
    merged = daybits.merged_counts(stored, ["business"])
    assert {r["business"]: r["n_distinct"] for r in merged.collect()} == {
        b: len({n for n, c, _ in rows if c == b and n}) for b in ("b0", "b1", "b2")}
    few = daybits.merged_counts(stored, [], F.col("day") == F.lit(start)).first()["n_distinct"]
    assert few == len({n for n, _, d in rows if d == start and n})
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "bitmap_or_agg" in plan and "count(distinct" not in plan and "node_id" not in plan
