"""Strata by grouping sets: totals, null values and strata without rows."""

from pyspark.sql import functions as F

from settlerank.operators.evaluation import strata


def test_strata(spark):
    rows = [("x", 1, 2.0), ("x", None, 4.0), (None, 1, 6.0)]
    df = spark.createDataFrame(rows, "a string, b int, v double")
    out = strata(df, ["a", "b"], [F.sum("v").alias("total")], {"a": ["x", "y"]})
    got = {(r["a"], r["b"]): (r["n"], r["total"]) for r in out.collect()}
    assert got == {("x", "1"): (1, 2.0), ("x", None): (1, 4.0), (None, "1"): (1, 6.0), ("all", "1"): (2, 8.0), ("all", None): (1, 4.0),
                   ("x", "all"): (2, 6.0), (None, "all"): (1, 6.0), ("all", "all"): (3, 12.0), ("y", "1"): (0, None), ("y", None): (0, None),
                   ("y", "all"): (0, None)}
    plan = strata(df, ["a", "b"], [F.sum("v").alias("total")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("Aggregate") == 1 and "Union" not in plan


def test_all_dimensions_given(spark):
    none = spark.createDataFrame([], "a string, v double")
    got = strata(none, ["a"], [F.sum("v").alias("total")], {"a": ["x"]}).collect()
    assert {(r["a"], r["n"]) for r in got} == {("x", 0), ("all", 0)}
