"""Text sources: BOM, missing tokens, pinned keys, differing headers, optional files, manifest, markup."""

import json
from datetime import date

from pyspark.sql import functions as F

from settlerank import schemas
from settlerank.functions import business_id, to_day, to_number
from settlerank.operators import checks
from settlerank.sources import files, markup


def test_csv_with_bom_tokens_and_missing_columns(spark, tmp_path):
    path = tmp_path / "ledger.csv"
    path.write_text("﻿node_id,business,business_name,online_day,outcome_days,cum_cost_7d,cum_revenue_7d\n"
                    "007,12.0,七牛,2026-01-02,7.0,1.5,2\n008,12.05,NaN,not a day,NaN,,x\n", encoding="utf-8")
    rows = files.read_csv(spark, str(path), schemas.LEDGER).orderBy("node_id").collect()
    assert (rows[0].node_id, rows[0].business, rows[0].outcome_days, rows[0].online_day) == (
        "007", "12", 7, date(2026, 1, 2))
    assert (rows[1].business, rows[1].business_name, rows[1].outcome_days, rows[1].online_day, rows[1].cum_cost_7d,
            rows[1].cum_revenue_7d) == ("12.05", None, None, None, None, None)
    assert rows[0].business_count is None                      # the file has no such column


def test_many_files_with_different_headers(spark, tmp_path):
    (tmp_path / "nc_1.csv").write_text("nodeId,buildBandwidth\nn1,10\n")
    (tmp_path / "nc_2.csv").write_text("nodeId,buildBandwidth\nn2,bad\n")
    (tmp_path / "cb_1.csv").write_text("nodeId,customerId,buildBandwidth\nn1,5.0,7\n")
    names = {"nodeId": "node_id", "customerId": "business", "buildBandwidth": "build_bandwidth"}
    df = files.read_csv(spark, [f"{tmp_path}/nc_*.csv", f"{tmp_path}/cb_*.csv"], schemas.BUILD_BANDWIDTH, rename=names)
    assert sorted((r.node_id, r.business or "", r.build_bandwidth or -1) for r in df.collect()) == [
        ("n1", "", 10.0), ("n1", "5", 7.0), ("n2", "", -1)]


def test_optional_source(spark, tmp_path):
    df = files.read_optional_csv(spark, f"{tmp_path}/none.csv", schemas.CAPACITY)
    assert df.count() == 0 and df.columns == schemas.CAPACITY.names


def test_manifest_and_required_columns(spark, tmp_path):
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps({"version": "x", "inputs": [{"role": "attrs", "row_expected_min": 5,
                                                            "required_cols": ["node_id", "bw"]}]}, indent=1))
    row = files.read_manifest(spark, str(path)).first()
    assert (row.role, row.row_expected_min, row.required_cols) == ("attrs", 5, ["node_id", "bw"])
    attrs = spark.createDataFrame([("a",)], "node_id string")
    got = {r.column: r.present for r in checks.required_columns(attrs, row.required_cols).collect()}
    assert got == {"node_id": 1, "bw": 0}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "node_id string, rank int")
    assert files.read_csv(spark, files.write_csv(df, f"{tmp_path}/c")).first().node_id == "a"
    assert files.read_parquet(spark, files.write_parquet(df, f"{tmp_path}/p", ["rank"])).first()["rank"] == 1
    path = files.write_metrics_json(df.select(F.struct("rank").alias("m")), f"{tmp_path}/j")
    assert spark.read.json(path).first().m["rank"] == 1


def test_markup_rows(spark):
    html = ("<table><thead><tr><th>x</th></tr></thead><tbody>"
            "<tr><td>n1</td><td>Name 10000001 10000292<br><span>近7天 123456789</span></td></tr>\n"
            "<tr><td> <b>n2</b> </td><td><span class='m'>—</span></td></tr><tr><td>only one</td></tr></tbody></table>")
    df = spark.createDataFrame([(html,)], "html string")
    assert [(r.first_text, r.last_id) for r in markup.table_rows(df).orderBy("row_no").collect()] == [
        ("n1", "10000292"), ("n2", None)]


def test_lenient_casts(spark):
    df = spark.createDataFrame([("1.0", "1e3", "2026-01-02"), ("1.0.0", "NaN", "2026-13-40"), ("x", " 7 ", ""),
                                (None, "abc", None)], "b string, n string, d string")
    got = df.select(business_id("b").alias("b"), to_number("n").alias("n"), to_day("d").alias("d")).collect()
    assert [tuple(r) for r in got] == [("1", 1000.0, date(2026, 1, 2)), ("1.0", None, None), ("x", 7.0, None),
                                      (None, None, None)]
