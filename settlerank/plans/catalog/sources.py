"""S01-S11: scans and sinks. Written files go to the shared stage folder and are read back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlerank.config import FIRST_GENERATION, from_environment
from settlerank.functions import capacity_penalty
from settlerank.operators import checks, ranking, stats
from settlerank.plans.flow import flow_of
from settlerank.plans.registry import query
from settlerank.plans.twins import twin
from settlerank.schemas import CAPACITY
from settlerank.session import stage_path
from settlerank.sources import files, markup, tables

ATTR_SCHEMA = T.StructType([T.StructField("node_id", T.StringType())]
                           + [T.StructField(c, T.StringType()) for c in tables.CATS]
                           + [T.StructField(c, T.DoubleType()) for c in tables.NUMS])


@query("q_s01_csv_scan", twin("""
    SELECT node_id, segment, nation, region, round(acctbal, 2) AS acctbal, n_orders, round(avg_price, 6) AS avg_price
    FROM attrs""", "attrs"))
def csv_scan(spark, sf):
    path = files.write_csv(tables.node_attributes(spark, sf), stage_path(spark, "attrs_csv"))
    df = files.read_csv(spark, path, ATTR_SCHEMA)
    return df.select("node_id", *tables.CATS, F.round("acctbal", 2).alias("acctbal"), "n_orders",
                     F.round("avg_price", 6).alias("avg_price"))


@query("q_s02_optional_source", twin("""
    SELECT business, count(*) AS n_pairs, CAST(0 AS DOUBLE) AS total_penalty FROM totals GROUP BY 1""", "totals"))
def optional_source(spark, sf):
    capacity = files.read_optional_csv(spark, stage_path(spark, "absent_capacity"), CAPACITY)
    joined = tables.ledger_totals(spark, sf).join(
        capacity.select("business", "over_capacity_mbps", "capacity_upper_mbps"), "business", "left")
    penalty = capacity_penalty("over_capacity_mbps", "capacity_upper_mbps")
    return joined.groupBy("business").agg(F.count("*").alias("n_pairs"), F.sum(penalty).alias("total_penalty"))


@query("q_s03_many_files", """
    SELECT CAST(o_custkey AS VARCHAR) AS node_id, count(*) AS n_rows, count(b) AS n_named, max(q) AS build_bandwidth
    FROM (SELECT o_custkey, l_quantity AS q,
                 CASE WHEN l_returnflag <> 'A' THEN p_brand END AS b
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)
    GROUP BY 1""")
def many_files(spark, sf):
    parts = tables.table(spark, sf, "part").select("p_partkey", "p_brand")
    orders = tables.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lines = (tables.table(spark, sf, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
             .join(orders, F.col("l_orderkey") == F.col("o_orderkey")))
    root = stage_path(spark, "bandwidth_csv")
    node, band = F.col("o_custkey").alias("nodeId"), F.col("l_quantity").alias("buildBandwidth")
    files.write_csv(lines.where("l_returnflag = 'A'").select(node, band), f"{root}/per_node/day_1")
    files.write_csv(lines.where("l_returnflag = 'N'").select(node, F.col("p_brand").alias("customerId"), band),
                    f"{root}/per_pair/day_1")
    files.write_csv(lines.where("l_returnflag NOT IN ('A', 'N')").select(         # other order of columns, same glob
        band, F.col("p_brand").alias("customerId"), node), f"{root}/per_pair/day_2")
    names = {"nodeId": "node_id", "customerId": "business", "buildBandwidth": "build_bandwidth"}
    df = files.read_csv(spark, [f"{root}/per_node/*", f"{root}/per_pair/*"], rename=names)
    return df.groupBy("node_id").agg(F.count("*").alias("n_rows"), F.count("business").alias("n_named"),
                                     F.max(F.col("build_bandwidth").cast("double")).alias("build_bandwidth"))


@query("q_s04_lower_headers", twin("""
    SELECT node_id AS nodeid, business AS customerid, strftime(day, '%Y-%m-%d') AS day, round(cost, 2) AS cost,
           round(revenue, 2) AS rev FROM daily""", "daily"))
def lower_headers(spark, sf):
    daily = tables.daily_settlement(spark, sf).select(
        F.col("node_id").alias("NodeId"), F.col("business").alias("CustomerId"), F.col("day").alias("Day"),
        F.col("cost").alias("COST"), F.col("revenue").alias("Rev"))
    df = files.read_csv(spark, files.write_csv(daily, stage_path(spark, "daily_csv")), lower=True)
    return df.select("nodeid", "customerid", "day", F.round(F.col("cost").cast("double"), 2).alias("cost"),
                     F.round(F.col("rev").cast("double"), 2).alias("rev"))


@query("q_s05_configured_pool", twin("""
    SELECT business, support FROM stats WHERE support >= 920""", "stats"))
def configured_pool(spark, sf):
    settings = from_environment(FIRST_GENERATION, {"SETTLERANK_MIN_SUPPORT": "920"})
    flow = flow_of(spark, sf, settings)
    return stats.support_pool(stats.business_support(flow.train), settings.min_support)


@query("q_s06_settlement_scan", """
    SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, count(*) AS n_rows, round(sum(value), 2) AS revenue
    FROM events GROUP BY 1""")
def settlement_scan(spark, sf):
    events = tables.table(spark, sf, "events")
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("revenue"))


@query("q_s07_markup_rows", r"""
    WITH r AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1)) AS row_html FROM pages),
    c AS (SELECT page_id, regexp_extract_all(row_html, '(?s)<li>(.*?)</li>', 1) AS cells FROM r),
    s AS (SELECT page_id, cells[1] AS first, split_part(cells[2], '<br', 1) AS second FROM c WHERE len(cells) >= 2)
    SELECT page_id, trim(regexp_replace(first, '<[^>]+>', '', 'g')) AS first_text,
           list_extract(regexp_extract_all(trim(regexp_replace(second, '<[^>]+>', '', 'g')), '([a-z]{2,12})', 1), -1)
           AS last_id FROM s""")
def markup_rows(spark, sf):
    pages = tables.table(spark, sf, "pages").select("page_id", "html")
    return markup.table_rows(pages, row_tag="ul", cell_tag="li", id_pattern="([a-z]{2,12})",
                             keep=("page_id",)).select("page_id", "first_text", "last_id")


@query("q_s08_csv_sink", twin("""
    SELECT node_id, rank, business, round(pred_cost, 2) AS pred_cost, round(pred_profit, 2) AS pred_profit,
           CAST(pred_profit > 0 AS INT) AS profit_positive FROM rec_off""", "rec_off"))
def csv_sink(spark, sf):
    recs = flow_of(spark, sf).recs("score_off")
    df = files.read_csv(spark, files.write_csv(recs, stage_path(spark, "recs_csv")))
    return df.select("node_id", F.col("rank").cast("int").alias("rank"), "business",
                     *[F.col(c).cast("double").alias(c) for c in ("pred_cost", "pred_profit")],
                     F.col("profit_positive").cast("int").alias("profit_positive"))


@query("q_s09_metrics_json", twin("""
    SELECT count(*) AS test_nodes, round(avg(true_value), 4) AS mean_true_value FROM truth""", "truth"))
def metrics_json(spark, sf):
    metrics = flow_of(spark, sf).truth.agg(F.struct(
        F.count("*").alias("nodes"), F.avg("true_value").alias("mean_value")).alias("test"))
    path = files.write_metrics_json(metrics, stage_path(spark, "metrics_json"))
    back = spark.read.schema("test struct<nodes: bigint, mean_value: double>").json(path)
    return back.select(F.col("test.nodes").alias("test_nodes"),
                       F.round("test.mean_value", 4).alias("mean_true_value"))


@query("q_s10_stage_table", twin("""
    SELECT business, count(*) AS n_nodes FROM rec_off WHERE rank = 1 GROUP BY 1 ORDER BY n_nodes DESC, business
    LIMIT 12""", "rec_off"))
def stage_table(spark, sf):
    path = files.write_parquet(flow_of(spark, sf).recs("score_off"), stage_path(spark, "recs"), ["rank"])
    return ranking.top_businesses(files.read_parquet(spark, path).where("rank = 1"))


@query("q_s11_manifest_columns", twin("""
    SELECT 'node_id' AS "column", 1 AS present, count(node_id) AS filled FROM totals UNION ALL
    SELECT 'business', 1, count(business) FROM totals UNION ALL
    SELECT 'business_name', 1, count(business_name) FROM totals UNION ALL
    SELECT 'online_day', 1, count(online_day) FROM totals UNION ALL
    SELECT 'outcome_days', 1, count(outcome_days) FROM totals UNION ALL
    SELECT 'cum_cost_7d', 1, count(cum_cost_7d) FROM totals UNION ALL
    SELECT 'cum_revenue_7d', 1, count(cum_revenue_7d) FROM totals""", "totals"))
def manifest_columns(spark, sf):
    ledger = tables.ledger_totals(spark, sf)
    manifest = spark.range(1).select(F.array(F.struct(
        F.lit("outcomes").alias("role"), F.lit(49000).cast("long").alias("row_expected_min"),
        F.array(*[F.lit(c) for c in ["node_id", "business", "business_name", "online_day", "outcome_days",
                                     "cum_cost_7d", "cum_revenue_7d"]]).alias("required_cols"))).alias("inputs"))
    path = files.write_metrics_json(manifest, stage_path(spark, "manifest"))
    required = files.read_manifest(spark, path).where("role = 'outcomes'").first()["required_cols"]
    return checks.required_columns(ledger, required)
