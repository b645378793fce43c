"""Percentiles, pool rankings, streaks, scores and edge rows."""

from datetime import date, timedelta

import numpy as np
import pytest

from settlerank.config import SECOND_GENERATION, Settings, from_environment
from settlerank.operators import baselines, candidates, checks, evaluation, ledger, ranking, reports, scoring, streaks
from settlerank.operators.percentiles import exact_percentiles


def test_percentiles_match_linear_interpolation(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": np.round(rng.gamma(2, 50, 4000), 1), "ties": np.repeat([1.0, 2.0, 7.0], 30),
              "one": np.array([4.5]), "two": np.array([1.0, 2.0])}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None), ("hot", float("nan")),
                                                                            ("none", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for ranges in (4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        got = {(r.g, r.p): r.value for r in exact_percentiles(df, ["g"], "v", probs).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert {g for g, _ in got} == set(groups)
        for g, values in groups.items():
            for p in probs:
                assert got[(g, p)] == pytest.approx(np.quantile(values, p), abs=1e-9)


def test_pool_with_overrides_equals_ranking_every_pair(spark):
    rng = np.random.default_rng(2)
    pool = {f"b{i:02d}": float(rng.integers(0, 12)) for i in range(30)}
    over = {(f"k{k}", b): float(rng.integers(0, 14)) for k in range(20) for b in pool if rng.random() < k / 20}
    keys = spark.createDataFrame([(f"k{k}",) for k in range(20)], "seg string")
    got = baselines.pool_with_overrides(
        keys, "seg", spark.createDataFrame([(k, b, s) for (k, b), s in over.items()],
                                           "seg string, business string, score double"),
        spark.createDataFrame(list(pool.items()), "business string, score double"))
    found = {(r.seg, r["rank"]): r.business for r in got.collect()}
    for k in range(20):
        scores = {b: over.get((f"k{k}", b), s) for b, s in pool.items()}
        best = sorted(scores, key=lambda b: (-scores[b], b))[:3]
        assert [found[(f"k{k}", i)] for i in (1, 2, 3)] == best


def test_spread_pool_gives_every_pair_once(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node_id string")
    pool = spark.createDataFrame([(f"b{i}",) for i in range(7)], "business string")
    got = baselines.spread_pool(nodes, pool, chunk=3)
    assert got.count() == 14 and got.distinct().count() == 14


def daily(spark, rows):
    return spark.createDataFrame([(n, b, date(2026, 3, 1) + timedelta(days=d), c, r, (r or 0.0) - (c or 0.0))
                                  for n, b, d, c, r in rows],
                                 "node_id string, business string, day date, cost double, revenue double, profit double")


def test_streaks(spark):
    rows = [("full", "x", d, 1.0, 2.0) for d in range(12)]
    rows += [("gap", "x", d, 1.0, 2.0) for d in (0, 1, 2, 3, 5, 6)] + [("gap", "y", 6, 1.0, 9.0)]
    rows += [("poor", "x", 4, 3.0, 0.0), ("poor", "x", 5, 3.0, None)]
    df = daily(spark, rows)
    got = {r.node_id: r.streak for r in streaks.trailing_streak(df).collect()}
    assert got == {"full": 7, "gap": 2, "poor": 2}
    now = {r.node_id: r for r in streaks.current_business(df).collect()}
    assert set(now) == {"full", "gap"}                       # no revenue in the window: no current run
    assert now["gap"].cur_business == "y" and now["gap"].days == 2 and now["gap"].streak_label == "近2天"
    assert now["full"].cur_cost == 7.0 and now["full"].cur_profit == 7.0 and now["full"].streak_label == "近7天"


def test_strict_seven_days(spark):
    rows = [("old", "x", d, 1.0, 2.0) for d in range(8)] + [("old", "x", 20, 1.0, 2.0)]     # last run is too short
    rows += [("fold", "x", d, 5.0, 0.0) for d in range(10, 18)] + [("fold", "0", d, 0.0, 4.0) for d in range(10, 18)]
    rows += [("dry", "x", d, 5.0, 0.0) for d in range(10, 18)] + [("short", "x", 3, 1.0, 1.0)]
    got = {r.node_id: r for r in streaks.current_seven_days(daily(spark, rows)).collect()}
    assert got["old"].has_cur == 1 and got["old"].cur_end == date(2026, 3, 8)
    assert got["fold"].cur_business == "x" and got["fold"].cur_cost7 == 35.0 and got["fold"].cur_profit7 == -7.0
    assert got["dry"].has_cur == 0 and got["dry"].cur_business is None and got["short"].has_cur == 0


def pairs(spark, rows):
    return spark.createDataFrame(rows, "node_id string, business string, pred_cost double, pred_profit double, "
                                       "profit_p10 double")


def test_scores_on_edge_rows(spark):
    df = pairs(spark, [("one", "a", 5.0, 1.0, 1.0), ("flat", "a", 5.0, -1.0, 1.0), ("flat", "b", 5.0, 1.0, -1.0),
                       ("n", "a", 10.0, -5.0, 1.0), ("n", "b", 8.0, 2.0, 1.0), ("n", "c", 0.0, 2.0, None)])
    got = {(r.node_id, r.business): r for r in scoring.score_full_pool(df).collect()}
    assert got[("one", "a")].cost_norm == 0.5 and got[("flat", "a")].soft_score == pytest.approx(0.5 - 0.8 * 0.5)
    assert got[("n", "a")].soft_score == pytest.approx(0.2) and got[("n", "c")].eligible == 0
    top = {(r.node_id, r["rank"]): r.business for r in scoring.gated_top(scoring.score_full_pool(df)).collect()}
    assert [top[("n", i)] for i in (1, 2, 3)] == ["b", "a", "c"]
    assert top[("flat", 1)] == "b" and ("one", 2) not in top           # no eligible row: no gate
    cap = spark.createDataFrame([("a", 50.0, 100.0), ("b", None, 100.0), ("c", 5.0, 0.0)],
                                "business string, over_capacity_mbps double, capacity_upper_mbps double")
    pen = {(r.node_id, r.business): r.cap_pen for r in scoring.score_v1(df, cap).collect()}
    assert pen[("n", "a")] == pytest.approx(-0.15) and pen[("n", "b")] == 0 and pen[("n", "c")] == 0


def test_second_score_normalises_inside_the_node(spark):
    df = pairs(spark, [("n", "a", 10.0, 1.0, 1.0), ("n", "b", 8.0, 2.0, 1.0), ("m", "a", 1.0, 1.0, 1.0)])
    peaks = spark.createDataFrame([("n", "a", 40.0), ("n", "b", 80.0)], "node_id string, business string, peak_mbps double")
    got = {(r.node_id, r.business): r for r in scoring.score_v2(df, peaks, SECOND_GENERATION).collect()}
    assert got[("n", "a")].score_on == pytest.approx(10 + 0.1 * 0.5) and got[("n", "b")].bw_norm == 1.0
    assert got[("m", "a")].bw_norm == 0.0


def test_candidates_fallback_gate_and_skip(spark):
    near = spark.createDataFrame([("q", "t1"), ("e", "t9")], "node_id string, neighbour_id string")
    train = spark.createDataFrame([("t1", "a"), ("t1", "z"), ("t2", "b")], "node_id string, business string")
    own = spark.createDataFrame([("q", "b"), ("q", "out")], "node_id string, business string")
    pool = spark.createDataFrame([(b,) for b in "abczd"], "business string")
    gated = spark.createDataFrame([("z",), ("a",)], "business string")
    nodes = spark.createDataFrame([("q",), ("e",)], "node_id string")
    got = candidates.candidate_pairs(near, train, own, pool)
    assert {tuple(r) for r in got.collect()} == {("q", "a"), ("q", "z"), ("q", "b")}
    got = candidates.candidate_pairs(near, train, own, pool, gated)
    filled = candidates.with_fallback(nodes, got, candidates.fallback_businesses(pool, gated))
    assert {tuple(r) for r in filled.collect()} == {("q", "b", 0), ("e", "b", 1), ("e", "c", 1), ("e", "d", 1)}
    skipped = candidates.with_fallback(nodes, got, candidates.fallback_businesses(pool, gated), skip=True)
    assert {r.node_id for r in skipped.collect()} == {"q"}


def test_candidates_of_profiles_travel_as_lists(spark):
    near = spark.createDataFrame([("p", "t1"), ("p", "t2"), ("r", "t2"), ("r", "t9")], "node_id string, neighbour_id string")
    train = spark.createDataFrame([("t1", "a"), ("t1", "a"), ("t2", "a"), ("t2", "b"), ("t2", None), ("t2", "out")], "node_id string, business string")
    members = spark.createDataFrame([("n", "p"), ("m", "p"), ("k", "r"), ("l", "none")], "node_id string, profile_id string")
    own = spark.createDataFrame([("n", "c"), ("n", "a"), ("n", "c"), ("o", "b"), ("l", "out"), (None, "c"), (None, "c")], "node_id string, business string")
    pool = spark.createDataFrame([(b,) for b in "abc"], "business string")
    got = candidates.candidate_pairs(near, train, own, pool, members=members)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(n, b) for n, bs in (
        ("n", "abc"), ("m", "ab"), ("k", "ab"), ("o", "b"), (None, "c")) for b in bs], key=str)
    # one row a node meets the rows of other profiles and its own: no list is opened before the last step
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and plan.index("Generate") < plan.index("Aggregate")


def test_truth_ties_and_hits(spark):
    led = spark.createDataFrame([("n", "b", 5.0), ("n", "a", 5.0), ("m", "c", None), ("m", "d", 1.0)],
                                "node_id string, business string, cum_cost_7d double")
    truth = ranking.true_best(led)
    assert {tuple(r)[:2] for r in truth.collect()} == {("n", "a"), ("m", "d")}
    recs = spark.createDataFrame([("n", 1, "x", 1), ("n", 2, "a", 0), ("m", 1, "d", 0)],
                                 "node_id string, rank int, business string, profit_positive int")
    rates = evaluation.hit_rates(evaluation.hits(recs, truth)).first()
    assert (rates.n, rates.hit_at_1, rates.hit_at_3, rates.top1_profit_positive_rate) == (2, 0.5, 1.0, 0.5)


def test_error_formula(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, -3.0), (6.0, 5.0), (None, 1.0)], "y double, p double")
    got = evaluation.regression_error(df, "y", "p").first()
    y, p = np.array([1, 2, 6.0]), np.array([2, 0, 5.0])
    assert got.n == 3 and got.mae == pytest.approx(np.abs(y - p).mean())
    assert got.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.wape == pytest.approx(np.abs(y - p).sum() / y.sum())


def test_ledger_edges(spark):
    rows = spark.createDataFrame(
        [("n", "x", date(2026, 1, 1), 1.0, None), ("n", "x", date(2026, 1, 7), None, 2.0),
         ("n", "x", date(2026, 1, 8), 9.0, 9.0)], "node_id string, business string, day date, cost double, revenue double")
    got = ledger.first_window_ledger(rows).first()
    assert (got.outcome_days, got.cum_cost_7d, got.cum_revenue_7d) == (2, 1.0, 2.0)
    odd = spark.createDataFrame([("a", float("nan")), ("b", 7.0), ("c", None)], "node_id string, outcome_days double")
    assert [r.node_id for r in ledger.complete_windows(odd).collect()] == ["b"]
    attrs = spark.createDataFrame([("a", 2), ("a", 1), (None, 3)], "node_id string, bw int")
    assert [tuple(r) for r in ledger.unique_nodes(attrs, ["bw"]).collect()] == [("a", 1)]
    with pytest.raises(ValueError):
        ledger.join_attributes(odd, attrs, check=True)


def test_pair_median_and_unit_best(spark):
    rec = spark.createDataFrame([("n", "a", v) for v in (1.0, 1.0, 4.0, 10.0)] + [("n", "b", 3.0), ("n", "b", None)],
                                "node_id string, business string, build_bandwidth double")
    med = {r.business: r.cap_bw for r in reports.pair_bandwidth(rec).collect()}
    assert med == {"a": 2.5, "b": 3.0}
    led = spark.createDataFrame([("n", "a", 10.0), ("n", "b", 11.0)], "node_id string, business string, cum_cost_7d double")
    best = reports.best_by_cost_and_unit(reports.unit_yield(led, reports.pair_bandwidth(rec))).first()
    assert (best.abs_best, best.unit_best, best.same) == ("b", "a", 0)


def test_checks(spark):
    metrics = spark.createDataFrame([(0.2, None)], "hit1 double, wape double")
    got = {r.check: r.ok for r in checks.in_range(checks.metric_rows(metrics, ["hit1", "wape"]), [
        ("hit1", 0.19, 0.23), ("wape", 0.0, 1.0), ("absent", 0, 1)]).collect()}
    assert got == {"hit1": 1, "wape": 0, "absent": 0}
    cols = {r.column: (r.present, r.filled) for r in checks.required_columns(metrics, ["hit1", "bw"]).collect()}
    assert cols == {"hit1": (1, 1), "bw": (0, 0)}


def test_capacity_from_daily_peaks(spark):
    rows = [("n", "a", date(2026, 1, d), float(v)) for d, v in ((1, 10), (2, 20), (3, 30), (4, 70))]
    df = spark.createDataFrame(rows, "node_id string, business string, day date, peak_mbps double")
    got = reports.business_capacity(df).first()
    assert got.traffic_p75_mbps == pytest.approx(40.0) and got.capacity_upper_mbps == pytest.approx(40 / 0.7)
    assert got.over_capacity_mbps == pytest.approx(70 - 40 / 0.7) and got.can_add_mbps == 0.0


def test_settings_from_environment():
    got = from_environment(Settings(), {"SETTLERANK_KNN_K": "7", "SETTLERANK_GATE": "1", "SETTLERANK_CUT_DAY": "",
                                        "SETTLERANK_W_PROFIT": "0.5"})
    assert (got.knn_k, got.gate, got.cut_day, got.w_profit, got.min_support) == (7, True, None, 0.5, 20)


def test_amplification_without_truth_share_is_null(spark):
    rec = spark.createDataFrame([("a",), ("a",), ("b",)], "business string")
    truth = spark.createDataFrame([("b",), ("c",)], "true_best string")
    got = {r.business: r for r in evaluation.amplification(rec, truth).collect()}
    assert got["a"].ratio is None and got["b"].ratio == pytest.approx(0.67, abs=0.01) and got["c"].rec_pct == 0
