"""The ledger by days: parts, order, repeated and replaced days, and what is read."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from settlerank.operators.daystore import DayStore
from settlerank.operators.ledger import first_window_ledger
from settlerank.session import stage_path

START = date(2026, 1, 1)
SCHEMA = "node_id string, business string, day date, cost double, revenue double"


def facts(dice, nodes=25, days=30, n=220):
    found = {}
    for _ in range(n):
        key = (f"n{dice.randrange(nodes)}", f"b{dice.randrange(3)}", START + timedelta(days=dice.randrange(days)))
        found[key] = (*key, float(dice.randrange(100)), None if dice.random() < 0.1 else float(dice.randrange(100)))
    return list(found.values())


def rows(df):
    cols = ["node_id", "business", "business_online_day", "outcome_days", "cum_cost_7d", "cum_revenue_7d"]
    return sorted(map(tuple, df.select(cols).collect()))


def of(spark, some):
    return spark.createDataFrame(some, SCHEMA)


def test_parts_in_any_order_equal_one_load(spark):
    dice = random.Random(3)
    every = facts(dice)
    expected = rows(first_window_ledger(of(spark, every)))
    for cuts in ([10, 20], [20, 3]):
        store = DayStore(spark, stage_path(spark, "days"))
        marks = [0, *sorted(cuts), 30]
        parts = [[r for r in every if a <= (r[2] - START).days < b] for a, b in zip(marks, marks[1:])]
        for part in parts if cuts == [10, 20] else reversed(parts):
            store.load(of(spark, part))
        assert rows(store.ledger) == expected


def test_replaced_days(spark):
    dice = random.Random(4)
    every = facts(dice)
    store = DayStore(spark, stage_path(spark, "days"))
    store.load(of(spark, every))
    again = START + timedelta(days=2)
    new = [("n1", "b1", again, 5.0, 1.0), ("brand new", "b9", again, 7.0, None), (None, "b1", again, 1.0, 1.0)]
    store.load(of(spark, new))                                   # others lose the day, and maybe their first one
    every = [r for r in every if r[2] != again] + new
    assert rows(store.ledger) == rows(first_window_ledger(of(spark, every)))
    gone = START + timedelta(days=5)
    store.load(of(spark, []), replaced=[gone])
    every = [r for r in every if r[2] != gone]
    assert rows(store.ledger) == rows(first_window_ledger(of(spark, every)))
    assert store.daily.where(F.col("node_id").isNotNull()).count() == len([r for r in every if r[0]])


def test_pair_that_moves_leaves_no_row_behind(spark):
    store = DayStore(spark, stage_path(spark, "days"))
    late, early = START + timedelta(days=8), START + timedelta(days=6)
    store.load(of(spark, [("n", "b", late, 1.0, 1.0)]))
    store.load(of(spark, [("n", "b", early, 2.0, 2.0)]))
    assert rows(store.ledger) == [("n", "b", early, 2, 3.0, 3.0)]


def test_closed_windows_stay_and_old_days_are_not_read(spark):
    dice = random.Random(5)
    store = DayStore(spark, stage_path(spark, "days"))
    store.load(of(spark, [r for r in facts(dice, n=400) if (r[2] - START).days < 25]))
    last = START + timedelta(days=25)
    closed = store.ledger.where(F.col("business_online_day") < F.lit(last - timedelta(days=6)))
    before = rows(closed)
    told = store.load(of(spark, [("n1", "b1", last, 9.0, 9.0), ("fresh", "b1", last, 1.0, 1.0)]))
    assert told["read_from"] == last - timedelta(days=6) and told["pairs"] <= 2
    assert rows(closed) == before
    windows = store.open_windows(store.ledger.select("node_id", "business"), store.ledger, last)
    scans = [x for x in windows._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan" in x and ",cost#" in x]
    assert scans and all("day" in x.split("PartitionFilters: [")[1].split("]")[0] and ">=" in x for x in scans)


def test_empty_load(spark):
    store = DayStore(spark, stage_path(spark, "days"))
    assert store.load(of(spark, []))["days"] == [] and store.ledger.count() == 0


@pytest.mark.parametrize("window", [3])
def test_other_window_lengths(spark, window):
    every = facts(random.Random(6))
    store = DayStore(spark, stage_path(spark, "days"), window)
    for odd in (1, 0):
        store.load(of(spark, [r for r in every if r[2].day % 2 == odd]))
    assert rows(store.ledger) == rows(first_window_ledger(of(spark, every), window))
