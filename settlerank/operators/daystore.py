"""A ledger that grows by days: stored facts by day, and first-window totals brought up to date for open windows only.

``daily`` is partitioned by day and ``ledger`` by the first day of a pair. A load replaces the partitions of its days (dynamic
overwrite). Windows that closed before the first loaded day cannot change, so of the facts only the partitions from six days
before that day on are read, and of the ledger only partitions are written whose pairs changed. Loading days in any order, in
parts, or again gives the ledger of one load.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlerank.operators.ledger import first_window_ledger
from settlerank.session import cut_lineage
from settlerank.sources.files import path_exists

PAIR = ["node_id", "business"]
DAILY = "node_id string, business string, cost double, revenue double, day date"
LEDGER = "node_id string, business string, outcome_days int, cum_cost_7d double, cum_revenue_7d double, business_online_day date"
FIRST = "business_online_day"


@dataclass
class DayStore:
    """Facts and ledger under one folder that all executors reach."""

    spark: SparkSession
    folder: str
    days: int = 7

    @property
    def daily(self) -> DataFrame:
        return self._read("daily", DAILY)

    @property
    def ledger(self) -> DataFrame:
        """One row for each node and business."""
        return self._read("ledger", LEDGER).where(F.col("node_id").isNotNull())

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        if not path_exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    def _replace(self, rows: DataFrame, name: str, by: str) -> None:
        """Replace the partitions that ``rows`` has values of."""
        rows.repartition(by, F.pmod(F.xxhash64(*PAIR), F.lit(self._parts))).write.mode("overwrite") \
            .option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.folder}/{name}")

    @cached_property
    def _parts(self) -> int:
        """Files of one partition, so that one large day is not one task."""
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)

    def load(self, rows: DataFrame, replaced: Sequence[date] = ()) -> dict[str, object]:
        """Take in whole days: ``rows`` (node_id, business, day, cost, revenue), and ``replaced`` days that may have no rows.

        Rows without a node, business or day are left out; several rows of one pair and day are added up. Returns the loaded
        days, the first day whose facts were read, and the pairs whose windows were made anew.
        """
        keyed = rows.where(F.col("node_id").isNotNull() & F.col("business").isNotNull() & F.col("day").isNotNull())
        fresh = keyed.groupBy(*PAIR, "day").agg(F.sum("cost").alias("cost"), F.sum("revenue").alias("revenue"))
        fresh = cut_lineage(fresh.select(*PAIR, "cost", "revenue", "day"), "day-rows")
        loaded = sorted({r["day"] for r in fresh.select("day").distinct().collect()} | set(replaced))       # calendar days
        if not loaded:
            return {"days": [], "read_from": None, "pairs": 0}
        touched = fresh.select(*PAIR).union(self.daily.where(F.col("day").isin(loaded)).select(*PAIR))
        touched = cut_lineage(touched.where(F.col("node_id").isNotNull()).distinct(), "touched-pairs")
        emptied = self.spark.createDataFrame([(None, None, None, None, d) for d in loaded], DAILY).join(
            fresh.select("day").distinct(), "day", "left_anti").select(*fresh.columns)
        self._replace(fresh.unionByName(emptied), "daily", "day")
        return {"days": loaded, "read_from": loaded[0] - timedelta(days=self.days - 1), "pairs": self._renew(touched, loaded[0])}

    def _renew(self, touched: DataFrame, first_loaded: date) -> int:
        """Make the windows of the touched pairs anew, where they reach into the loaded days."""
        start = first_loaded - timedelta(days=self.days - 1)
        ledger = self.ledger
        closed = ledger.where(F.col(FIRST) < F.lit(start)).select(*PAIR)
        open_pairs = cut_lineage(touched.join(closed, PAIR, "left_anti"), "open-pairs")
        recent = cut_lineage(ledger.where(F.col(FIRST) >= F.lit(start)), "recent-ledger")
        windows = self.open_windows(open_pairs, recent, first_loaded)
        windows = cut_lineage(windows.select(recent.columns), "open-windows")

        old = recent.join(open_pairs, PAIR, "left_semi").select(FIRST)
        changed = cut_lineage(old.union(windows.select(FIRST)).distinct(), "changed-days")                   # calendar days
        kept = recent.join(open_pairs, PAIR, "left_anti").join(changed, FIRST, "left_semi").select(recent.columns)
        now = cut_lineage(kept.unionByName(windows), "changed-ledger")
        # a day whose last pair moved gets an empty row, since only partitions with rows are replaced
        gone = changed.join(now.select(FIRST).distinct(), FIRST, "left_anti").select(
            *[F.lit(None).cast(t).alias(c) for c, t in recent.dtypes if c != FIRST], FIRST)
        self._replace(now.unionByName(gone.select(now.columns)), "ledger", FIRST)
        return open_pairs.count()

    def open_windows(self, pairs: DataFrame, recent: DataFrame, first_loaded: date) -> DataFrame:
        """Totals of the windows of ``pairs``, which all start at most six days before the first loaded day.

        A stored first day before that day stays the first; any other is looked for in the facts from that day on.
        """
        start = first_loaded - timedelta(days=self.days - 1)
        facts = self.daily.where((F.col("day") >= F.lit(start)) & F.col("node_id").isNotNull())
        stays = recent.where(F.col(FIRST) < F.lit(first_loaded)).select(*PAIR, F.col(FIRST).alias("_first"))
        mine = facts.join(pairs, PAIR, "left_semi").join(stays, PAIR, "left")
        inside = mine.where(F.col("day") >= F.coalesce("_first", F.lit(first_loaded))).drop("_first")
        return first_window_ledger(inside, self.days)
