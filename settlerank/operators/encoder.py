"""Node attributes as comparable vectors: category codes and quantile-mapped, normalised numbers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlerank.fixed_values import CAT_COLS, NUM_COLS
from settlerank.functions import known, no_nan, positive_or_null
from settlerank.operators.knn import unit_length
from settlerank.operators.percentiles import exact_percentiles, long_values

RARE = "__RARE__"


def rare_values(attrs: DataFrame, cats: Sequence[str]) -> DataFrame:
    """(node_id, rare): the columns in which a node holds a value that nobody else has.

    Counting combines before the shuffle. A value seen once belongs to one node, so the outcome is keyed by
    node and no later join meets a hot category.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), known(c).alias("value")) for c in cats])
    single = (attrs.select("node_id", F.explode(pairs).alias("x")).groupBy("x.field", "x.value")
              .agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).where(F.col("n") == 1))
    return single.groupBy("node_id").agg(F.collect_list("field").alias("rare"))


def fold_rare(attrs: DataFrame, cats: Sequence[str], rare: DataFrame | None) -> DataFrame:
    """Replace values seen once by one common token per column."""
    if rare is None:
        return attrs
    joined = attrs.join(rare, "node_id", "left")
    folded = [F.when(F.array_contains("rare", c), F.lit(RARE)).otherwise(known(c)).alias(c) for c in cats]
    return joined.select(*[c for c in attrs.columns if c not in cats], *folded)


@dataclass
class AttributeEncoder:
    """Fit keeps two small things on the driver: a median and at most ``n_quantiles`` knots per number."""

    cats: Sequence[str] = tuple(CAT_COLS)
    nums: Sequence[str] = tuple(NUM_COLS)
    n_quantiles: int = 500

    def fit(self, attrs: DataFrame) -> "EncoderModel":
        cats = [c for c in self.cats if c in attrs.columns]
        nums = [c for c in self.nums if c in attrs.columns]
        cleaned = attrs.select("node_id", *[known(c).alias(c) for c in cats],
                               *[positive_or_null(no_nan(F.col(c).try_cast("double"))).alias(c) for c in nums])
        medians: dict[str, float] = {}
        knots: dict[str, np.ndarray] = {}
        if nums:
            n = attrs.count()
            rows = exact_percentiles(long_values(cleaned, nums), ["field"], "value", [0.5]).collect()
            found = {r["field"]: r["value"] for r in rows}
            medians = {c: found[c] for c in nums if c in found}       # a column without values is left out
            filled = cleaned.select(*[F.coalesce(c, F.lit(medians[c])).alias(c) for c in medians])
            probs = list(np.linspace(0, 1, max(1, min(self.n_quantiles, n))))
            rows = exact_percentiles(long_values(filled, list(medians)), ["field"], "value", probs).collect()
            for c in medians:
                points = sorted((r["p"], r["value"]) for r in rows if r["field"] == c)
                knots[c] = np.maximum.accumulate(np.array([v for _, v in points]))
        rare = rare_values(attrs, cats) if cats else None
        return EncoderModel(cats, list(medians), medians, knots, rare)


@dataclass
class EncoderModel:
    cats: list[str]
    nums: list[str]
    medians: dict[str, float]
    knots: dict[str, np.ndarray]
    rare: DataFrame | None

    def quantile_positions(self, attrs: DataFrame) -> DataFrame:
        """Each number as its position in [0, 1]: the middle of its tie range, the ends at 0 and 1."""
        filled = attrs.select("node_id", *self.cats, *[
            F.coalesce(positive_or_null(no_nan(F.col(c).try_cast("double"))), F.lit(self.medians[c])).alias(c)
            for c in self.nums])
        knots = self.knots
        if not knots:
            return filled

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for c, q in knots.items():
                    x, ref = batch[c].to_numpy(dtype=float), np.linspace(0, 1, len(q))
                    y = (np.interp(x, q, ref) + 1.0 - np.interp(-x, -q[::-1], ref)) / 2
                    batch[c] = np.where(x == q[0], 0.0, np.where(x == q[-1], 1.0, y))
                yield batch

        return filled.mapInPandas(place, filled.schema)

    def transform(self, attrs: DataFrame) -> DataFrame:
        """(node_id, codes, numbers): folded categories and the unit-length number vector."""
        placed = self.quantile_positions(fold_rare(attrs.select("node_id", *self.cats, *self.nums), self.cats,
                                                   self.rare))
        codes = F.array(*[F.col(c) for c in self.cats]) if self.cats else F.array().cast("array<string>")
        raw = F.array(*[F.col(c) for c in self.nums]) if self.nums else F.array().cast("array<double>")
        return unit_length(placed.select("node_id", codes.alias("codes"), raw.alias("numbers")))


