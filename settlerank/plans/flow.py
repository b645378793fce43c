"""The stages every recommendation plan shares: ledger, split, statistics, pool, truth, similarity.

Each stage is a DataFrame. Tables that several later stages read are stored once as a
stage table in the shared folder, so the fact tables are scanned once per plan. Plans of one application
hand these tables over to each other, as batch stages do; ``forget_flows`` starts afresh.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from settlerank.config import Settings
from settlerank.functions import segment_key
from settlerank.operators import candidates, knn, ledger, ranking, scoring, split, stats
from settlerank.operators.encoder import AttributeEncoder
from settlerank.operators.reports import business_capacity
from settlerank.session import cut_lineage
from settlerank.sources import tables


class SalesFlow:
    def __init__(self, spark: SparkSession, sf_dir: str, settings: Settings = Settings()):
        self.spark, self.sf_dir, self.settings = spark, sf_dir, settings

    def table(self, name: str) -> DataFrame:
        return tables.table(self.spark, self.sf_dir, name)

    @cached_property
    def sold_days(self) -> DataFrame:
        """The sales per node, business and day; ledger and traffic both come from it, so the facts are joined once."""
        return cut_lineage(tables.sold_days(self.spark, self.sf_dir), "sold-days")

    @cached_property
    def _ledger(self) -> DataFrame:
        """The ledger with ``_has_attrs``. It is dealt out by node already, so only the keys travel to this join."""
        keys = tables.node_keys(self.spark, self.sf_dir).distinct().withColumn("_has_attrs", F.lit(True))
        return cut_lineage(tables.ledger_totals(self.spark, self.sf_dir, self.sold_days).join(keys, "node_id", "left"))

    @cached_property
    def totals(self) -> DataFrame:
        return self._ledger.drop("_has_attrs")

    @cached_property
    def attrs(self) -> DataFrame:
        return cut_lineage(tables.node_attributes(self.spark, self.sf_dir), "attrs")

    @cached_property
    def frame(self) -> DataFrame:
        """Ledger rows of nodes that have attributes (attributes are unique per node)."""
        return ledger.pick_pool_side(self._ledger.where("_has_attrs").drop("_has_attrs"), self.settings.pool_side,
                                     self.settings.pool_prefix)

    @cached_property
    def split(self) -> DataFrame:
        nodes = cut_lineage(split.first_days(self.frame))
        return cut_lineage(split.temporal_split(nodes, self.settings.train_ratio, self.settings.cut_day))

    @cached_property
    def sided(self) -> DataFrame:
        return cut_lineage(split.with_side(self.frame, self.split), "sided", "zstd")

    @cached_property
    def train(self) -> DataFrame:
        return self.sided.where(~F.col("is_test"))

    @cached_property
    def test(self) -> DataFrame:
        return self.sided.where("is_test")

    @cached_property
    def stats(self) -> DataFrame:
        """One row per business; stored because pool, priors and features all read it."""
        return cut_lineage(stats.business_stats(self.train))

    @cached_property
    def pool(self) -> DataFrame:
        return stats.support_pool(self.stats, self.settings.min_support)

    @cached_property
    def truth(self) -> DataFrame:
        return ranking.true_best(self.test)

    @cached_property
    def pool_train(self) -> DataFrame:
        return ranking.restrict_to_pool(self.train, self.pool)

    @cached_property
    def prior(self) -> DataFrame:
        return stats.business_prior(self.pool_train)

    @cached_property
    def segments(self) -> DataFrame:
        return self.attrs.select("node_id", segment_key(*tables.SEGMENT).alias("seg"))

    @cached_property
    def segment_stats(self) -> DataFrame:
        """One row per segment and business; stored, so that the pairs that read it meet its true size."""
        return cut_lineage(stats.segment_stats(self.pool_train.join(self.segments, "node_id")), "segment-stats")

    @cached_property
    def predicted(self) -> DataFrame:
        return cut_lineage(self._predicted())

    def _predicted(self) -> DataFrame:
        """Own pairs with surrogate predictions: the segment mean, with the business mean as one more row."""
        own = self.sided.select("node_id", "business", "is_test", "cum_cost_7d", "cum_profit_7d")
        return self.predict(own)

    def predict(self, pairs: DataFrame) -> DataFrame:
        pool = self.pool.select("business", "cost_mean", "profit_mean", "profit_p10")
        values = self.segment_stats.select("seg", "business", "seg_rows", "seg_cost_sum", "seg_profit_sum")
        rows = F.coalesce("seg_rows", F.lit(0)) + 1

        def shrunk(total: str, mean: str):
            return (F.coalesce(total, F.lit(0.0)) + F.col(mean)) / rows

        return (pairs.join(self.segments, "node_id").join(pool, "business")
                .join(values, ["seg", "business"], "left")
                .select(*pairs.columns, shrunk("seg_cost_sum", "cost_mean").alias("pred_cost"),
                        shrunk("seg_profit_sum", "profit_mean").alias("pred_profit"), "profit_p10"))

    @cached_property
    def daily_peaks(self) -> DataFrame:
        """Traffic per node, business and day: the sold quantity stands for the peak."""
        return self.sold_days.select("node_id", "business", "day", F.col("quantity").alias("peak_mbps"))

    @cached_property
    def stored_peaks(self) -> DataFrame:
        return self.daily_peaks

    @cached_property
    def capacity(self) -> DataFrame:
        """One row per business; stored, so that a join with it sends no pair to its business."""
        return cut_lineage(business_capacity(self.daily_peaks, pairs=self.peaks), "capacity")

    @cached_property
    def peaks(self) -> DataFrame:
        return cut_lineage(scoring.peak_per_pair(self.daily_peaks), "peaks")

    @cached_property
    def nominal(self) -> DataFrame:
        return self.attrs.select("node_id", F.col("n_orders").alias("nominal_bw"))

    @cached_property
    def on_off(self) -> DataFrame:
        return cut_lineage(scoring.score_aux(self.predicted, self.capacity, self.peaks, self.nominal, self.settings))

    def recs(self, score: str) -> DataFrame:
        return ranking.recommendation_rows(scoring.best_by_score(self.on_off, score))

    @cached_property
    def names(self) -> DataFrame:
        return ledger.name_map(self.totals)

    @cached_property
    def vectors(self) -> DataFrame:
        encoder = AttributeEncoder(tables.CATS, tables.NUMS, self.settings.n_quantiles)
        return cut_lineage(encoder.fit(self.attrs).transform(self.attrs), "vectors", "zstd")

    @cached_property
    def space(self) -> knn.CosineSpace:
        return knn.CosineSpace(self.settings.cat_weight, self.settings.num_weight)

    def side_vectors(self, is_test: bool | None = None) -> DataFrame:
        chosen = self.split if is_test is None else self.split.where(F.col("is_test") == F.lit(is_test))
        return self.vectors.join(chosen.select("node_id"), "node_id", "left_semi")

    def neighbours(self, k: int, queries: DataFrame | None = None) -> DataFrame:
        asked = self.side_vectors() if queries is None else queries
        return cut_lineage(knn.nearest(asked, self.side_vectors(False), k, self.space), "near", "zstd")

    @cached_property
    def near(self) -> DataFrame:
        return self.neighbours(self.settings.knn_k)

    @cached_property
    def profiles(self) -> tuple[DataFrame, DataFrame]:
        members, profiles = knn.shared_profiles(self.side_vectors())
        return cut_lineage(members, "members", "zstd"), profiles

    @cached_property
    def profile_near(self) -> DataFrame:
        """Neighbours per distinct attribute profile, for everything that is the same for equal nodes."""
        return self.neighbours(self.settings.knn_k, self.profiles[1])

    @cached_property
    def candidate_pairs(self) -> DataFrame:
        return candidates.candidate_pairs(self.profile_near, self.train, candidates.run_history(self.frame), self.pool,
                                          members=self.profiles[0])

    @cached_property
    def candidates(self) -> DataFrame:
        fallback = candidates.fallback_businesses(self.pool)
        return candidates.with_fallback(self.split, cut_lineage(self.candidate_pairs, "pairs", "zstd"), fallback)


_FLOWS: dict[tuple, SalesFlow] = {}


def flow_of(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> SalesFlow:
    """The flow of this application over these inputs; its stored stages serve every plan that asks."""
    key = (spark.sparkContext.applicationId, sf_dir, settings)
    if key not in _FLOWS:
        _FLOWS[key] = SalesFlow(spark, sf_dir, settings)
    return _FLOWS[key]


def forget_flows() -> None:
    _FLOWS.clear()
