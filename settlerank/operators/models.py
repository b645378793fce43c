"""Feature frames and gradient-boosted regressors (MLlib) for cost, revenue and profit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from settlerank.config import Settings
from settlerank.functions import known, zero_filled
from settlerank.operators.split import validation_flag
from settlerank.session import cut_lineage

STATS = ["cost_mean_log", "cost_p90_log", "profit_mean_log", "support_log"]
NEIGHBOUR = ["neighbour_cost", "neighbour_support_log"]
#: Parts that boosting works on: so many a core, and further ones only where a part would hold more rows than this.
_PARTS_A_CORE, _PART_ROWS = 3, 1 << 21


def feature_frame(pairs: DataFrame, attrs: DataFrame, stats: DataFrame, cats: Sequence[str],
                  nums: Sequence[str]) -> DataFrame:
    """Pairs with node attributes, business statistics and the prior; missing values filled."""
    global_mean = stats.agg(F.avg("cost_mean")).scalar()
    joined = pairs.join(attrs.select("node_id", *cats, *nums), "node_id", "left").join(
        stats.select("business", "cost_mean", *STATS), "business", "left")
    return joined.select(*pairs.columns, *[known(c).alias(c) for c in cats], *[zero_filled(c).alias(c) for c in nums],
                         *[zero_filled(c).alias(c) for c in STATS],
                         F.coalesce("cost_mean", global_mean, F.lit(0.0)).alias("biz_prior"))


def labelled(features: DataFrame, ledger: DataFrame) -> DataFrame:
    """Features joined to the pair's own amounts; the ledger is unique per pair, so nothing fans out."""
    return features.join(ledger.select("node_id", "business", "cum_cost_7d", "cum_revenue_7d", "cum_profit_7d"),
                         ["node_id", "business"], "left")


def category_domain(frames: Sequence[DataFrame], cats: Sequence[str]) -> DataFrame:
    """All values of each category column over the given frames."""
    def values(df):
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in cats])
        return df.select(F.explode(pairs).alias("x")).select("x.field", "x.value")
    out = values(frames[0])
    for df in frames[1:]:
        out = out.unionByName(values(df))
    return out.distinct()


@dataclass
class AmountModel:
    """A fitted regressor for one target. Predictions are never negative."""

    pipeline: PipelineModel
    target: str
    log_target: bool

    def predict(self, features: DataFrame, column: str) -> DataFrame:
        raw = self.pipeline.transform(features)
        value = F.expm1("prediction") if self.log_target else F.col("prediction")
        return raw.select(*features.columns, F.greatest(value, F.lit(0.0)).alias(column))


def best_round(errors: Sequence[float], patience: int) -> int:
    """The round (from 1) with the least error before ``patience`` rounds bring no gain."""
    best = 0
    for at, error in enumerate(errors):
        if error < errors[best]:
            best = at
        elif at - best >= patience:
            break
    return best + 1


def first_trees(fitted: GBTRegressionModel, keep: int) -> GBTRegressionModel:
    """The ensemble cut after its first trees; each tree was fitted on what the earlier ones left, so nothing is fitted again."""
    inner = fitted._java_obj
    gateway = SparkContext._active_spark_context._gateway
    ml = gateway.jvm.org.apache.spark.ml.regression
    trees, weights = gateway.new_array(ml.DecisionTreeRegressionModel, keep), gateway.new_array(gateway.jvm.double, keep)
    for at, (tree, weight) in enumerate(zip(list(inner.trees())[:keep], fitted.treeWeights)):
        trees[at], weights[at] = tree, float(weight)
    cut = GBTRegressionModel(ml.GBTRegressionModel(inner.uid(), trees, weights, inner.numFeatures()))
    return cut.setFeaturesCol(fitted.getFeaturesCol()).setPredictionCol(fitted.getPredictionCol())


def next_rounds(rounds: int, keep: int, most: int) -> int:
    """How many rounds to fit after ``rounds`` did not suffice.

    Twice as many, or five times while the last round is still the best; if another such step would go past ``most``, all at once.
    """
    wanted = rounds * (5 if keep == rounds else 2)
    return most if 2 * wanted > most else wanted


def training_parts(rows: DataFrame) -> DataFrame:
    """The rows in few parts, without a shuffle.

    Every level of every tree shuffles one histogram of each part, whatever its rows, so parts must not grow in number with
    the files of a large table.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(_PARTS_A_CORE * cores, -(-rows.count() // _PART_ROWS)))


def fit_amount(train: DataFrame, target: str, cats: Sequence[str], nums: Sequence[str], settings: Settings,
               log_target: bool = False, domain: DataFrame | None = None) -> AmountModel:
    """Boosted trees, stopped early by the error on a fixed random slice of the training rows.

    Rounds are fitted on the other rows and the error after each is taken on the slice, until ``settings.patience`` rounds
    bring no gain or all are used; the number of rounds grows in steps (``next_rounds``), so that a model that stops early is
    not fitted to the end and one that does not is fitted again few times. The model keeps the trees up to the best round
    (``first_trees``), which do not depend on the steps. The indexer marks its outputs as nominal, so the trees split
    categories as sets.
    """
    label = F.log1p(F.greatest(target, F.lit(0.0))) if log_target else F.col(target)
    rows = validation_flag(train, settings.validation_share, settings.seed).withColumn("label", label)
    rows = rows.where(F.col("label").isNotNull())
    indexed = [f"{c}_ix" for c in cats]
    indexer = StringIndexer(inputCols=list(cats), outputCols=indexed, handleInvalid="keep",
                            stringOrderType="alphabetAsc")
    if cats:
        indexer = indexer.fit(rows if domain is None else domain)
    widest = max([len(labels) for labels in indexer.labelsArray] + [2]) + 1 if cats else 2
    prepared = Pipeline(stages=([indexer] if cats else []) + [
        VectorAssembler(inputCols=indexed + list(nums), outputCol="features", handleInvalid="keep")]).fit(rows)
    rows = cut_lineage(prepared.transform(rows).select("features", "label", "is_valid"), "features")
    trainer = GBTRegressor(featuresCol="features", labelCol="label", maxIter=settings.n_trees,
                     stepSize=settings.learning_rate, maxDepth=settings.max_depth,
                     minInstancesPerNode=settings.min_child, subsamplingRate=settings.row_sample,
                     maxBins=max(64, widest + 1), seed=settings.seed)
    seen, held = training_parts(rows.where(~F.col("is_valid"))), rows.where("is_valid")
    if held.isEmpty():
        fitted = trainer.fit(seen)
    else:
        rounds, keep = min(settings.n_trees, 2 * settings.patience), 0
        while True:
            fitted = trainer.copy({trainer.maxIter: rounds}).fit(seen)
            keep = best_round(fitted.evaluateEachIteration(held, "squared"), settings.patience)
            if rounds - keep >= settings.patience or rounds == settings.n_trees:
                break
            rounds = next_rounds(rounds, keep, settings.n_trees)
        if keep < rounds:
            fitted = first_trees(fitted, keep)
    return AmountModel(PipelineModel(stages=[*prepared.stages, fitted]), target, log_target)
