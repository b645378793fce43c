"""Metrics documents of any shape, read as VARIANT values and looked up by dotted path."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from settlerank.sources.files import path_exists


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``file`` and ``doc`` (VARIANT). Text that is no JSON gives a null document.

    Every file below the path that is not blank is one document, on one line or many; files are read by the tasks.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    text = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return text.where(F.length(F.trim("value")) > 0).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("doc"))


def json_path(dotted: str) -> str:
    """``a.b.0.c`` as ``$['a']['b'][0]['c']``: names between dots, and whole numbers as places in an array."""
    parts = dotted.split(".")
    if not all(parts):
        raise ValueError(f"empty name in path {dotted!r}")
    return "$" + "".join(f"[{p}]" if re.fullmatch(r"\d+", p) else "['" + p.replace("'", "\\'") + "']" for p in parts)


def at_path(doc: Column, dotted: str, kind: str = "double") -> Column:
    """The value at a dotted path; null where the path is missing or the value has another type."""
    return F.try_variant_get(doc, json_path(dotted), kind)


def metrics_at(docs: DataFrame, paths: Sequence[str], kind: str = "double") -> DataFrame:
    """Long rows file, path, present, value. A JSON null is present without a value."""
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.try_variant_get("doc", json_path(p), "variant").isNotNull().alias("present"),
                                        at_path(F.col("doc"), p, kind).alias("value")) for p in paths]))
    return docs.select("file", rows.alias("m")).select("file", "m.*")


def within(docs: DataFrame, expected: Sequence[tuple[str, float, float]]) -> DataFrame:
    """file, metric, value, low, high, passed: a missing path, a null and a value of another type fail."""
    found = metrics_at(docs, [p for p, _, _ in expected])
    limits = docs.sparkSession.createDataFrame([(p, float(a), float(b)) for p, a, b in expected], "path string, low double, high double")
    passed = F.coalesce(F.col("present") & (F.col("value") >= F.col("low")) & (F.col("value") <= F.col("high")), F.lit(False))
    return found.join(limits, "path").select("file", F.col("path").alias("metric"), "value", "low", "high", passed.alias("passed"))
