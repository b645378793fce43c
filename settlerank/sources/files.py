"""Text and Parquet sources and sinks. Every column is read as text first and then cast leniently."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from settlerank.functions import business_id, text_or_null, to_day, to_number
from settlerank.schemas import MANIFEST

KEYS = ("business",)


def lower_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def conform(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast text columns to the declared schema; a column the file lacks becomes null."""
    out = []
    for field in schema.fields:
        if field.name not in raw.columns:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
        elif isinstance(field.dataType, T.DateType):
            out.append(to_day(field.name).alias(field.name))
        elif isinstance(field.dataType, T.StringType):
            value = business_id(text_or_null(field.name)) if field.name in KEYS else text_or_null(field.name)
            out.append(value.alias(field.name))
        else:
            out.append(to_number(field.name).try_cast(field.dataType).alias(field.name))
    return raw.select(*out)


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None,
             rename: dict[str, str] | None = None, lower: bool = False, multi_line: bool = False) -> DataFrame:
    """One or many CSV files or globs as one table.

    The files behind every glob are grouped by their header line; each header is one scan, and the scans are united by
    column name. Without a schema every column stays text. ``multi_line`` reads line breaks inside quotes, at the price
    of one task a file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)

    def one(group: Sequence[str]) -> DataFrame:
        df = spark.read.option("header", True).option("multiLine", multi_line).csv(list(group))
        df = lower_headers(df) if lower else df
        return df.withColumnsRenamed({k: v for k, v in (rename or {}).items() if k in df.columns})

    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(g) for g in files_by_header(spark, paths)])
    return raw if schema is None else conform(raw, schema)


def files_by_header(spark: SparkSession, paths: Sequence[str]) -> list[list[str]]:
    """The files behind some paths or globs, those with one header line together.

    The driver lists the files and opens each for its first line only. A path that matches nothing is kept as it is, so that
    the reader names it in its error.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    groups: dict[str, list[str]] = {}
    missing = []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(conf)
        found = fs.globStatus(place)
        missing += [] if found else [path]
        for status in found or []:
            for file in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
                name = file.getPath()
                if file.isFile() and file.getLen() and not name.getName().startswith(("_", ".")):
                    codec, stream = codecs.getCodec(name), fs.open(name)
                    stream = codec.createInputStream(stream) if codec is not None else stream
                    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
                    try:
                        groups.setdefault(reader.readLine() or "", []).append(str(name.toString()))
                    finally:
                        reader.close()
    return [groups[header] for header in sorted(groups)] + [[m] for m in missing] or [list(paths)]


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    matches = fs.globStatus(hadoop_path)
    return matches is not None and len(matches) > 0


def read_optional_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one of the declared schema that switches its signal off downstream."""
    if path_exists(spark, path):
        return read_csv(spark, path, schema)
    return spark.createDataFrame([], schema)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per declared input: role, row floor and required column names."""
    return (spark.read.schema(MANIFEST).option("multiLine", True).json(path)
            .select(F.explode("inputs").alias("i"))
            .select("i.role", "i.local_file", "i.source", "i.row_expected_min", "i.required_cols"))


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return path


def write_metrics_json(metrics: DataFrame, path: str) -> str:
    """A one-row metrics frame as a JSON document; nested structs become nested objects."""
    metrics.write.mode("errorifexists").json(path)
    return path
