"""Session builder for local runs, and the shared folder that stage tables and checkpoints go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app_name: str = "settlerank", **conf: str) -> SparkSession:
    """A local session for tests and the bench. A cluster brings its own session and settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app_name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_FOLDERS: dict[str, tempfile.TemporaryDirectory] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a local session without one gets its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FOLDERS:
        _LOCAL_FOLDERS[app] = tempfile.TemporaryDirectory(prefix="settlerank-")     # gone when the process ends
    return _LOCAL_FOLDERS[app].name


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder for one written stage table."""
    return f"{shared_folder(spark)}/settlerank/{name}-{uuid.uuid4().hex}"


#: Whether Spark removes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    """Store the rows as a Parquet table in the shared folder and read that from now on.

    Later stages survive lost executors without recomputing the inputs, read only the columns they need, and
    the optimizer sees the true size when it decides about a broadcast. Once the table is written, nothing reads the shuffle
    files it was made from, and they are removed. Files are read in the order of their size, so what the boosted trees sample
    from follows the compression of the tables before it: these keep the session's.
    """
    spark, path = df.sparkSession, stage_path(df.sparkSession, name)
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)
