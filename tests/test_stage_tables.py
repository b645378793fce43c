"""Stage tables leave no shuffle files behind, and the session as it was."""

import glob
import os
import tempfile
import time

from pyspark.sql import functions as F

from settlerank.session import _CLEAN_UP, cut_lineage


def shuffle_files(spark):
    top = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", tempfile.gettempdir())
    return {f for part in top.split(",") for f in glob.glob(f"{part}/**/blockmgr-*/*/shuffle_*.data", recursive=True)}


def test_a_stored_table_leaves_no_shuffle_files(spark):
    rows = spark.range(200_000).select((F.xxhash64("id") % 100_000).alias("k"), "id")
    joined = rows.groupBy("k").agg(F.count("*").alias("n")).join(rows.repartition(5, "id"), "k")
    setting, before = spark.conf.get(_CLEAN_UP, None), shuffle_files(spark)
    stored = cut_lineage(joined, "cleaned")
    end = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(_CLEAN_UP, None) == setting
    assert stored.count() == 200_000 and stored.agg(F.sum("n")).first()[0] == joined.agg(F.sum("n")).first()[0]


def test_the_setting_is_restored_when_storing_fails(spark):
    setting = spark.conf.get(_CLEAN_UP, None)
    try:
        cut_lineage(spark.range(3).select(F.raise_error(F.lit("no"))), "failed")
        raise AssertionError("must fail")
    except Exception as error:
        assert not isinstance(error, AssertionError)
    assert spark.conf.get(_CLEAN_UP, None) == setting
