"""What an operator leaves in the shared folder."""

import os
import time

from pyspark.sql import functions as F

from rankboard.llm import common, near_dedup

from .odd import odd


def _folders(spark):
    base = common.shared_path(spark, "llm", unique=False).removeprefix("file:")
    return {d for d in os.listdir(base)} if os.path.isdir(base) else set()


def test_stored_operator_leaves_its_result_only(spark):
    before = _folders(spark)
    got = near_dedup.near_classes(odd(spark))
    new = _folders(spark) - before
    assert len(new) == 1 and next(iter(new)).startswith("near_classes")
    assert got.count() > 0


def test_nested_operators_hand_their_results_up(spark):
    before = _folders(spark)

    @common.stored
    def inner(df):
        return common.cut(df, "inner_work")

    @common.stored
    def outer(df):
        return common.cut(inner(df), "outer_work").union(inner(df))

    got = outer(spark.range(3))
    assert got.count() == 6
    assert {d.rsplit("-", 1)[0] for d in _folders(spark) - before} == {"outer"}


def _shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f for top in dirs for _, _, names in os.walk(str(top)) for f in names if f.startswith("shuffle_")}


def test_a_cut_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(common._CLEANUP)
    out = common.cut(spark.range(1000).groupBy((F.col("id") % 50).alias("k")).count().repartition(3), "shuffled")
    for _ in range(100):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(common._CLEANUP) == setting
    common.drop(out)
    assert not os.path.exists(out._cut_path.removeprefix("file:"))
