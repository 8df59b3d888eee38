"""Staged frames leave no shuffle files behind."""

import glob
import time

from pyspark.sql import functions as F

from wattline.llm import common


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}


def test_shuffles_of_a_staged_frame_are_removed(spark):
    before, setting = shuffle_files(spark), spark.conf.get(common.SHUFFLE_CLEANUP)
    sums = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    out = common.staged(sums.join(spark.range(100).select(F.col("id").alias("k")).repartition(5, "k"), "k"), "sums")
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(common.SHUFFLE_CLEANUP) == setting
    # The frame that was written can still be read itself.
    assert out.count() == sums.count() == 100 and out.agg(F.sum("s")).first()[0] == sum(range(10_000))
