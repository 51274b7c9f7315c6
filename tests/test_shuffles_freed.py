"""A written table leaves no shuffle files behind (op2, op10: disk)."""

from __future__ import annotations

from pyspark.sql import functions as F

from redline.plans.session import CLEANUP_CONF, cut_lineage


def _shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    rows = spark.range(20000).withColumn("k", F.col("id") % 500).groupBy("k").agg(F.sum("id").alias("s"))
    before, setting = _shuffle_files(spark), spark.conf.get(CLEANUP_CONF, None)
    stored = cut_lineage(rows, "freed")
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP_CONF, None) == setting
    # the rows can be read and computed again
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, rows.collect()))
    assert _shuffle_files(spark) - before                    # what is not written is kept for its reader
