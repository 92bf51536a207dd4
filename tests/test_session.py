"""Written tables and what they leave on disk."""

import time

from pyspark.sql import functions as F

from papyrus.session import bucketed, cut_lineage


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {str(files.apply(i)) for i in range(files.size()) if "shuffle_" in str(files.apply(i))}


def test_shuffles_go_when_a_table_is_written(spark):
    """A loop of steps holds the shuffles of one step, not of all."""
    before = shuffle_files(spark)
    counted = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")))
    stored = bucketed(counted.repartition(3, "n"), ["k"], 2)
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)  # executors are asked to delete, and do so a little later
    assert not left
    assert counted.count() == stored.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
