"""Saved results (S4, S5): rank tables written as CSV with a leading
index column, and cluster lists written one identifier per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.schemas import AUTHOR_RANK_CSV, PAPER_RANK_CSV


def read_paper_ranks(spark: SparkSession, path: str) -> DataFrame:
    """``(related_paper, pagerank)`` from a CSV with header and index column."""
    df = spark.read.schema(PAPER_RANK_CSV).option("header", True).csv(path)
    return df.select("related_paper", "pagerank")


def read_author_ranks(spark: SparkSession, path: str) -> DataFrame:
    """``(related_author, simrank)`` from a CSV with header and index column."""
    df = spark.read.schema(AUTHOR_RANK_CSV).option("header", True).csv(path)
    return df.select("related_author", "simrank")


def read_cluster(spark: SparkSession, path: str) -> DataFrame:
    """``(related_paper)``: one identifier per line, blanks trimmed, empty
    lines dropped."""
    lines = spark.read.text(path)
    return (lines.select(F.trim(F.col("value")).alias("related_paper"))
            .filter(F.col("related_paper") != ""))


def write_ranks(df: DataFrame, path: str) -> None:
    """Write a rank table as the readers above expect it: CSV with header
    and a leading index column (unique, not dense), one file per task."""
    numbered = df.select(F.monotonically_increasing_id().alias("idx"), "*")
    numbered.write.mode("overwrite").option("header", True).csv(path)
