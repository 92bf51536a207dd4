"""Distributed ranking helpers: top-k per group and a dense,
gap-free global row index (a DataFrame ``zipWithIndex``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrus.session import cut_lineage


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[Column],
                    k: int, rank_col: str | None = None) -> DataFrame:
    """Keep the first ``k`` rows of every group under a total order.

    One window: the planner cuts each group to ``k`` rows in every task
    before the shuffle (window group limit), so a large group reaches its
    task as at most ``k`` rows of each map task.  ``order_cols`` must be a
    total order for a deterministic result.
    """
    rn = rank_col or "__rn"
    window = Window.partitionBy(*group_cols).orderBy(*order_cols)
    cut = df.withColumn(rn, F.row_number().over(window)).filter(F.col(rn) <= k)
    return cut if rank_col else cut.drop(rn)


def dense_index(df: DataFrame, order_cols: Sequence[Column], index_col: str = "idx",
                num_partitions: int | None = None) -> DataFrame:
    """Number the rows 0..n-1 in ``order_cols`` order, fully distributed.

    Range-partition and sort, remember each row's position inside its
    partition, checkpoint (so the partitioning is fixed), then add the
    number of rows of all earlier partitions.  The offset table has one
    row per partition, so broadcasting it is bounded by the partition
    count, not by the data.  Without ``num_partitions`` adaptive execution
    sizes the partitions.  ``order_cols`` must be a total order.
    """
    spread = df.repartitionByRange(num_partitions, *order_cols) if num_partitions else df.repartitionByRange(*order_cols)
    ordered = (spread.sortWithinPartitions(*order_cols)
               .withColumn("__pid", F.spark_partition_id())
               .withColumn("__mid", F.monotonically_increasing_id()))
    ordered = cut_lineage(ordered)
    counts = ordered.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        "__pid",
        (F.sum("__n").over(Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("__n")).alias("__off"))
    pos = F.col("__mid") - F.shiftleft(F.col("__pid").cast("long"), 33)
    return (ordered.join(F.broadcast(offsets), "__pid")
            .withColumn(index_col, F.col("__off") + pos)
            .drop("__pid", "__mid", "__off"))
