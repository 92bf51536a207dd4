"""How many vertices each source reaches, and blocks of sources by it.

The state of a personalised rank run holds one row for each vertex that a
source reaches, so its size is the sum of the sources' reaches.  The reaches
are found by HyperLogLog sketches merged along the edges, all vertices at
once, and cut many sources into blocks whose state has a chosen size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrus.operators.graph import Graph, SlicedEdges, internal_edges
from papyrus.session import cut_lineage, release

#: Logarithm of the registers of a sketch: about 3 % standard error and, for
#: a large set, 1 KB.  Small sets are kept as lists and counted exactly.
LG_REGISTERS = 10
#: Steps between written states.  A step's shuffles hold a sketch an edge, a state
#: one a vertex, and the shuffles go when a state is written: disk holds those of
#: so many steps.
CHECKPOINT_EVERY = 1
#: Sources whose reaches a task adds up.
BUCKET_SOURCES = 100_000


def reach(graph: Graph, max_iter: int, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """``(id, reach)`` for every vertex: about how many vertices lie within
    ``max_iter`` steps along the edges, itself included: the rows of its
    state after ``max_iter`` iterations of a personalised rank run.

    A step sends each vertex's sketch to the vertices that point at it.  The
    edges stay in their buckets; sketches are merged in the sending tasks, so
    a vertex gets one sketch a task.  Edges with an end outside the vertices
    are dropped, repeated vertices and edges count once; no vertices give no
    rows.
    """
    if max_iter < 0:
        raise ValueError("max_iter must not be negative")
    # cut first: the vertices are read once a step
    ids = cut_lineage(graph.vertices.select("id").where(F.col("id").isNotNull()).distinct())
    pointing = internal_edges(Graph(ids, graph.edges)).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    edges = SlicedEdges.of(pointing.distinct())
    own = cut_lineage(ids.groupBy("id").agg(F.hll_sketch_agg("id", lg_registers).alias("sketch")))
    state, written = own, None
    for i in range(1, max_iter + 1):
        met = edges.meet(state, "id").select(F.col("dst").alias("id"), "sketch")
        state = met.unionByName(own).groupBy("id").agg(F.hll_union_agg("sketch").alias("sketch"))
        if i % CHECKPOINT_EVERY == 0 or i == max_iter:
            state = cut_lineage(state)
            if written is not None:
                release(written)
            written = state
    return state.select("id", F.hll_sketch_estimate("sketch").alias("reach"))


def source_blocks(reaches: DataFrame, max_state: int, bucket_sources: int = BUCKET_SOURCES) -> DataFrame:
    """``(source, reach, block)``: the rows of :func:`reach` (or some of them)
    in blocks of about ``max_state`` reached vertices together.

    The sources are laid in the order of a hash; a block takes those whose
    running sum starts within its stretch of ``max_state``.  So it holds more
    than that by at most the reach of its last source, and a source that
    reaches more by itself has a block with the few that start beside it.  The
    running sum goes over hash buckets and then inside each of them; the sums
    of the buckets are one row per ``bucket_sources`` sources.
    """
    if max_state < 1:
        raise ValueError("max_state must be at least 1")
    count = reaches.count()
    buckets = -(-count // bucket_sources) or 1
    order = F.xxhash64("source")
    dealt = cut_lineage(reaches.select(F.col("id").alias("source"), "reach")
                        .withColumn("bucket", F.pmod(order, F.lit(buckets))))
    sums = dealt.groupBy("bucket").agg(F.sum("reach").alias("sum"))
    before = sums.select("bucket", (F.sum("sum").over(Window.orderBy("bucket")) - F.col("sum")).alias("before"))
    inside = Window.partitionBy("bucket").orderBy(order, "source").rowsBetween(Window.unboundedPreceding, 0)
    starts = dealt.withColumn("inside", F.sum("reach").over(inside) - F.col("reach")).join(before, "bucket")
    return starts.select("source", "reach", F.floor((F.col("before") + F.col("inside")) / F.lit(max_state)).alias("block"))
