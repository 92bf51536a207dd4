"""Label propagation and the composed graph reports.

Label propagation is synchronous: every vertex takes the label most
frequent among its neighbours (edges in both directions, parallel edges
counted, self-loops count their own label twice); ties go to the
smallest label; a vertex without neighbours keeps its own id.  The
iteration count is part of the contract (the process may oscillate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.operators import rank
from papyrus.operators.rank import CHECKPOINT_EVERY
from papyrus.operators.graph import Graph, Numbered, SlicedEdges, undirected
from papyrus.session import cut_lineage, release


def _symmetric_weights(graph: Graph) -> SlicedEdges:
    """``(src, dst, m)``: symmetric edges of a numbered graph with multiplicity,
    hubs in slices, written once and read by every step."""
    sym = undirected(graph.edges.select("src", "dst"))
    return SlicedEdges.of(sym.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")))


def label_propagation(graph: Graph, max_iter: int = 30, checkpoint_every: int = CHECKPOINT_EVERY) -> DataFrame:
    """``(id, label)`` after ``max_iter`` synchronous steps.

    Per step: labels meet the sliced edges -> partial-aggregated count
    per ``(dst, label)`` -> best label per ``dst`` by ``min(struct(-n,
    label))``, itself partially aggregated, so a hub vertex with a huge
    neighbourhood is reduced map-side and never gathered in one task.
    Vertices without edges never change and are added back at the end.
    """
    numbered = Numbered.of(graph)
    sym = _symmetric_weights(numbered.graph)
    ids = numbered.names.select("id", F.col("n").alias("v"))
    linked = cut_lineage(sym.table.select(F.col("src").alias("id")).distinct())
    labels = linked.select("id", F.col("id").alias("label"))
    written = None
    for i in range(1, max_iter + 1):
        counts = (sym.meet(labels.hint("shuffle_hash"), "id")
                  .groupBy(F.col("dst").alias("v"), F.col("label"))
                  .agg(F.sum("m").alias("n")))
        labels = (counts.groupBy("v")
                  .agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col("label"))).alias("b"))
                  .select(F.col("v").alias("id"), F.col("b.label").alias("label")))
        if i % checkpoint_every == 0 or i == max_iter:
            labels = cut_lineage(labels)
            if written is not None:
                release(written)
            written = labels
    named = numbered.name(numbered.name(labels, "label"), "id")
    alone = (ids.join(linked.select(F.col("id").alias("v")), "v", "left_anti")
             .select("id", F.col("id").alias("label")))
    return named.unionByName(alone)


def _source_frame(graph: Graph, source) -> tuple[DataFrame, bool]:
    if isinstance(source, DataFrame):
        return source.select(F.col(source.columns[0]).cast("string").alias("source")), False
    spark = graph.vertices.sparkSession
    return spark.createDataFrame([(str(source),)], "source string"), True


def related_by_label(graph: Graph, source, max_iter: int = 30) -> DataFrame:
    """The papers in the source's cluster, source excluded:
    ``(related_paper)`` for one id, ``(start_paper, related_paper)`` for a
    one-column DataFrame of ids."""
    labels = label_propagation(graph, max_iter)
    src, single = _source_frame(graph, source)
    src_label = (labels.join(src.distinct().select(F.col("source").alias("id")), "id")
                 .select("label", F.col("id").alias("start_paper")))
    if single:  # exactly one row: safe to broadcast
        src_label = F.broadcast(src_label)
    found = (labels.join(src_label, "label").filter(F.col("id") != F.col("start_paper"))
             .select("start_paper", F.col("id").alias("related_paper")))
    return found.drop("start_paper") if single else found


def paper_report(graph: Graph, source, rank_iter: int = 10, lpa_iter: int = 15) -> DataFrame:
    """``(related_paper, pagerank, same_cluster)``: personalised
    PageRank on undirected citations next to the LPA cluster; with
    ``start_paper`` in front for a DataFrame of ids."""
    tp = rank.topic_pagerank(graph, source, max_iter=rank_iter, undirected=True)
    cl = related_by_label(graph, source, lpa_iter).withColumn("same_cluster", F.lit(True))
    keys = [c for c in ("start_paper", "related_paper") if c in cl.columns]
    return (tp.join(cl, keys, "full_outer")
            .select(*keys, "pagerank", F.coalesce(F.col("same_cluster"), F.lit(False)).alias("same_cluster")))


def attach_author_names(sims: DataFrame, authors: DataFrame) -> DataFrame:
    """One join instead of one lookup per ranked author."""
    names = authors.select(F.col("author_id").alias("related_author"), "author_name")
    return sims.join(names, "related_author", "left").select("related_author", "author_name", "simrank")
