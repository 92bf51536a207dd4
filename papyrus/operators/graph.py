"""Property graphs as a pair of DataFrames, built from the papers table.

A :class:`Graph` is ``vertices (id STRING, ...)`` plus ``edges (src STRING,
dst STRING, ...)``.  All ids are strings: author ids get the ``A:`` prefix
so that a paper id and an author id never collide (and so that a union of
the two never widens to a numeric type under ANSI mode).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.schemas import AUTHOR_PREFIX
from papyrus.session import bucketed, cut_lineage, release


class Graph(NamedTuple):
    vertices: DataFrame
    edges: DataFrame


def author_vertex_id(c: F.Column) -> F.Column:
    """Graph id of an author: ``'A:' || author_id``."""
    return F.concat(F.lit(AUTHOR_PREFIX), c.cast("string"))


def author_id_of_vertex(c: F.Column) -> F.Column:
    """Inverse of :func:`author_vertex_id` (INT author id)."""
    return F.substring(c, len(AUTHOR_PREFIX) + 1, 1 << 20).cast("int")


def undirected(edges: DataFrame) -> DataFrame:
    """``E`` union-all its reverse in one reading; other columns are kept.

    Mutual citations therefore count twice and a self-loop becomes two
    parallel edges, exactly as the multiset union implies.
    """
    others = [c for c in edges.columns if c not in ("src", "dst")]
    ways = F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    both = edges.select(ways.alias("way"), *others)
    return both.select("way.src", "way.dst", *others).select(*edges.columns)


def citation_graph(papers: DataFrame) -> Graph:
    """Papers are vertices; each reference is an edge paper -> cited paper.

    References may point outside the corpus; the rank operators drop such
    edges, the graph keeps them.
    """
    vertices = papers.select(F.col("paper_doi").cast("string").alias("id"))
    edges = (papers.filter(F.col("refs_doi").isNotNull())
             .select(F.col("paper_doi").alias("src"), F.explode("refs_doi").alias("dst")))
    return Graph(vertices, edges)


def citation_graph_from_edges(papers: DataFrame, cites: DataFrame) -> Graph:
    """Same graph when citations already come in long form ``(src, dst)``."""
    return Graph(papers.select(F.col("paper_doi").alias("id")), cites.select("src", "dst"))


def authorship_graph(papers: DataFrame) -> Graph:
    """Bipartite paper/author graph; authorship edges in both directions."""
    paper_nodes = papers.select(F.col("paper_doi").alias("id"), F.lit("paper").alias("node_type"))
    written = papers.select(F.col("paper_doi").alias("src"),
                            F.explode("author_id").alias("author_id"))
    author_nodes = (written.select(author_vertex_id(F.col("author_id")).alias("id"))
                    .distinct()
                    .select("id", F.lit("author").alias("node_type")))
    edges = undirected(written.select("src", author_vertex_id(F.col("author_id")).alias("dst")))
    return Graph(paper_nodes.unionByName(author_nodes), edges)


def authorship_graph_from_pairs(papers: DataFrame, wrote: DataFrame) -> Graph:
    """Authorship graph from long-form ``(paper_doi, author_id)`` pairs."""
    paper_nodes = papers.select(F.col("paper_doi").alias("id"), F.lit("paper").alias("node_type"))
    pairs = wrote.select(F.col("paper_doi").alias("src"),
                         author_vertex_id(F.col("author_id")).alias("dst"))
    author_nodes = (pairs.select(F.col("dst").alias("id")).distinct()
                    .select("id", F.lit("author").alias("node_type")))
    return Graph(paper_nodes.unionByName(author_nodes), undirected(pairs))


def combined_graph(ref: Graph, author: Graph, ref_undirected: bool = False) -> Graph:
    """Citations and authorship in one graph, tagged by ``edge_type``.

    Vertices come from the authorship graph.
    """
    ref_edges = ref.edges.select("src", "dst", F.lit("ref").alias("edge_type"))
    if ref_undirected:
        ref_edges = undirected(ref_edges)
    author_edges = author.edges.select("src", "dst", F.lit("author").alias("edge_type"))
    return Graph(author.vertices, ref_edges.unionByName(author_edges))


def drop_isolated(graph: Graph) -> Graph:
    """Keep vertices that are an endpoint of at least one edge."""
    ends = (graph.edges.select(F.col("src").alias("id"))
            .unionByName(graph.edges.select(F.col("dst").alias("id"))))
    return Graph(graph.vertices.join(ends, "id", "left_semi"), graph.edges)


def internal_edges(graph: Graph) -> DataFrame:
    """Edges whose two endpoints are vertices (semi joins, no duplication)."""
    ids = graph.vertices.select("id")
    return (graph.edges
            .join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
            .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
            .select("src", "dst", *[c for c in graph.edges.columns if c not in ("src", "dst")]))


class Numbered(NamedTuple):
    """A graph over numbers, for operators that shuffle ids again and again."""

    graph: Graph       # vertices (id LONG), internal edges (src LONG, dst LONG)
    names: DataFrame   # id, n: each distinct id, null included, and its number

    @classmethod
    def of(cls, graph: Graph) -> "Numbered":
        """Numbers rise with the ids, so ties are broken alike; the joins that
        number the edges leave out those with an end outside the vertices."""
        ids = graph.vertices.select("id").distinct()
        names = cut_lineage(ids.orderBy("id").select("id", F.monotonically_increasing_id().alias("n")))
        edges = (graph.edges.select("src", "dst")
                 .join(names.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").drop("src")
                 .join(names.select(F.col("id").alias("dst"), F.col("n").alias("b")), "dst")
                 .select(F.col("a").alias("src"), F.col("b").alias("dst")))
        return cls(Graph(names.select(F.col("n").alias("id")), edges), names)

    def number(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with ``column`` as number, without ids that are no vertex."""
        return self._swap(rows, column, "id", "n")

    def name(self, rows: DataFrame, column: str, names: DataFrame | None = None) -> DataFrame:
        """``rows`` with the number in ``column`` as id; only those of ``names`` where given."""
        return self._swap(rows, column, "n", "id", names)

    def _swap(self, rows: DataFrame, column: str, old: str, new: str, names: DataFrame | None = None) -> DataFrame:
        found = (self.names if names is None else names).select(F.col(old).alias(column), F.col(new).alias("swapped"))
        return rows.join(found, column).select(*[F.col("swapped").alias(c) if c == column else F.col(c) for c in rows.columns])


def out_degree(edges: DataFrame) -> DataFrame:
    """``(id, out_degree)`` with multi-edges counted."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))


def _multiplicity(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(src, dst, m)`` and ``(src, deg, n)``, both written: parallel edges
    collapse into one with their number ``m``; ``deg`` counts edges, ``n``
    distinct ones.  Joins of the two are then plain shuffles on both sides,
    which adaptive execution can split at a hub."""
    mult = cut_lineage(edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")))
    return mult, cut_lineage(mult.groupBy("src").agg(F.sum("m").alias("deg"), F.count(F.lit(1)).alias("n")))


def transition_weights(graph: Graph) -> DataFrame:
    """``(src, dst, w)`` over internal edges, ``w = multiplicity / outdeg``.

    Parallel edges collapse into one weighted edge, which keeps their
    weight and shrinks the table every rank iteration joins against.
    """
    mult, degree = _multiplicity(internal_edges(graph).select("src", "dst"))
    return _weighted(mult, degree)


def _weighted(mult: DataFrame, degree: DataFrame) -> DataFrame:
    return (mult.join(degree.select("src", "deg"), "src")
            .select("src", "dst", (F.col("m") / F.col("deg")).alias("w")))


#: Edges of one vertex that a slice holds.
SLICE_EDGES = 100_000
#: Edges that a bucket of the stored table holds on average, at most, and where
#: buckets need not give work to a whole cluster, at least.
BUCKET_EDGES, LEAST_EDGES = 1_000_000, 250_000


class SlicedEdges(NamedTuple):
    """Edges for repeated joins on ``src``, stored in buckets of ``(src,
    slice)``, so that a step shuffles its state and never the edges.  A
    vertex with more than a slice of distinct edges has them dealt over
    several slices.  ``hubs`` are the vertices with more than one slice (at
    most ``|E| / slice`` rows), or None where all edges of every vertex fit
    one; then there is no slice column."""

    table: DataFrame        # src, dst, ... and slice where there are hubs
    hubs: DataFrame | None  # src, slices
    buckets: int = 0
    total: int = 0          # edges
    mean: float = 0.0       # edges of a vertex that has any

    @classmethod
    def of(cls, edges: DataFrame, slice_edges: int | None = None, degree: DataFrame | None = None,
           spread: bool = True) -> "SlicedEdges":
        """``edges`` with distinct ``(src, dst)``; ``degree`` (src, n), written,
        where it is known already.  ``spread`` gives at least as many buckets as
        the session has shuffle partitions, for states of many sources; without
        it there are as many as the edges fill."""
        size = slice_edges or SLICE_EDGES
        if degree is None:
            edges = cut_lineage(edges)
            degree = cut_lineage(edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")))
        count, total, most = (x or 0 for x in degree.agg(F.count("n"), F.sum("n"), F.max("n")).first())
        parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(parts, -(-total // BUCKET_EDGES)) if spread else max(1, -(-total // LEAST_EDGES))
        if most <= size:
            return cls(bucketed(edges, ["src"], buckets), None, buckets, total, total / max(1, count))
        hubs = cut_lineage(degree.filter(F.col("n") > size)
                           .select("src", F.ceil(F.col("n") / size).cast("int").alias("slices")))
        deal = F.pmod(F.xxhash64("dst"), F.coalesce(F.col("slices"), F.lit(1))).cast("int")
        dealt = edges.join(hubs, "src", "left").withColumn("slice", deal).drop("slices")
        return cls(bucketed(dealt, ["src", "slice"], buckets), hubs, buckets, total, total / count)

    @classmethod
    def transitions(cls, graph: Graph, with_degree: bool = False, internal: bool = False, spread: bool = True) -> "SlicedEdges":
        """``(src, dst, w)`` of :func:`transition_weights`, and with
        ``with_degree`` also ``dst_deg``, the distinct out-edges of ``dst``.
        ``internal`` says that both ends of every edge are known as vertices."""
        edges = graph.edges if internal else internal_edges(graph)
        mult, degree = _multiplicity(edges.select("src", "dst"))
        edges = _weighted(mult, degree)
        if with_degree:
            edges = (edges.join(degree.select(F.col("src").alias("dst"), F.col("n").alias("dst_deg")), "dst", "left")
                     .select("src", "dst", "w", F.coalesce("dst_deg", F.lit(0)).alias("dst_deg")))
        return cls.of(edges, degree=degree, spread=spread)

    def meet(self, state: DataFrame, key: str, hashed: bool = False) -> DataFrame:
        """Inner join of ``state`` on ``key = src``, its rows repeated for
        every slice of their vertex.  With ``hashed`` a task holds its bucket
        of edges in memory, and a state larger than that needs no sort."""
        table = self.table.withColumnRenamed("src", key)
        table = table.hint("shuffle_hash") if hashed else table
        if self.hubs is None:
            return state.join(table, key)
        last = F.coalesce(F.col("slices"), F.lit(1)) - 1
        dealt = (state.join(self.hubs.withColumnRenamed("src", key), key, "left")
                 .withColumn("slice", F.explode(F.sequence(F.lit(0), last))).drop("slices"))
        return dealt.join(table, [key, "slice"]).drop("slice")


def max_out_degree_vertex(graph: Graph) -> DataFrame:
    """One-row ``(source)``: the vertex with most internal out-edges,
    ties to the smallest id.  Used to pick a data-derived query source."""
    deg = out_degree(internal_edges(graph))
    best = deg.agg(F.min(F.struct((-F.col("out_degree")).alias("nd"), F.col("id"))).alias("b"))
    return best.select(F.col("b.id").alias("source")).filter(F.col("source").isNotNull())
