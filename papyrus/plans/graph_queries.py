"""Graph construction, ranking and community queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.functions.ranking import top_k_per_group
from papyrus.operators import community, graph as G, rank, reach
from papyrus.plans import oracle as O
from papyrus.plans.registry import register, rnd
from papyrus.session import cut_lineage
from papyrus.sources import testdata as td
from papyrus.sources.papers import graph_input

ITERS = 10          # personalised runs (reference default)
PLAIN_ITERS = 30    # plain PageRank (reference default)
LPA_ITERS = 15      # label propagation as used by the paper report


# ----------------------------------------------------------------- inputs

def citation_graph(spark: SparkSession, sf: str) -> G.Graph:
    """Citation graph over the derived edges; the edges (a window over the
    line items) are materialised once, since ranking reads them several
    times (source choice, validation, weights)."""
    return G.citation_graph_from_edges(td.papers_long(spark, sf), cut_lineage(td.cites(spark, sf)))


def authorship_graph(spark: SparkSession, sf: str) -> G.Graph:
    return G.authorship_graph_from_pairs(td.papers_long(spark, sf), cut_lineage(td.wrote(spark, sf)))


def top_source(g: G.Graph) -> DataFrame:
    """The paper with most internal out-citations, ties to the smallest id
    (one row, materialised: validation, ranking and clustering all read it)."""
    return cut_lineage(G.max_out_degree_vertex(g))


def top_author(spark: SparkSession, sf: str) -> DataFrame:
    """One-row ``(author_id)``: most papers written, ties to the smallest id."""
    n = td.wrote(spark, sf).groupBy("author_id").agg(F.count(F.lit(1)).alias("n"))
    best = n.agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col("author_id"))).alias("b"))
    return best.select(F.col("b.author_id").alias("author_id"))


CITES_EDGES = "SELECT src, dst FROM cites"
BASE = [O.CITES, O.WROTE, O.PAPERS, O.vertices_papers()]

SQL_SOURCE = ("S AS (SELECT src AS source FROM IE0 GROUP BY src "
              "ORDER BY count(*) DESC, src LIMIT 1)")
IE0 = ("IE0 AS (SELECT src, dst FROM cites WHERE src IN (SELECT id FROM V) "
       "AND dst IN (SELECT id FROM V))")
SQL_TOP_AUTHOR = ("TA AS (SELECT author_id FROM wrote GROUP BY author_id "
                  "ORDER BY count(*) DESC, author_id LIMIT 1)")


# ------------------------------------------------------------ construction

@register("cites_edges", O.with_(O.CITES) + "SELECT src, dst FROM cites")
def cites_edges(spark, sf):
    """G1 through the papers table: arrays of references exploded back."""
    return G.citation_graph(td.papers(spark, sf)).edges


@register("undirected_edges", O.with_(O.CITES) + O.undirected(CITES_EDGES))
def undirected_edges(spark, sf):
    return G.undirected(citation_graph(spark, sf).edges)


@register("cites_internal", O.with_(*BASE, IE0) + "SELECT src, dst FROM IE0")
def cites_internal(spark, sf):
    return G.internal_edges(citation_graph(spark, sf))


@register("out_degree", O.with_(*BASE, IE0)
          + "SELECT src AS id, count(*) AS out_degree FROM IE0 GROUP BY src")
def out_degree(spark, sf):
    return G.out_degree(G.internal_edges(citation_graph(spark, sf)))


@register("authorship_graph_nodes", O.with_(O.WROTE, O.PAPERS)
          + "SELECT paper_doi AS id, 'paper' AS node_type FROM papers UNION ALL "
            "SELECT DISTINCT 'A:' || CAST(author_id AS VARCHAR), 'author' FROM wrote")
def authorship_graph_nodes(spark, sf):
    return G.authorship_graph(td.papers(spark, sf)).vertices


AUTH_EDGES = ("SELECT paper_doi AS src, 'A:' || CAST(author_id AS VARCHAR) AS dst FROM wrote")


@register("authorship_graph_edges", O.with_(O.WROTE) + O.undirected(AUTH_EDGES))
def authorship_graph_edges(spark, sf):
    return G.authorship_graph(td.papers(spark, sf)).edges


def _combined_sql(ref_undirected: bool) -> str:
    ref = O.undirected(CITES_EDGES) if ref_undirected else CITES_EDGES
    return (O.with_(O.CITES, O.WROTE)
            + f"SELECT src, dst, 'ref' AS edge_type FROM ({ref}) r UNION ALL "
              f"SELECT src, dst, 'author' FROM ({O.undirected(AUTH_EDGES)}) a")


@register("combined_graph_edges", _combined_sql(False))
def combined_graph_edges(spark, sf):
    return G.combined_graph(citation_graph(spark, sf), authorship_graph(spark, sf)).edges


@register("combined_graph_edges_undirected", _combined_sql(True))
def combined_graph_edges_undirected(spark, sf):
    return G.combined_graph(citation_graph(spark, sf), authorship_graph(spark, sf),
                            ref_undirected=True).edges


@register("non_isolated", O.with_(*BASE)
          + "SELECT id FROM V WHERE id IN (SELECT src FROM cites UNION ALL SELECT dst FROM cites)")
def non_isolated(spark, sf):
    return G.drop_isolated(citation_graph(spark, sf)).vertices


# ------------------------------------------------------------------- ranks

@register("pagerank", O.with_(*BASE, *O.weights(CITES_EDGES), *O.plain_steps(rank.DEFAULT_RESET, PLAIN_ITERS))
          + f"SELECT id AS paper_doi, round(r, {O.DP}) AS pagerank FROM PN")
def pagerank(spark, sf):
    return rank.pagerank(citation_graph(spark, sf), max_iter=PLAIN_ITERS).select(
        "paper_doi", rnd("pagerank"))


def _topic_sql(undirected: bool) -> str:
    edges = O.undirected(CITES_EDGES) if undirected else CITES_EDGES
    return (O.with_(*BASE, IE0, SQL_SOURCE, *O.weights(edges),
                    *O.personalized_steps(rank.DEFAULT_RESET, ITERS))
            + f"SELECT id AS related_paper, round(r, {O.DP}) AS pagerank FROM RN "
              f"WHERE id <> source AND r > {O.dbl(rank.RANK_THRESHOLD)}")


def topic(spark: SparkSession, sf: str, undirected: bool) -> DataFrame:
    g = citation_graph(spark, sf)
    out = rank.topic_pagerank(g, top_source(g), max_iter=ITERS, undirected=undirected)
    return out.select("related_paper", rnd("pagerank"))


@register("topic_pagerank", _topic_sql(False))
def topic_pagerank(spark, sf):
    """Papers related to the most-citing paper (directed citations)."""
    return topic(spark, sf, False)


@register("topic_pagerank_undirected", _topic_sql(True))
def topic_pagerank_undirected(spark, sf):
    """G6 with undirected citations (the paper report's setting)."""
    return topic(spark, sf, True)


SQL_AUTHOR_PAPERS = ("S AS (SELECT DISTINCT paper_doi AS source FROM wrote "
                     "WHERE author_id = (SELECT author_id FROM TA) AND paper_doi IN (SELECT id FROM V))")


@register("topic_pagerank_batch",
          O.with_(*BASE, SQL_TOP_AUTHOR, SQL_AUTHOR_PAPERS, *O.weights(CITES_EDGES),
                  *O.personalized_steps(rank.DEFAULT_RESET, ITERS))
          + f"SELECT source AS start_paper, id AS related_paper, round(r, {O.DP}) AS pagerank "
            f"FROM RN WHERE id <> source AND r > {O.dbl(rank.RANK_THRESHOLD)}")
def topic_pagerank_batch(spark, sf):
    """One pass for every paper of the most prolific author."""
    g = citation_graph(spark, sf)
    papers_of = (td.wrote(spark, sf).join(top_author(spark, sf), "author_id", "left_semi")
                 .select(F.col("paper_doi").alias("source")).distinct())
    out = rank.topic_pagerank(g, papers_of, max_iter=ITERS)
    return out.select("start_paper", "related_paper", rnd("pagerank"))


TOP_N = 10


def _topn_sql(sources: str, steps: list[str]) -> str:
    return (O.with_(*BASE, f"S AS (SELECT DISTINCT id AS source FROM V WHERE {sources})", *O.weights(CITES_EDGES), *steps,
                    f"TOPN AS (SELECT source, id, r, row_number() OVER (PARTITION BY source "
                    f"ORDER BY round(r, {rank.RANK_TIE_DIGITS}) DESC, id) AS rank FROM RN "
                    f"WHERE id <> source AND r > {O.dbl(rank.RANK_THRESHOLD)} QUALIFY rank <= {TOP_N})")
            + f"SELECT source AS start_paper, id AS related_paper, round(r, {O.DP}) AS pagerank, CAST(rank AS INTEGER) AS rank FROM TOPN")


@register("all_pairs_topn", _topn_sql("id IN (SELECT src FROM cites UNION ALL SELECT dst FROM cites)",
                                      O.push_steps(rank.DEFAULT_RESET, ITERS, rank.PUSH)))
def all_pairs_topn(spark, sf):
    """The ten most related papers of every paper with an edge."""
    found = rank.top_related(citation_graph(spark, sf), TOP_N, max_iter=ITERS)
    return found.select("start_paper", "related_paper", rnd("pagerank"), "rank")


@register("all_pairs_topn_exact", _topn_sql("CAST(substr(id, 2) AS BIGINT) % 20 = 0", O.personalized_steps(rank.DEFAULT_RESET, ITERS)))
def all_pairs_topn_exact(spark, sf):
    """K8 exactly, for the papers whose number is divisible by 20: what the
    push form is measured against."""
    g = citation_graph(spark, sf)
    some = g.vertices.where(F.substring("id", 2, 20).cast("long") % 20 == 0).select(F.col("id").alias("source"))
    found = rank.topic_pagerank(g, some, max_iter=ITERS)
    top = top_k_per_group(found, ["start_paper"], [F.round("pagerank", rank.RANK_TIE_DIGITS).desc(), F.asc("related_paper")], TOP_N, "rank")
    return top.select("start_paper", "related_paper", rnd("pagerank"), "rank")


def _author_sql(combined: bool, named: bool = False, batch: bool = False) -> str:
    auth = O.undirected(AUTH_EDGES)
    edges = (f"SELECT src, dst FROM ({O.undirected(CITES_EDGES)}) r UNION ALL "
             f"SELECT src, dst FROM ({auth}) a") if combined else auth
    va = ("V AS (SELECT paper_doi AS id, 'paper' AS node_type FROM papers UNION ALL "
          "SELECT DISTINCT 'A:' || CAST(author_id AS VARCHAR), 'author' FROM wrote)")
    chosen = "(SELECT DISTINCT author_id FROM wrote WHERE author_id % 20 = 0) b" if batch else "TA"
    src = f"S AS (SELECT 'A:' || CAST(author_id AS VARCHAR) AS source FROM {chosen})"
    ctes = [O.CITES, O.WROTE, O.PAPERS, va, SQL_TOP_AUTHOR, src, *O.weights(edges),
            *O.personalized_steps(rank.DEFAULT_RESET, ITERS)]
    if named:
        ctes.append(O.AUTHORS)
    sel = ("SELECT " + ("CAST(substr(RN.source, 3) AS INTEGER) AS start_author, " if batch else "")
           + "CAST(substr(RN.id, 3) AS INTEGER) AS related_author, "
           + ("a.author_name, " if named else "")
           + f"round(RN.r, {O.DP}) AS simrank FROM RN "
           + ("LEFT JOIN authors a ON a.author_id = CAST(substr(RN.id, 3) AS INTEGER) " if named else "")
           + f"WHERE RN.id <> RN.source AND RN.r > {O.dbl(rank.RANK_THRESHOLD)} "
             "AND RN.id IN (SELECT id FROM V WHERE node_type = 'author')")
    return O.with_(*ctes) + sel


@register("author_similarity", _author_sql(False))
def author_similarity(spark, sf):
    """G9 over the authorship graph, from the most prolific author."""
    out = rank.author_similarity(authorship_graph(spark, sf), top_author(spark, sf), max_iter=ITERS)
    return out.select("related_author", rnd("simrank"))


@register("author_similarity_by_name", _author_sql(False))
def author_similarity_by_name(spark, sf):
    """The author given by name."""
    authors = td.authors(spark, sf)
    name = authors.join(top_author(spark, sf), "author_id", "left_semi").first()["author_name"]
    out = rank.author_similarity(authorship_graph(spark, sf), name, max_iter=ITERS, authors=authors)
    return out.select("related_author", rnd("simrank"))


@register("author_similarity_batch", _author_sql(False, batch=True))
def author_similarity_batch(spark, sf):
    """G9 for several authors in one pass, results kept apart: the authors
    whose id is divisible by 20."""
    some = td.wrote(spark, sf).filter(F.col("author_id") % 20 == 0).select("author_id").distinct()
    out = rank.author_similarity(authorship_graph(spark, sf), some, max_iter=ITERS)
    return out.select("start_author", "related_author", rnd("simrank"))


@register("wrote_edges", O.with_(O.WROTE) + "SELECT paper_doi AS src, author_id FROM wrote")
def wrote_edges(spark, sf):
    """The author arrays of the papers table exploded."""
    p = graph_input(td.papers(spark, sf, with_refs=True))
    return p.select(F.col("paper_doi").alias("src"), F.explode("author_id").alias("author_id"))


@register("author_similarity_combined", _author_sql(True))
def author_similarity_combined(spark, sf):
    """G9 over citations (undirected) plus authorship."""
    g = G.combined_graph(citation_graph(spark, sf), authorship_graph(spark, sf), ref_undirected=True)
    out = rank.author_similarity(g, top_author(spark, sf), max_iter=ITERS)
    return out.select("related_author", rnd("simrank"))


@register("author_similarity_named", _author_sql(True, named=True))
def author_similarity_named(spark, sf):
    """G13 + J5: the author report, names attached by a join."""
    g = G.combined_graph(citation_graph(spark, sf), authorship_graph(spark, sf), ref_undirected=True)
    sims = rank.author_similarity(g, top_author(spark, sf), max_iter=ITERS)
    named = community.attach_author_names(sims, td.authors(spark, sf))
    return named.select("related_author", "author_name", rnd("simrank"))


# --------------------------------------------------------------- community

LPA_BASE = [*BASE, "ES AS (SELECT src, dst FROM cites WHERE src IN (SELECT id FROM V) "
            "AND dst IN (SELECT id FROM V) UNION ALL SELECT dst, src FROM cites "
            "WHERE src IN (SELECT id FROM V) AND dst IN (SELECT id FROM V))",
            "VL AS (SELECT id FROM V)"]


@register("lpa_labels", O.with_(*LPA_BASE, *O.lpa_steps(LPA_ITERS))
          + f"SELECT id, label FROM L{LPA_ITERS}")
def lpa_labels(spark, sf):
    return community.label_propagation(citation_graph(spark, sf), max_iter=LPA_ITERS)


@register("lpa_related", O.with_(*LPA_BASE, IE0, SQL_SOURCE, *O.lpa_steps(LPA_ITERS))
          + f"SELECT b.id AS related_paper FROM L{LPA_ITERS} a JOIN L{LPA_ITERS} b "
            f"ON a.label = b.label WHERE a.id = (SELECT source FROM S) AND b.id <> a.id")
def lpa_related(spark, sf):
    g = citation_graph(spark, sf)
    return community.related_by_label(g, top_source(g), max_iter=LPA_ITERS).select("related_paper")


@register("paper_graph_report",
          O.with_(*LPA_BASE, IE0, SQL_SOURCE, *O.lpa_steps(LPA_ITERS),
                  *O.weights(O.undirected(CITES_EDGES)),
                  *O.personalized_steps(rank.DEFAULT_RESET, ITERS),
                  f"TP AS (SELECT id AS related_paper, r FROM RN WHERE id <> source "
                  f"AND r > {O.dbl(rank.RANK_THRESHOLD)})",
                  f"CL AS (SELECT b.id AS related_paper FROM L{LPA_ITERS} a JOIN L{LPA_ITERS} b "
                  f"ON a.label = b.label WHERE a.id = (SELECT source FROM S) AND b.id <> a.id)")
          + f"SELECT coalesce(TP.related_paper, CL.related_paper) AS related_paper, "
            f"round(TP.r, {O.DP}) AS pagerank, CL.related_paper IS NOT NULL AS same_cluster "
            f"FROM TP FULL OUTER JOIN CL ON TP.related_paper = CL.related_paper")
def paper_graph_report(spark, sf):
    """Topic PageRank (undirected) next to the LPA cluster (15 steps)."""
    g = citation_graph(spark, sf)
    rep = community.paper_report(g, top_source(g), rank_iter=ITERS, lpa_iter=LPA_ITERS)
    return rep.select("related_paper", rnd("pagerank"), "same_cluster")


TOL = 1e-3


#: More steps than the run takes at any test size.
TOL_STEPS = 80


@register("pagerank_tol", O.with_(*BASE, *O.weights(CITES_EDGES), *O.delta_steps(rank.DEFAULT_RESET, TOL, TOL_STEPS))
          + f"SELECT id AS paper_doi, round(r, {O.DP}) AS pagerank FROM DN")
def pagerank_tol(spark, sf):
    """PageRank run until no vertex changes by more than ``TOL``
    (delta propagation)."""
    return rank.pagerank(citation_graph(spark, sf), max_iter=None, tol=TOL).select(
        "paper_doi", rnd("pagerank"))


@register("papers_scan", O.with_(O.CITES, O.WROTE, O.PAPERS)
          + "SELECT paper_doi, title, publishedby, publicationDate, "
            "(SELECT count(*) FROM wrote w WHERE w.paper_doi = papers.paper_doi) AS n_authors, "
            "(SELECT count(*) FROM cites c WHERE c.src = papers.paper_doi) AS n_refs FROM papers")
def papers_scan(spark, sf):
    """The papers table with its array columns, summarised by array
    sizes (arrays of null count 0)."""
    p = td.papers(spark, sf)
    size0 = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return p.select("paper_doi", "title", "publishedby", "publicationDate",
                    size0(F.col("author_id")).alias("n_authors"), size0(F.col("refs_doi")).alias("n_refs"))


#: Rows of state that a block of sources may have in :func:`source_blocks`.
BLOCK_STATE = 20_000


@register("source_blocks")
def source_blocks(spark, sf):
    """Every paper with its reach over undirected citations, and the
    block of sources it is run in."""
    g = citation_graph(spark, sf)
    found = reach.reach(G.Graph(g.vertices, G.undirected(g.edges)), ITERS)
    return reach.source_blocks(found, BLOCK_STATE)
