"""Graph construction (G1-G4, U1, J8) on hand-made papers."""

from pyspark.sql import functions as F

from papyrus.operators import graph as G
from papyrus.schemas import PAPERS

from .conftest import rows


def papers(spark):
    base = {f.name: None for f in PAPERS.fields}

    def p(doi, refs, authors):
        d = dict(base, paper_doi=doi, title=f"t {doi}", author_id=authors, refs_doi=refs)
        return tuple(d[f.name] for f in PAPERS.fields)
    data = [
        p("a", ["b", "b", "zz"], [1, 2]),   # repeated ref, ref outside the corpus
        p("b", ["a", "b"], [2]),            # mutual citation, self-reference
        p("c", None, [3]),                  # null refs
        p("d", [], [1]),                    # empty refs
        p("e", None, [4]),                  # isolated paper
    ]
    return spark.createDataFrame(data, PAPERS)


def test_citation_graph_keeps_multi_edges_and_dangling(spark):
    g = G.citation_graph(papers(spark))
    assert rows(g.vertices, "id") == [("a",), ("b",), ("c",), ("d",), ("e",)]
    assert rows(g.edges, "src", "dst") == [("a", "b"), ("a", "b"), ("a", "zz"), ("b", "a"), ("b", "b")]


def test_undirected_doubles_every_edge(spark):
    g = G.citation_graph(papers(spark))
    u = G.undirected(g.edges)
    assert u.count() == 2 * g.edges.count()
    assert rows(u.filter("src = 'b' AND dst = 'b'"), "src") == [("b",), ("b",)]


def test_internal_edges_and_weights(spark):
    g = G.citation_graph(papers(spark))
    assert rows(G.internal_edges(g), "src", "dst") == [("a", "b"), ("a", "b"), ("b", "a"), ("b", "b")]
    w = {(r.src, r.dst): r.w for r in G.transition_weights(g).collect()}
    assert w == {("a", "b"): 1.0, ("b", "a"): 0.5, ("b", "b"): 0.5}


def test_drop_isolated(spark):
    g = G.drop_isolated(G.citation_graph(papers(spark)))
    assert rows(g.vertices, "id") == [("a",), ("b",)]


def test_authorship_graph_prefixes_authors(spark):
    g = G.authorship_graph(papers(spark))
    nodes = rows(g.vertices, "id", "node_type")
    assert ("A:1", "author") in nodes and ("a", "paper") in nodes
    assert len([n for n in nodes if n[1] == "author"]) == 4
    assert dict(g.vertices.dtypes)["id"] == "string"
    assert g.edges.count() == 2 * 6


def test_combined_graph_tags_edges(spark):
    p = papers(spark)
    c = G.combined_graph(G.citation_graph(p), G.authorship_graph(p), ref_undirected=True)
    kinds = dict(rows(c.edges.groupBy("edge_type").count(), "edge_type", "count"))
    assert kinds == {"ref": 10, "author": 12}


def test_max_out_degree_vertex_ties_to_smallest(spark):
    g = G.citation_graph(papers(spark))
    assert G.max_out_degree_vertex(g).first()[0] == "a"
    assert G.out_degree(G.internal_edges(g)).filter(F.col("id") == "b").first()[1] == 2


def test_numbers_rise_with_ids(spark):
    """Numbers keep the order of ids, edges to no vertex go, null stays a vertex."""
    ids = [f"p{k}" for k in range(50)] + ["p3", None]
    v = spark.createDataFrame([(i,) for i in ids], "id string").repartition(5)
    e = spark.createDataFrame([("p1", "p2"), ("p1", "p2"), ("p2", "x"), ("x", "p1"), (None, "p1"), ("p7", "p7")], "src string, dst string")
    numbered = G.Numbered.of(G.Graph(v, e))
    names = {r["id"]: r["n"] for r in numbered.names.collect()}
    assert len(names) == 51 and None in names
    known = sorted(i for i in names if i is not None)
    assert [names[i] for i in known] == sorted(names[i] for i in known)
    got = sorted((r["src"], r["dst"]) for r in numbered.graph.edges.collect())
    assert got == sorted((names[a], names[b]) for a, b in [("p1", "p2"), ("p1", "p2"), ("p7", "p7")])
    back = numbered.name(numbered.number(e, "src"), "src")
    assert sorted(r["src"] for r in back.collect()) == ["p1", "p1", "p2", "p7"]


def test_steps_run_on_numbers(spark, monkeypatch):
    """Ranks and labels shuffle numbers, not names."""
    from papyrus.operators import community, rank

    kinds = []
    of = G.SlicedEdges.of.__func__
    monkeypatch.setattr(G.SlicedEdges, "of", classmethod(lambda cls, edges, *a, **k: kinds.append(edges.schema["src"].dataType.typeName()) or of(cls, edges, *a, **k)))
    v = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "src string, dst string")
    g = G.Graph(v, e)
    rank.pagerank(g, max_iter=1)
    rank.pagerank(g, max_iter=None, tol=0.5)
    rank.topic_pagerank(g, "a", max_iter=1)
    rank.top_related(g, 2, max_iter=1)
    community.label_propagation(g, 1)
    assert kinds == ["long"] * 5
