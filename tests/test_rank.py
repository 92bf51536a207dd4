"""PageRank family and label propagation: golden graph and properties."""

import math

import pytest
from pyspark.sql import functions as F

from papyrus.operators import community, rank
from papyrus.operators import graph as graph_module
from papyrus.operators.graph import Graph, SlicedEdges, author_vertex_id, transition_weights

# The 16-node graph reconstructed for the stored topic-rank
# and cluster results, and the stored results themselves.
S = "10.1109/ICCV.2011.6126229"
A = "10.1109/34.993558"
B = "10.1109/ICCSIT.2010.5565098"
C = "10.1109/ICCV.2005.28"
L = ["10.1109/CVPR.2007.382971", "10.1109/ICCV.2007.4408965", "10.1109/CVPR.2007.383198",
     "10.1109/CVPR.2006.301", "10.1109/CVPRW.2010.5543273", "10.1109/ICCV.2005.239",
     "10.1109/CVPR.2007.383132", "10.1109/TPAMI.2019.2938758"]
D = ["10.1109/TIP.2018.2836323", "10.1109/ICCV.2011.6126543", "10.1109/IJCNN.2017.7966210",
     "10.1109/TPAMI.2017.2691768"]
EXPECTED = {A: 0.2042235807719228, B: 0.23853314784322435, C: 0.06908934881525951,
            **{x: 0.03430956707130157 for x in L}, **{x: 0.007341954731969813 for x in D}}


def golden(spark):
    edges = [(S, A), (S, B), (A, B), (A, C), (B, C), (B, B)]
    edges += [(x, A) for x in L] + [(x, B) for x in L] + [(x, C) for x in D]
    v = spark.createDataFrame([(x,) for x in [S, A, B, C, *L, *D]], "id string")
    e = spark.createDataFrame(edges, "src string, dst string")
    return Graph(v, e)


def test_golden_topic_pagerank(spark):
    out = rank.topic_pagerank(golden(spark), S, max_iter=10, undirected=True).collect()
    got = {r.related_paper: r.pagerank for r in out}
    assert set(got) == set(EXPECTED)
    for k, v in EXPECTED.items():
        assert got[k] == pytest.approx(v, abs=1e-12)
    ranks = [r.pagerank for r in out]
    assert ranks == sorted(ranks, reverse=True)


@pytest.mark.parametrize("iters,has_c", [(15, True), (14, False)])
def test_golden_lpa_cluster(spark, iters, has_c):
    got = {r.related_paper for r in community.related_by_label(golden(spark), S, iters).collect()}
    assert (C in got) == has_c
    assert set(L) <= got and S not in got
    assert len(got) == (9 if has_c else 8)


def small(spark):
    # a sink (s), a source without out-edges, a self-loop and parallel edges
    v = spark.createDataFrame([(x,) for x in "abcds"], "id string")
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "c"),
                               ("d", "s"), ("a", "zz")], "src string, dst string")
    return Graph(v, e)


def test_plain_pagerank_sums_to_vertex_count(spark):
    pr = rank.pagerank(small(spark), max_iter=20).collect()
    assert len(pr) == 5
    assert sum(r.pagerank for r in pr) == pytest.approx(5.0, abs=1e-9)
    assert [r.pagerank for r in pr] == sorted((r.pagerank for r in pr), reverse=True)


def test_pagerank_requires_exactly_one_stop_rule(spark):
    with pytest.raises(ValueError):
        rank.pagerank(small(spark), max_iter=10, tol=0.01)


def test_tolerance_run_close_to_long_fixed_run(spark):
    # the delta run stops once no change exceeds tol; the remaining error
    # is a geometric tail bounded by about tol / reset per vertex
    g = small(spark)
    fixed = {r.paper_doi: r.pagerank for r in rank.pagerank(g, max_iter=60).collect()}
    tol = {r.paper_doi: r.pagerank for r in rank.pagerank(g, max_iter=None, tol=1e-3).collect()}
    for k in fixed:
        assert tol[k] == pytest.approx(fixed[k], abs=1e-2)


def test_personalized_sums_to_one_and_batch_equals_singles(spark):
    g = small(spark)
    w = rank.prepared_weights(g)
    src = spark.createDataFrame([("a",), ("d",)], "source string")
    both = rank.personalized_ranks(w, src, max_iter=7)
    sums = {r.source: r.t for r in both.groupBy("source").agg(F.sum("r").alias("t")).collect()}
    assert sums == pytest.approx({"a": 1.0, "d": 1.0})
    batch = {(r.start_paper, r.related_paper): r.pagerank
             for r in rank.topic_pagerank(g, ["a", "d"], max_iter=7).collect()}
    for s in ("a", "d"):
        single = {r.related_paper: r.pagerank for r in rank.topic_pagerank(g, s, max_iter=7).collect()}
        assert single == pytest.approx({k[1]: v for k, v in batch.items() if k[0] == s})


def test_topic_tolerance_matches_fixed(spark):
    g = small(spark)
    fixed = {r.related_paper: r.pagerank for r in rank.topic_pagerank(g, "a", max_iter=60).collect()}
    tol = {r.related_paper: r.pagerank for r in rank.topic_pagerank_tol(g, "a", tol=1e-3).collect()}
    assert set(tol) == set(fixed)
    for k in fixed:
        assert tol[k] == pytest.approx(fixed[k], abs=1e-2)


def test_unknown_source_and_bad_type(spark):
    with pytest.raises(ValueError):
        rank.topic_pagerank(small(spark), "nope")
    with pytest.raises(TypeError):
        rank.topic_pagerank(small(spark), 42)


def test_source_without_out_edges_ranks_nothing(spark):
    assert rank.topic_pagerank(small(spark), "s").count() == 0


def test_empty_edge_table(spark):
    v = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([], "src string, dst string")
    pr = {r.paper_doi: r.pagerank for r in rank.pagerank(Graph(v, e), max_iter=5).collect()}
    assert pr == pytest.approx({"a": 1.0, "b": 1.0})


def test_all_pairs_equals_batch_over_non_isolated(spark):
    g = small(spark)
    allp = rank.all_topic_pagerank(g, max_iter=5)
    batch = rank.topic_pagerank(g, ["a", "b", "c", "d", "s"], max_iter=5)
    key = lambda r: (r.start_paper, r.related_paper)
    assert sorted(map(key, allp.collect())) == sorted(map(key, batch.collect()))
    top1 = rank.all_topic_pagerank(g, max_iter=5, keep_top=1)
    assert top1.groupBy("start_paper").count().filter("count > 1").count() == 0


def test_all_pairs_blocked_writes_every_block(spark, tmp_path):
    g = small(spark)
    whole = rank.all_topic_pagerank(g, max_iter=5).count()
    blocked = rank.all_topic_pagerank(g, max_iter=5, source_blocks=3, output_path=str(tmp_path / "ap"))
    assert blocked.count() == whole


def hub_graph(spark, n=900):
    edges = [("hub", f"v{i}") for i in range(n)] + [(f"v{i}", f"v{(i * 7 + 1) % n}") for i in range(2 * n)]
    v = spark.createDataFrame([("hub",)] + [(f"v{i}",) for i in range(2 * n)], "id string")
    return Graph(v, spark.createDataFrame(edges, "src string, dst string"))


def test_hub_edges_are_dealt_over_tasks(spark):
    # the hub holds a third of the edges; with slices of 50 no task of the
    # step's join gets more than a small part of them
    edges = SlicedEdges.of(transition_weights(hub_graph(spark)), slice_edges=50)
    assert edges.hubs.count() == 1
    state = spark.createDataFrame([("hub", 1.0)] + [(f"v{i}", 1.0) for i in range(900)], "id string, r double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = edges.meet(state, "id")
        sizes = [r["n"] for r in met.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        hub = [r["n"] for r in met.filter("id = 'hub'").groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(hub) == 900 and len(hub) >= 6 and max(hub) < 300
    assert max(sizes) < 2 * sum(sizes) / len(sizes)


def test_slices_do_not_change_ranks(spark, monkeypatch):
    g = hub_graph(spark, 60)
    whole = {r.paper_doi: r.pagerank for r in rank.pagerank(g, max_iter=5).collect()}
    monkeypatch.setattr(graph_module, "SLICE_EDGES", 7)
    cut = {r.paper_doi: r.pagerank for r in rank.pagerank(g, max_iter=5).collect()}
    assert cut == pytest.approx(whole, abs=1e-12)


@pytest.mark.parametrize("size", ["64MB", "64m", "1g"])
def test_ranks_run_with_any_advisory_size(spark, size):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    try:
        assert rank.pagerank(small(spark), max_iter=2).count() == 5
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_tolerance_run_checks_its_parameters(spark):
    with pytest.raises(ValueError):
        rank.pagerank(small(spark), max_iter=None, tol=0.0)
    with pytest.raises(ValueError):
        rank.pagerank(small(spark), 0.0, max_iter=None, tol=0.1)


def test_several_sources_stay_apart(spark):
    g = golden(spark)
    some = spark.createDataFrame([(S,), (A,)], "id string")
    both = community.related_by_label(g, some, 3).collect()
    for s in (S, A):
        one = {r.related_paper for r in community.related_by_label(g, s, 3).collect()}
        assert {r.related_paper for r in both if r.start_paper == s} == one
    report = community.paper_report(g, some, 3, 3).collect()
    single = {(r.related_paper, r.same_cluster) for r in community.paper_report(g, S, 3, 3).collect()}
    assert {(r.related_paper, r.same_cluster) for r in report if r.start_paper == S} == single


def test_author_by_name_and_batch(spark):
    v = spark.createDataFrame([("p1", "paper"), ("p2", "paper"), ("A:1", "author"),
                               ("A:2", "author"), ("A:3", "author")], "id string, node_type string")
    pairs = [("p1", "A:1"), ("p1", "A:2"), ("p2", "A:2"), ("p2", "A:3")]
    g = Graph(v, spark.createDataFrame(pairs + [(d, s) for s, d in pairs], "src string, dst string"))
    names = spark.createDataFrame([(1, "Ada"), (2, "Bo"), (3, "Bo")], "author_id int, author_name string")
    by_id = rank.author_similarity(g, 1).collect()
    assert rank.author_similarity(g, "Ada", authors=names).collect() == by_id
    with pytest.raises(LookupError):
        rank.author_similarity(g, "Bo", authors=names)
    with pytest.raises(ValueError):
        rank.author_similarity(g, "Ada")
    batch = rank.author_similarity(g, spark.createDataFrame([(1,), (3,)], "author_id int")).collect()
    assert {(r.related_author, r.simrank) for r in batch if r.start_author == 1} == {(r[0], r[1]) for r in by_id}
    assert {r.start_author for r in batch} == {1, 3}


def test_author_similarity_authors_only(spark):
    v = spark.createDataFrame([("p1", "paper"), ("p2", "paper"), ("A:1", "author"),
                               ("A:2", "author"), ("A:3", "author")], "id string, node_type string")
    pairs = [("p1", "A:1"), ("p1", "A:2"), ("p2", "A:2"), ("p2", "A:3")]
    e = spark.createDataFrame(pairs + [(d, s) for s, d in pairs], "src string, dst string")
    sims = rank.author_similarity(Graph(v, e), 1, max_iter=10).collect()
    assert [r.related_author for r in sims] == [2, 3]
    assert all(r.simrank > 1e-5 for r in sims)
    assert author_vertex_id(F.lit(7)) is not None


def test_label_propagation_isolated_keeps_own_label(spark):
    v = spark.createDataFrame([(x,) for x in "abcz"], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    labels = {r.id: r.label for r in community.label_propagation(Graph(v, e), 1).collect()}
    assert labels == {"a": "b", "b": "a", "c": "b", "z": "z"}
    assert not math.isnan(len(labels))


def test_label_propagation_self_loop_counts_twice(spark):
    # z hears b once, c once and itself twice (the loop in both directions):
    # z keeps z; counted once it would tie and fall to the smallest label b
    v = spark.createDataFrame([(x,) for x in "zbc"], "id string")
    e = spark.createDataFrame([("z", "b"), ("z", "c"), ("z", "z")], "src string, dst string")
    labels = {r.id: r.label for r in community.label_propagation(Graph(v, e), 1).collect()}
    assert labels == {"z": "z", "b": "z", "c": "z"}


def test_plain_steps_take_the_partitions_of_the_edges(spark, monkeypatch):
    """Few edges are one bucket, and a step then shuffles its sums to one partition, once."""
    plans, cut = [], rank.cut_lineage
    monkeypatch.setattr(rank, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    rank.pagerank(golden(spark), max_iter=12).count()
    steps = [p for p in plans if "sum(m" in p]
    assert len(steps) == 2
    for p in steps:
        # one exchange a step, and one of the state that was read back
        assert p.count("Exchange hashpartitioning") <= 6 + 1
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
