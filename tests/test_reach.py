"""Reaches by sketches against breadth-first search, and blocks of sources."""

import pytest
from pyspark.sql import functions as F

from papyrus.operators import rank, reach
from papyrus.operators.graph import Graph, undirected
from papyrus.plans import graph_queries
from tests.test_bruteforce import edges_list, graph


def walked(ids, edges, steps):
    out = {x: set() for x in ids}
    for s, d in edges:
        if s in out and d in out:
            out[s].add(d)
    found = {}
    for x in ids:
        seen = {x}
        for _ in range(steps):
            seen |= {d for s in seen for d in out[s]}
        found[x] = len(seen)
    return found


@pytest.mark.parametrize("slice_edges", [None, 3])
@pytest.mark.parametrize("steps", [0, 1, 2, 5])
def test_small_sets_are_exact(spark, monkeypatch, steps, slice_edges):
    if slice_edges:
        monkeypatch.setattr("papyrus.operators.graph.SLICE_EDGES", slice_edges)
    ids, edges = edges_list()
    got = {r["id"]: r["reach"] for r in reach.reach(graph(spark), steps).collect()}
    assert got == walked(ids, edges, steps)


def test_reach_is_the_rank_runs_state(spark):
    ids, _ = edges_list()
    sources = spark.createDataFrame([(x,) for x in ids], "source string")
    ranks = rank.personalized_ranks(rank.prepared_weights(graph(spark)), sources, max_iter=3)
    state = {r["source"]: r["count"] for r in ranks.groupBy("source").count().collect()}
    assert state == {r["id"]: r["reach"] for r in reach.reach(graph(spark), 3).collect()}


def test_odd_rows(spark):
    g = Graph(spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "id string"),
              spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "gone"), (None, "b"), ("a", None)],
                                    "src string, dst string"))
    assert sorted(map(tuple, reach.reach(g, 2).collect())) == [("a", 2), ("b", 1)]
    none = Graph(g.vertices.where("false"), g.edges)
    assert reach.reach(none, 2).collect() == []
    assert reach.source_blocks(reach.reach(none, 1), 5).collect() == []


def test_blocks_hold_their_stretch(spark):
    """Sums of a block lie within the largest reach of the chosen size; a
    source beyond the size is not lost; buckets do not change the blocks' size."""
    reaches = spark.range(500).select(F.format_string("s%03d", "id").alias("id"),
                                      F.when(F.col("id") == 77, 950).otherwise(F.col("id") % 30 + 1).cast("long").alias("reach"))
    for bucket in (7, 100_000):
        rows = reach.source_blocks(reaches, 300, bucket).collect()
        assert len(rows) == len({r["source"] for r in rows}) == 500
        sums, heavy = {}, None
        for r in rows:
            sums[r["block"]] = sums.get(r["block"], 0) + r["reach"]
            heavy = r["block"] if r["reach"] == 950 else heavy
        after = {min(b for b in sums if b > heavy)} if heavy < max(sums) else set()
        for b, total in sums.items():
            if b != max(sums) and b not in after | {heavy}:
                assert 270 <= total <= 330
        assert sums[heavy] < 300 + 950
        assert sum(sums.values()) == sum(r["reach"] for r in rows)


def test_predicted_state_is_the_real_one(spark):
    """sf0.01: the rows of a block's state are within a fifth of the sum of
    the reaches, and a block is as large as asked for."""
    sf = "/root/testdata/sf0.01"
    g = graph_queries.citation_graph(spark, sf)
    blocks = graph_queries.source_blocks(spark, sf).collect()
    assert len(blocks) == g.vertices.count()
    weights = rank.prepared_weights(g, make_undirected=True)
    largest = max(r["reach"] for r in blocks)
    names = sorted({r["block"] for r in blocks})
    for name in (names[0], names[len(names) // 2]):
        here = [r for r in blocks if r["block"] == name]
        sources = spark.createDataFrame([(r["source"],) for r in here], "source string")
        real = rank.personalized_ranks(weights, sources, max_iter=graph_queries.ITERS).count()
        predicted = sum(r["reach"] for r in here)
        assert abs(real - predicted) <= 0.2 * real
        assert predicted <= graph_queries.BLOCK_STATE + largest


def test_all_papers_in_blocks_by_reach(spark, tmp_path):
    ids, edges = edges_list()
    g = Graph(graph(spark).vertices, undirected(graph(spark).edges))
    whole = rank.all_topic_pagerank(g, max_iter=4)
    parts = rank.all_topic_pagerank(g, max_iter=4, max_state=60, output_path=str(tmp_path / "blocks"))
    key = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    assert key(parts) == key(whole)
    with pytest.raises(ValueError):
        rank.all_topic_pagerank(g, max_state=60)
    with pytest.raises(ValueError):
        rank.all_topic_pagerank(g, max_state=60, source_blocks=2, output_path=str(tmp_path / "x"))


def test_few_states_are_written(spark, monkeypatch):
    """Sketches are written every few steps, not after each."""
    from papyrus.operators import reach as R

    written = []
    cut = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: written.append(df.columns) or cut(df))
    e = spark.createDataFrame([(f"v{k:02d}", f"v{k + 1:02d}") for k in range(12)], "src string, dst string")
    v = spark.createDataFrame([(f"v{k:02d}",) for k in range(13)], "id string")
    got = {r["id"]: round(r["reach"]) for r in R.reach(Graph(v, e), 10).collect()}
    assert got == {f"v{k:02d}": min(11, 13 - k) for k in range(13)}
    assert written.count(["id", "sketch"]) == 1 + 10 // R.CHECKPOINT_EVERY


def test_disk_holds_the_shuffles_of_one_step(spark, monkeypatch):
    from papyrus.operators import reach as R

    plans = []
    cut = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    R.reach(graph(spark), 7).collect()
    unions = [p.count("hll_union_agg") for p in plans if "hll_union_agg" in p]
    assert len(unions) == 7 and max(unions) == min(unions)
