"""Top related papers by forward push, and edges that stay where they lie."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from papyrus.operators import rank
from papyrus.operators.graph import Graph, SlicedEdges, transition_weights
from papyrus.plans import graph_queries
from tests.test_bruteforce import dense_ranks, edges_list, graph


def test_push_without_threshold_is_the_exact_run(spark):
    ids, _ = edges_list()
    weights = rank.prepared_weights(graph(spark), with_degree=True)
    sources = spark.createDataFrame([(x,) for x in ids], "source string")
    got = {(r["source"], r["id"]): r["r"] for r in rank.push_ranks(weights, sources, 0.0).collect()}
    for s in ids:
        want = dense_ranks(s)
        for v, r in want.items():
            assert abs(got.get((s, v), 0.0) - r) < 1e-12


def test_threshold_bounds_the_state(spark):
    """A complete graph of 300: the exact state of a source is all of it, that
    of a push with few residuals per edge the source alone."""
    ids = [f"v{k:03d}" for k in range(300)]
    edges = spark.range(300).select(F.format_string("v%03d", "id").alias("src")).crossJoin(
        spark.range(300).select(F.format_string("v%03d", "id").alias("dst"))).where("src <> dst")
    g = Graph(spark.createDataFrame([(x,) for x in ids], "id string"), edges)
    weights = rank.prepared_weights(g, with_degree=True)
    sources = spark.createDataFrame([(x,) for x in ids[:40]], "source string")
    for push in (1.0, 1e-2, 1e-3):
        state = rank.push_ranks(weights, sources, push, max_iter=5)
        used = state.groupBy("source").count().agg(F.max("count")).first()[0]
        assert used <= 1 / (rank.DEFAULT_RESET * push) + 1


def test_recall_against_the_exact_run(spark):
    """sf0.01, the papers whose number is divisible by 20."""
    sf = "/root/testdata/sf0.01"
    exact, push = defaultdict(set), defaultdict(set)
    for r in graph_queries.all_pairs_topn_exact(spark, sf).collect():
        exact[r["start_paper"]].add(r["related_paper"])
    found = graph_queries.all_pairs_topn(spark, sf)
    for r in found.collect():
        push[r["start_paper"]].add(r["related_paper"])
        assert r["rank"] <= 10
    hits = sum(len(exact[s] & push[s]) for s in exact)
    assert hits / sum(map(len, exact.values())) >= 0.9
    assert len(push) > 10 * len(exact)


def test_ties_go_to_the_smaller_id(spark):
    g = Graph(spark.createDataFrame([(x,) for x in "abcde"], "id string"),
              spark.createDataFrame([("a", x) for x in "edcb"], "src string, dst string"))
    got = rank.top_related(g, 2).where("start_paper = 'a'").orderBy("rank").collect()
    assert [r["related_paper"] for r in got] == ["b", "c"]


def test_edges_are_not_shuffled_in_a_step(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        g = graph(spark)
        for slices in (None, 4):
            edges = SlicedEdges.of(transition_weights(g), slice_edges=slices)
            assert (edges.hubs is None) == (slices is None)
            met = edges.meet(g.vertices.withColumn("r", F.lit(1.0)), "id")
            plan = met._jdf.queryExecution().executedPlan().toString()
            scan = next(k for k, x in enumerate(plan.split("\n")) if "papyrus_buckets" in x)
            lines = plan.split("\n")
            depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
            above = [k for k in range(scan) if depth[k] < min(depth[k + 1:scan + 1])]
            assert "Bucketed: true" in lines[scan]
            join = max(k for k in above if "Join" in lines[k])
            assert not any("Exchange" in lines[k] for k in above if k > join)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_blocks_of_sources_give_the_same_ranks(spark, monkeypatch):
    """A state that would send too much is dealt by source on the way; the parts go on to the same ranks."""
    g = graph(spark)
    sources = g.vertices.select(F.col("id").alias("source"))
    weights = rank.prepared_weights(g, with_degree=True)

    def found():
        push = {(r[0], r[1]): r[2] for r in rank.push_ranks(weights, sources, 1e-3, max_iter=2).collect()}
        return push, {(r[0], r[1]): r[2] for r in rank.personalized_ranks(weights, sources, max_iter=2).collect()}

    want, most, step = found(), [], SlicedEdges.meet
    monkeypatch.setattr(rank, "BLOCK_MESSAGES", 60)
    monkeypatch.setattr(rank, "MESSAGES_PER_EDGE", 0)
    monkeypatch.setattr(SlicedEdges, "meet", lambda self, state, *a, **k: most.append(state.select("source").distinct().count()) or step(self, state, *a, **k))
    push, whole = found()
    assert len(most) > 4 and max(most) < sources.count()
    assert push == pytest.approx(want[0]) and whole == pytest.approx(want[1])


def test_best_ranks_with_ties_by_rounding(spark):
    """Rows that only rounding makes equal are ordered by id, also around the last place."""
    rows = [("s", i, v) for i, v in ((5, 0.3), (4, 0.2), (3, 0.2 + 3e-13), (2, 0.2 - 3e-13), (1, 0.1))] + [("t", 1, 0.5)]
    ranks = spark.createDataFrame(rows, "source string, id long, r double")
    got = sorted((r["source"], r["rank"], r["id"]) for r in rank._first_by_rank(ranks, 2).collect())
    assert got == [("s", 1, 5), ("s", 2, 2), ("t", 1, 1)]
