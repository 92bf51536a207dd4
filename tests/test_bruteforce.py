"""Distributed ranks and labels against dense brute force on a small graph
with a hub (a third of the edges touch one vertex), parallel edges, a
self-loop, a sink and an edge leaving the vertex set."""

import random
from collections import Counter

import numpy as np
import pytest

from papyrus.operators import community, rank
from papyrus.operators.graph import Graph

N = 30


def edges_list():
    rnd = random.Random(7)
    ids = [f"v{i:02d}" for i in range(N)]
    e = [(rnd.choice(ids[1:]), rnd.choice(ids[1:])) for _ in range(60)]
    e += [(x, "v00") for x in ids[1:20]] + [("v00", x) for x in ids[10:25]]   # the hub
    e += [("v05", "v06"), ("v05", "v06"), ("v07", "v07"), ("v08", "outside")]
    return ids, e


def graph(spark):
    ids, e = edges_list()
    return Graph(spark.createDataFrame([(x,) for x in ids], "id string"),
                 spark.createDataFrame(e, "src string, dst string"))


def dense_ranks(source=None, iters=10, reset=0.15):
    ids, e = edges_list()
    pos = {x: i for i, x in enumerate(ids)}
    inside = [(s, d) for s, d in e if s in pos and d in pos]
    out = Counter(s for s, _ in inside)
    m = np.zeros((N, N))
    for s, d in inside:
        m[pos[d], pos[s]] += 1.0 / out[s]
    if source is None:
        r = np.ones(N)
        for _ in range(iters):
            r = reset + (1 - reset) * m @ r
        return dict(zip(ids, r * N / r.sum()))
    e_s = np.zeros(N)
    e_s[pos[source]] = 1.0
    r = e_s.copy()
    for _ in range(iters):
        r = reset * e_s + (1 - reset) * m @ r
    return dict(zip(ids, r / r.sum()))


def dense_labels(iters):
    ids, e = edges_list()
    known = set(ids)
    nbrs = {x: [] for x in ids}
    for s, d in e:
        if s in known and d in known:
            nbrs[d].append(s)
            nbrs[s].append(d)
    lab = {x: x for x in ids}
    for _ in range(iters):
        new = {}
        for x in ids:
            if not nbrs[x]:
                new[x] = lab[x]
                continue
            c = Counter(lab[y] for y in nbrs[x])
            new[x] = min(c, key=lambda k: (-c[k], k))
        lab = new
    return lab


def test_plain_pagerank_matches_dense(spark):
    got = {r.paper_doi: r.pagerank for r in rank.pagerank(graph(spark), max_iter=12).collect()}
    want = dense_ranks(iters=12)
    assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("src", ["v00", "v05", "v24"])
def test_personalized_matches_dense(spark, src):
    got = {r.related_paper: r.pagerank for r in rank.topic_pagerank(graph(spark), src).collect()}
    want = {k: v for k, v in dense_ranks(src).items() if k != src and v > 1e-5}
    assert got == pytest.approx(want, abs=1e-12)


def test_label_propagation_matches_rule(spark):
    got = {r.id: r.label for r in community.label_propagation(graph(spark), 6).collect()}
    assert got == dense_labels(6)
