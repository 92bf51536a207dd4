"""Hard negatives against brute force over all pairs."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrus.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, uid string, row string, score string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def usable(rows):
    kept = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    return kept


def brute(rows):
    kept, out = usable(rows), []
    for a, (i, label, v) in enumerate(kept):
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j, other) for b, (j, other, w) in enumerate(kept) if b != a),
                        key=lambda r: r[:3])
        for p in [r for r in scored if r[4] == label][:5]:
            window = [n for n in scored if n[4] != label and -50 * p[0] <= -100 * n[0] <= -95 * p[0]]
            out += [(i, p[3], k, n[3], -p[0], -n[0]) for k, n in enumerate(window[:3], 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **kw):
    got = H.mine(H.quantised(frame(spark, rows)), F.col("id") % 50 == 0, **kw)
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    centre = rng.normal(size=(4, 12))
    rows = [(k, (centre[k % 4] + 0.4 * rng.normal(size=12)).tolist(), k % 4) for k in range(400)]
    rows += [(k, rows[k][1], rows[k][2]) for k in (50, 50, 100, 107, 350)]        # repeated rows, one an anchor
    rows += [(50, rows[3][1], 1), (None, rows[5][1], 2), (None, rows[5][1], 2), (450, None, 1), (500, [1.0] * 12, None),
             (550, [math.nan] + [0.0] * 11, 1), (551, [math.inf] * 12, 1), (552, [None] + [1.0] * 11, 1), (600, [0.0] * 12, 1),
             (650, [], 2), (651, [2.0, -1.0], 2), (700, [-x for x in rows[0][1]], 0)]
    rows += [(1000 + k, [0.5] * 12, k % 3) for k in range(60)]                  # ties
    return rows


def test_all_pairs(spark, rows):
    want = brute(rows)
    assert len(want) > 60
    assert mined(spark, rows) == want
    assert mined(spark, rows, block=3) == want


def test_nothing_to_mine(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1)]) == []
    assert mined(spark, [(50, [1.0], 1), (51, [1.0], 1), (52, None, 2)]) == []


def test_scores_out_of_range_are_refused(spark):
    with pytest.raises(Exception, match="too large for scores"):
        mined(spark, [(50, [1e16], 1), (51, [1e16], 1)])


def test_products_are_exact():
    rng = np.random.default_rng(3)
    for m, k, n in [(1, 1, 1), (33, 65, 40), (100, 64, 70), (64, 64, 64), (130, 7, 130), (35, 0, 35)]:
        a, b = (rng.integers(-2 ** 26, 2 ** 26, size) for size in ((m, k), (k, n)))
        assert (H.multiply(a, b, leaf=4) == a @ b).all()


def test_heaps_merge_as_a_sort_does():
    rng = np.random.default_rng(5)
    heaps, every = H.Heaps(6, 3), defaultdict(list)
    for _ in range(20):
        n = int(rng.integers(0, 30))
        row, score, ident, none = rng.integers(0, 6, n), rng.integers(-4, 4, n), rng.integers(0, 50, n), rng.random(n) < 0.1
        heaps.push(row, score, none, ident)
        for r, s, i, x in zip(row.tolist(), score.tolist(), ident.tolist(), none.tolist()):
            every[r].append((-s, x, i))
    for r in range(6):
        assert [(-s, x, i) for s, x, i in zip(heaps.score[r].tolist(), heaps.none[r].tolist(), heaps.id[r].tolist())] == sorted(every[r])[:3]
