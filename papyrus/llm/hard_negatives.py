"""Hard-negative mining: exact integer scores by Strassen's multiplication,
kept in mergeable heaps.

Anchors are numbered and taken in blocks of ``BLOCK`` vectors, the only data
that goes to all tasks at once (``BLOCK`` times the dimension times 8 bytes).  Per
block, all rows are read twice.  The first pass multiplies tiles of anchors and
rows and keeps each anchor's best rows of its own label; the second keeps, for
each anchor and positive, the best rows of other labels whose score lies in the
window that the positive's score opens.  A task sends each heap once (a few rows
for each anchor), and heaps of all tasks merge in one window per anchor.  No
pair of vectors is ever a row.

Tiles are int64; blocks are padded with zeros to even sides and multiplied by
seven half-size products.  Sums are exact: overflow inside the recursion wraps
and cancels, and scores that could leave 64 bits raise an error.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part; vectors of unequal length are padded with zeros; a row
without id is no anchor and ranks after all others of its score; repeated rows
count one by one, a copy of an anchor being another row, and repeated anchors give
repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.functions.ranking import dense_index, top_k_per_group
from papyrus.session import cut_lineage, release, scratch_path

BLOCK = 4096
TILE = 512
LEAF = 32
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
_EMPTY = -(2 ** 63 - 1)


def multiply(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` by Strassen's recursion; sides of ``leaf`` or less directly."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return np.einsum("ij,jk->ik", a, b)
    if m % 2 or k % 2 or n % 2:
        return multiply(np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2))), leaf)[:m, :n]
    h, i, j = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:h, :i], a[:h, i:], a[h:, :i], a[h:, i:]
    b11, b12, b21, b22 = b[:i, :j], b[:i, j:], b[i:, :j], b[i:, j:]
    p1 = multiply(a11 + a22, b11 + b22, leaf)
    p2 = multiply(a21 + a22, b11, leaf)
    p3 = multiply(a11, b12 - b22, leaf)
    p4 = multiply(a22, b21 - b11, leaf)
    p5 = multiply(a11 + a12, b22, leaf)
    p6 = multiply(a21 - a11, b11 + b12, leaf)
    p7 = multiply(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), dtype=a.dtype)
    out[:h, :j], out[:h, j:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :j], out[h:, j:] = p2 + p4, p1 - p2 + p3 + p6
    return out


class Heaps:
    """The ``k`` best (score, id) of each row, higher scores and then smaller
    ids first, no id last."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.score = np.full((rows, k), _EMPTY, dtype=np.int64)
        self.none = np.ones((rows, k), dtype=bool)
        self.id = np.zeros((rows, k), dtype=np.int64)

    def least(self) -> np.ndarray:
        """What a score has to reach, by row."""
        return self.score[:, -1]

    def push(self, row: np.ndarray, score: np.ndarray, none: np.ndarray, ident: np.ndarray) -> None:
        if not len(row):
            return
        rows = np.unique(row)
        row = np.concatenate([np.repeat(rows, self.k), row])
        parts = [np.concatenate([own[rows].ravel(), new]) for own, new in
                 ((self.score, score), (self.none, none), (self.id, ident))]
        order = np.lexsort((parts[2], parts[1], -parts[0], row))
        best = order[np.searchsorted(row[order], rows)[:, None] + np.arange(self.k)]
        for own, part in zip((self.score, self.none, self.id), parts, strict=True):
            own[rows] = part[best]

    def batch(self, extra: list[pa.Array], names: list[str]) -> pa.RecordBatch:
        """The filled places as rows: row, the extra columns of that row, score, id."""
        row, at = np.nonzero(self.score != _EMPTY)
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [pa.array(row.astype(np.int64)), *(c.take(take) for c in extra), pa.array(self.score[row, at]),
             pa.array(self.id[row, at], mask=self.none[row, at])], names=["row", *names, "score", "id"])


class Vectors:
    """Rows (uid, id, label, vector) of an Arrow batch as arrays."""

    def __init__(self, batch):
        self.uid = batch.column(0).to_numpy(zero_copy_only=False)
        ids = batch.column(1)
        self.none = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(0).to_numpy(zero_copy_only=False)
        self.label = batch.column(2).to_numpy(zero_copy_only=False)
        lists = batch.column(3)
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.matrix = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
        self.matrix[np.arange(self.matrix.shape[1]) < sizes[:, None]] = flat

    def widened(self, width: int) -> np.ndarray:
        return np.pad(self.matrix, ((0, 0), (0, max(0, width - self.matrix.shape[1]))))


def tiles(anchors: Vectors, batches, tile: int = TILE):
    """(anchor range, rows, their range, scores, same label, itself) of every
    pair of tiles."""
    for batch in batches:
        rows = Vectors(batch)
        width = max(anchors.matrix.shape[1], rows.matrix.shape[1])
        left, right = anchors.widened(width), rows.widened(width)
        reach = [int(max(m.max(initial=0), -int(m.min(initial=0)))) for m in (left, right)]
        if reach[0] * reach[1] * max(1, width) * 100 >= 2 ** 63:
            raise ValueError("components are too large for scores of 64 bits")
        for a in range(0, len(left), tile):
            for r in range(0, len(right), tile):
                scores = multiply(left[a:a + tile], np.ascontiguousarray(right[r:r + tile].T))
                same = anchors.label[a:a + tile, None] == rows.label[None, r:r + tile]
                itself = anchors.uid[a:a + tile, None] == rows.uid[None, r:r + tile]
                yield a, r, rows, scores, same, itself


def _push(heaps: Heaps, mask: np.ndarray, first: int, step: int, scores: np.ndarray, rows: Vectors, r: int) -> None:
    at, of = np.nonzero(mask)
    heaps.push(first + at * step, scores[at, of], rows.none[r + of], rows.id[r + of])


def best_positives(anchors: Vectors, batches, k: int) -> Heaps:
    heaps = Heaps(len(anchors.id), k)
    for a, r, rows, scores, same, itself in tiles(anchors, batches):
        enough = scores >= heaps.least()[a:a + len(scores), None]
        _push(heaps, same & ~itself & enough, a, 1, scores, rows, r)
    return heaps


def best_negatives(anchors: Vectors, positives: np.ndarray, batches, k: int, low: int, high: int) -> Heaps:
    """``positives``: the scores of each anchor's positives, _EMPTY for none."""
    width = positives.shape[1]
    heaps = Heaps(len(anchors.id) * width, k)
    there = positives != _EMPTY
    known = np.where(there, positives, 0)
    least, most = -(-low * known // 100), high * known // 100
    for a, r, rows, scores, same, _ in tiles(anchors, batches):
        part = slice(a, a + len(scores))
        for p in range(width):
            if there[part, p].any():
                floor = np.maximum(least[part, p], heaps.least()[p::width][part])
                mask = ~same & (scores >= floor[:, None]) & (scores <= most[part, p, None]) & there[part, p, None]
                _push(heaps, mask, a * width + p, width, scores, rows, r)
    return heaps


def quantised(embeddings: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(uid, id, label, vector) of the rows that take part, written; components
    are floor(256 x), labels of ids divisible by 7 are moved on by one of ten."""
    x = F.col(vector_col).cast("array<double>")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    label = F.col(label_col).cast("long")
    moved = F.when(F.col(id_col) % 7 == 0, (label + 1) % 10).otherwise(label)
    kept = embeddings.where(label.isNotNull() & x.isNotNull() & ~odd)
    return cut_lineage(kept.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), moved.alias("label"),
        F.transform(x, lambda v: F.floor(256 * v)).alias("vector")))


def mine(rows: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """``rows`` (uid, id, label, vector), ``uid`` unique; per anchor and positive
    the first ``negatives`` rows of the window: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    spark = rows.sparkSession
    anchors = cut_lineage(dense_index(rows.where(is_anchor & F.col("id").isNotNull()), [F.col("id"), F.col("uid")], "row"))
    total = anchors.count()
    best = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    path = scratch_path(spark, "negatives")
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    spark.createDataFrame([], schema).write.parquet(path)
    for first in range(0, total, block):
        of_block = anchors.where(F.col("row").between(first, first + block - 1)).select("uid", "id", "label", "vector")
        table = of_block.toArrow().sort_by([("id", "ascending"), ("uid", "ascending")]).combine_chunks()
        own = Vectors(table.to_batches()[0])
        n = len(own.id)

        def nearest(batches, own=own):
            yield best_positives(own, batches, positives).batch([], [])

        found = top_k_per_group(rows.mapInArrow(nearest, "row long, score long, id long"), ["row"], best, positives, "place")
        scores, ids = np.full((n, positives), _EMPTY, dtype=np.int64), [None] * (n * positives)
        for r in found.toLocalIterator():
            scores[r["row"], r["place"] - 1] = r["score"]
            ids[r["row"] * positives + r["place"] - 1] = r["id"]

        def windows(batches, own=own, scores=scores, ids=ids):
            pairs = [pa.array(np.repeat(own.id, positives)), pa.array(ids, pa.int64()), pa.array(scores.ravel())]
            yield best_negatives(own, scores, batches, negatives, low, high).batch(
                pairs, ["anchor_id", "positive_id", "positive_score"])

        made = rows.mapInArrow(windows, "row long, anchor_id long, positive_id long, positive_score long, score long, id long")
        last = top_k_per_group(made, ["row"], best, negatives, "rank")
        last.select("anchor_id", "positive_id", F.col("rank").cast("int"), F.col("id").alias("negative_id"),
                    "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
    release(anchors)
    return spark.read.schema(schema).parquet(path)


SQL = f"""WITH usable AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS same,
    CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.uid <> b.uid),
positives AS (
  SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS place FROM scored WHERE same
  QUALIFY place <= {POSITIVES})
SELECT p.anchor_id, p.vec_id AS positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id NULLS LAST) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
  AND {LOW} * p.score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.score
QUALIFY rank <= {NEGATIVES}"""
