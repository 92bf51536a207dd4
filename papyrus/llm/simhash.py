"""SimHash near-duplicates with vantage-point trees.

Fingerprints are 64 majority bits over the XXH64 (seed 42) of word shingles.
Two fingerprints link when they differ in ``max_bits`` bits or fewer;
documents of one connected component are near-duplicates.

The search is exact.  A vantage point gives every fingerprint its distances
to it inside disjoint blocks of bits.  For a linked pair these distances
differ by ``max_bits`` in total at most (the triangle bound per block,
summed), so a fingerprint lives in the shard of its own distances and is sent
as a query to the shards that the bound leaves open, and no further.  Inside
a shard a vantage-point tree over narrower blocks prunes branches by what is
left of the bound, and leaves compare bits directly.

Copies never meet in pairs: equal fingerprints are grouped first, a shard
returns one link per fingerprint to the smallest one it reaches there, and
components come from a star contraction over these links.

Defined results: a null or empty text has fingerprint zero and links like any
other; null ids are ignored when the smallest id of a component is taken (a
component of null ids only has a null id); repeated rows are all returned; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.llm import texts as X
from papyrus.session import cut_lineage

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Members that the fullest shard of evenly spread fingerprints may hold.
SHARD_MEMBERS = 1 << 16
LEAF = 32
_CELLS = 1 << 21
_VOTES = 1 << 16
_LOWER = np.frombuffer(X.LOWER_AZ, dtype=np.uint8)


def _votes(hashes: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document and bit, the number of hashes with the bit set."""
    votes = np.zeros((n_docs, 64), dtype=np.int64)
    for at in range(0, len(hashes), _VOTES):
        block, owner = hashes[at:at + _VOTES], doc[at:at + _VOTES]
        bits = np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        votes[owner[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return votes


def fingerprints_of(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text, as unsigned 64-bit integers."""
    w = X.Words(texts)
    keep = ~w.space
    keep[w.ends] = True
    raw = _LOWER[np.where(w.space, 0x20, w.buf)[keep]].tobytes()
    lengths = w.ends - w.starts
    start = np.cumsum(lengths + 1) - lengths - 1
    end = start + lengths
    n_words = np.diff(w.first)
    head = np.flatnonzero(w.doc[:-shingle + 1 or None] == w.doc[shingle - 1:]) if len(start) >= shingle else np.zeros(0, int)
    few = np.flatnonzero((n_words > 0) & (n_words < shingle))
    begins = np.concatenate([start[head], start[w.first[few]]])
    stops = np.concatenate([end[head + shingle - 1], end[w.first[few + 1] - 1]])
    owner = np.concatenate([w.doc[head], few])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], SEED) for a, b in zip(begins.tolist(), stops.tolist(), strict=True)),
                         dtype=np.uint64, count=len(begins))
    count = np.bincount(owner, minlength=len(texts))
    set_ = 2 * _votes(hashes, owner, len(texts)) > count[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, bits): the fingerprint as a signed 64-bit integer."""
    return X.per_text(docs, id_col, text_col, [X.field("bits", "long")],
                      lambda texts: [fingerprints_of(texts, shingle).view(np.int64)])


# ------------------------------------------------------------------ shards

def _blocks(n: int) -> list[int]:
    """Masks of n equal blocks of 64 bits."""
    width = 64 // n
    return [((1 << width) - 1) << (width * k) for k in range(n)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _ball(dims: int, radius: int) -> list[tuple[int, ...]]:
    """Steps of total size ``radius`` or less whose first part other than
    zero is positive, zero itself first: each pair of shards once."""
    steps: list[tuple[int, ...]] = [()]
    for _ in range(dims):
        steps = [s + (d,) for s in steps for d in range(-radius, radius + 1) if sum(map(abs, s)) + abs(d) <= radius]
    return [(0,) * dims] + [s for s in steps if any(s) and next(d for d in s if d) > 0]


def _levels(n: int) -> int:
    """Blocks of the shard key, by the share of a block's most common distance."""
    for blocks, share in ((2, 0.14 ** 2), (4, 0.196 ** 4)):
        if n * share <= SHARD_MEMBERS:
            return blocks
    return 8


def to_shards(prints: DataFrame, vantage: int, blocks: int, max_bits: int) -> DataFrame:
    """(shard, bits, member): members once, queries for every other shard in
    reach of the triangle bound."""
    masks = _blocks(blocks)
    width = 64 // blocks
    spot = [F.bit_count(F.col("bits").bitwiseXOR(F.lit(_signed(vantage))).bitwiseAND(F.lit(_signed(m)))) for m in masks]
    step = F.explode(F.array(*(F.array(*(F.lit(d) for d in s)) for s in _ball(blocks, max_bits))))
    moved = prints.select("bits", F.array(*spot).alias("spot"), step.alias("step"))
    parts = [F.col("spot")[k] + F.col("step")[k] for k in range(blocks)]
    inside = None
    for p in parts:
        ok = (p >= 0) & (p <= width)
        inside = ok if inside is None else inside & ok
    shard = parts[0].cast("long")
    for p in parts[1:]:
        shard = shard * (width + 1) + p
    member = F.forall("step", lambda d: d == 0)
    return moved.where(inside).select(shard.alias("shard"), "bits", member.alias("member"))


class Links:
    """Union of index pairs, kept as one parent per index."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        up = self.parent[at]
        while True:
            upper = self.parent[up]
            if np.array_equal(upper, up):
                return up
            up = upper

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.parent, high, low)
            a, b = low, high


#: Bits of the tree's levels: wide blocks first; for what is still together
#: after them, narrow blocks, with the bound counted anew.
_WIDE = 4
_RINGS = [np.uint64(m) for m in _blocks(_WIDE) + _blocks(8)]


def near(members: np.ndarray, queries: np.ndarray, max_bits: int):
    """Yield (query indices, member indices) of all pairs within ``max_bits``:
    a vantage-point tree over the members, walked by all queries at once."""
    def leaf(m, q):
        rows = max(1, _CELLS // len(m))
        for at in range(0, len(q), rows):
            part = q[at:at + rows]
            i, j = np.nonzero(np.bitwise_count(queries[part][:, None] ^ members[m][None, :]) <= max_bits)
            if len(i):
                yield part[i], m[j]

    def walk(m, q, left, depth):
        if len(m) <= LEAF or len(q) <= 4 or depth == len(_RINGS):
            yield from leaf(m, q)
            return
        if depth == _WIDE:
            left = np.full(len(q), max_bits, dtype=np.int8)
        point, mask = members[m[len(m) // 2]], _RINGS[depth]
        ring = np.bitwise_count((members[m] ^ point) & mask).astype(np.int8)
        seen = np.bitwise_count((queries[q] ^ point) & mask).astype(np.int8)
        for r in np.unique(ring):
            rest = left - np.abs(seen - r)
            open_ = rest >= 0
            if open_.any():
                yield from walk(m[ring == r], q[open_], rest[open_], depth + 1)

    if len(members) and len(queries):
        yield from walk(np.arange(len(members)), np.arange(len(queries)),
                        np.full(len(queries), max_bits, dtype=np.int8), 0)


def shard_links(bits: np.ndarray, member: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits, smallest linked bits in this shard) of the fingerprints that
    link to a member, other than that smallest one itself."""
    order = np.lexsort((bits, ~member))
    bits, member = bits[order], member[order]
    n = int(member.sum())
    if not n:
        return bits[:0], bits[:0]
    links = Links(len(bits))
    words = bits.view(np.uint64)
    for q, m in near(words[:n], words, max_bits):
        links.join(q, m)
    root = links.roots(np.arange(len(bits)))
    moved = root != np.arange(len(bits))
    return bits[moved], bits[root[moved]]


def link_table(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) whose connected components are those of all pairs of
    distinct fingerprints ``bits`` within ``max_bits``."""
    picked = prints.agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("bits"), "bits"))["bits"].alias("at")).first()
    vantage = (picked["at"] or 0) % (1 << 64)
    spread = to_shards(prints, vantage, _levels(picked["n"]), max_bits)

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        u, v = shard_links(frame["bits"].to_numpy(), frame["member"].to_numpy(), max_bits)
        return pd.DataFrame({"u": u, "v": v})

    return spread.groupBy("shard").applyInPandas(search, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(u, root): the smallest node of the connected component of every node
    of links (u, v), by alternating large and small stars.  Minima are
    aggregated before the shuffle and joined back, so the neighbours of a
    node are never gathered."""
    edges = cut_lineage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where("u <> v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("low"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct())
        large = cut_lineage(large)
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u")
        small = (small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionByName(low.select("u", F.col("low").alias("v"))).where("u <> v").distinct())
        edges = cut_lineage(small)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.xxhash64("v", "u") % 998244353)).first()
        if now == state:
            return edges.select("u", F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(id, bits, component_id): component_id is the smallest id of the
    document's component."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    distinct = cut_lineage(rows.groupBy("bits").agg(F.min(id_col).alias("low")))
    roots = components(link_table(distinct.select("bits"), max_bits)).withColumnRenamed("u", "bits")
    rooted = distinct.join(roots, "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    smallest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    owner = cut_lineage(rooted.join(smallest, "root").select("bits", "component_id"))
    return rows.join(owner, "bits").select(id_col, "bits", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, with all its columns: the one with the
    smallest id (nulls last); among rows that repeat this id, one text and
    one row by hash order."""
    key = X.fresh("row_key", docs)
    row = F.struct(F.xxhash64(id_col, text_col), F.xxhash64(text_col, F.lit(1), id_col))
    keyed = docs.withColumn(key, row)
    named = keyed.select(F.struct(F.isnull(id_col).alias("last"), F.col(id_col).alias("id"), F.col(key).alias("key")).alias("row"),
                         F.col(text_col).alias("text"))
    found = near_duplicates(named, "row", "text", shingle, max_bits)
    winners = found.select(F.col("component_id")["key"].alias(key)).distinct()
    return keyed.join(winners, key, "left_semi").dropDuplicates([key]).drop(key)
