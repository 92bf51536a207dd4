"""Benchmark decontamination with Wu-Manber multi-pattern search.

A window is 13 consecutive words of a benchmark item (an item of fewer words
is one window).  Texts are lower-cased (A-Z) and reduced to words joined by
single spaces; each window becomes the byte string `` w1 ... w13 ``.  A
shift table over blocks of bytes skips positions where no window can end,
suffix buckets pick the windows that share the block under the cursor, and a
direct comparison confirms each occurrence.  The cursors of many lanes move
together as numpy arrays.

The benchmark is the stated query set: it is read in blocks of at most
``BLOCK_BYTES`` of item text (one item, if longer), and all documents pass
each block, so its size has no cap.  The driver and a worker hold one block at
a time; a worker builds its matcher once.

Defined results: null or empty texts have no words and no hits; null items
and items without words give no window; equal windows of several items count
for each of them; a null item id is written as the empty string; null and
repeated document ids pass through row by row; an empty benchmark hits
nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrus.llm import texts as X
from papyrus.session import cut_lineage

WINDOW = 13
BLOCK_BYTES = 16 << 20
SLICE = 4 << 20
LANE = 4096
TABLE_BITS = 18
#: 0-9, a-z (A-Z lower-cased) and all bytes from 0x80 are word bytes.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
              for b in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def folded(text: bytes) -> bytes:
    return text.translate(_FOLD)


def windows(items: list[tuple[str, bytes]], size: int = WINDOW) -> dict[bytes, list[str]]:
    """Window bytes to the ids of the items that hold it."""
    found: dict[bytes, list[str]] = {}
    for item, text in items:
        words = folded(text).split()
        for i in range(max(1, len(words) - size + 1) if words else 0):
            owners = found.setdefault(b" " + b" ".join(words[i:i + size]) + b" ", [])
            if item not in owners:
                owners.append(item)
    return found


def _u64(raw: bytes) -> np.ndarray:
    """The eight bytes from every position, little-endian (zeros past the end)."""
    return np.ndarray((len(raw),), dtype="<u8", buffer=raw + bytes(8), strides=(1,))


def _mask(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


class WuManber:
    """Search for patterns of at least ``m`` bytes, the shortest among them."""

    def __init__(self, patterns: list[bytes]):
        self.patterns = patterns
        self.m = m = min(map(len, patterns))
        self.block = block = min(8, (m + 1) // 2)
        self.mask, self.head = _mask(block), _mask(min(8, m))
        heads = np.frombuffer(b"".join(p[:m] for p in patterns) + bytes(8), dtype=np.uint8)
        blocks = np.ndarray((len(patterns), m - block + 1), dtype="<u8", buffer=heads, strides=(m, 1)) & self.mask
        self.shift = np.full(1 << TABLE_BITS, m - block + 1, dtype=np.int64)
        for j in range(m - block + 1):
            np.minimum.at(self.shift, self._slot(blocks[:, j]), m - block - j)
        self.order = np.argsort(blocks[:, -1], kind="stable")
        self.suffix = blocks[self.order, -1]
        self.prefix = np.array([int.from_bytes(p[:min(8, m)], "little") for p in patterns], dtype=np.uint64)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys * _MUL) >> np.uint64(64 - TABLE_BITS)

    def search(self, raw: bytes) -> list[tuple[int, int]]:
        """(position, pattern) of every occurrence."""
        stop = len(raw) - self.m + 1
        if stop <= 0:
            return []
        view, tail = _u64(raw), self.m - self.block
        at = np.arange(0, stop, LANE)
        end = np.minimum(at + LANE, stop)
        places, keys = [], []
        while len(at):
            key = view[at + tail] & self.mask
            step = self.shift[self._slot(key)]
            zero = step == 0
            if zero.any():
                places.append(at[zero])
                keys.append(key[zero])
            at = at + np.maximum(step, 1)
            left = at < end
            at, end = at[left], end[left]
        if not places:
            return []
        place, key = np.concatenate(places), np.concatenate(keys)
        lo = np.searchsorted(self.suffix, key, side="left")
        n = np.searchsorted(self.suffix, key, side="right") - lo
        place, lo, n = place[n > 0], lo[n > 0], n[n > 0]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pattern = self.order[np.repeat(lo, n) + within]
        place = np.repeat(place, n)
        same = (view[place] & self.head) == self.prefix[pattern]
        return [(p, k) for p, k in zip(place[same].tolist(), pattern[same].tolist(), strict=True)
                if raw.startswith(self.patterns[k], p)]


class Matcher:
    """Wu-Manber searchers for the windows of one benchmark block, by classes
    of length, so that a short item does not shorten the skips of the rest."""

    CLASSES = (8, 16, 32, 64)

    def __init__(self, found: dict[bytes, list[str]]):
        self.owners = found
        classes: dict[int, list[bytes]] = {}
        for p in found:
            classes.setdefault(sum(len(p) >= c for c in self.CLASSES), []).append(p)
        self.searchers = [WuManber(p) for p in classes.values()]

    def match(self, texts: list[bytes]) -> tuple[np.ndarray, list[set[int]], list[set[str]]]:
        """Per text: the number of words, the hit words, the items hit."""
        raw = np.frombuffer(b" " + b" \n ".join(folded(t) for t in texts) + b" ", dtype=np.uint8)
        blank = raw == 0x20
        kept = raw[~(blank & np.concatenate([[False], blank[:-1]]))]
        gaps = np.flatnonzero(kept == 0x20)
        breaks = np.concatenate([np.flatnonzero(kept == 0x0A), [len(kept)]])
        upto = np.searchsorted(gaps, breaks)
        first = np.concatenate([[0], upto[:-1]])
        n_words = upto - first - 1
        hit: list[set[int]] = [set() for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        body = kept.tobytes()
        for s in self.searchers:
            found = s.search(body)
            if not found:
                continue
            places = np.array([p for p, _ in found])
            docs = np.searchsorted(breaks, places)
            nth = np.searchsorted(gaps, places) - first[docs]
            for d, w, (_, k) in zip(docs.tolist(), nth.tolist(), found, strict=True):
                pattern = s.patterns[k]
                hit[d].update(range(w, w + pattern.count(b" ") - 1))
                items[d].update(self.owners[pattern])
        return n_words, hit, items


def benchmark_blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, bytes]]]:
    """The query set in blocks of bounded size, as (id as text, text), one
    after the other: the driver holds one block and a partition of the table."""
    rows = benchmark.select(benchmark[id_col].cast("string"), benchmark[text_col].cast("string"))
    block: list[tuple[str, bytes]] = []
    size = 0
    for item, text in rows.toLocalIterator():
        raw = (text or "").encode()
        if block and size + len(raw) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item or "", raw))
        size += len(raw)
    yield block


_FIELDS = [X.field("n_words", "long"), X.field("hit_words", "binary"),
           T.StructField("items", T.ArrayType(T.StringType()), True)]


def _pack(words: set[int]) -> bytes:
    return np.array(sorted(words), dtype="<u4").tobytes()


#: The matcher that this worker built last, with the name of its block.
_built: list[tuple[str, Matcher]] = []


def _matcher(name: str, block: Broadcast) -> Matcher:
    """The matcher of a block, built once a worker and not once a task."""
    if not _built or _built[0][0] != name:
        _built.clear()
        _built.append((name, Matcher(windows(block.value))))
    return _built[0][1]


class Blocks:
    """The blocks of a benchmark; ``single`` is the only one, or None where
    there are several, which :meth:`hits` takes one after the other."""

    def __init__(self, benchmark: DataFrame, item_col: str, item_text_col: str):
        found = benchmark_blocks(benchmark, item_col, item_text_col)
        self.context = benchmark.sparkSession.sparkContext
        first = next(found)
        second = next(found, None)
        self.single = self._shared(first) if second is None else None
        self.rest = () if second is None else chain([first, second], found)

    def _shared(self, block) -> tuple[str, Broadcast]:
        return uuid.uuid4().hex, self.context.broadcast(block)

    def hits(self, docs: DataFrame, text_col: str) -> DataFrame:
        """``(digest, n_words, hit_words, items)`` of the texts with a hit, one
        row for each different text.

        Every block is one pass over the documents, which sends the hits of a
        text alone, under the SHA-256 of the text: hits depend on the text
        only, so copies are one group and are met before the shuffle.
        """
        parts = None
        for block in self.rest:
            name, shared = self._shared(block)
            found = cut_lineage(_hits_of(docs, text_col, name, shared).dropDuplicates(["digest"]))
            shared.destroy()
            parts = found if parts is None else parts.unionByName(found)
        united = parts.groupBy("digest").agg(F.first("n_words").alias("n_words"), F.collect_list("hit_words").alias("hit_words"),
                                             F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        return cut_lineage(united.mapInArrow(_united, _HITS))


_HITS = T.StructType([X.field("digest", "string"), *_FIELDS])


def _digest(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _hits_of(docs: DataFrame, text_col: str, name: str, block: Broadcast) -> DataFrame:
    def run(batches):
        for part in X.slices(batches, 0, SLICE):
            texts = X.as_bytes(part.column(0))
            n_words, hit, items = _matcher(name, block).match(texts)
            rows = [d for d in range(len(texts)) if hit[d]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_digest(texts[d]) for d in rows], pa.string()), pa.array([int(n_words[d]) for d in rows], pa.int64()),
                 pa.array([_pack(hit[d]) for d in rows], pa.binary()),
                 pa.array([sorted(items[d]) for d in rows], pa.list_(pa.string()))], names=_HITS.names)

    return docs.select(docs[text_col].cast("string")).mapInArrow(run, _HITS)


def _united(batches):
    """One sorted list of positions from those of the blocks."""
    for b in batches:
        hit = [np.unique(np.frombuffer(b"".join(parts), dtype="<u4")).astype("<u4").tobytes()
               for parts in b.column("hit_words").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n_words"), pa.array(hit, pa.binary()),
                                          b.column("items")], names=_HITS.names)


def scan(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: n_words, hit_words (word positions, ascending unsigned
    32-bit little-endian), items (ids of items with occurring windows).

    A benchmark of one block takes one pass and no shuffle.  With more, each
    is a pass that sends hits, and the documents' ids, digests and numbers of
    words meet the hits by the digest of the text.
    """
    blocks = Blocks(benchmark, item_col, item_text_col)
    if blocks.single is not None:
        name, shared = blocks.single

        def run(texts):
            n_words, hit, items = _matcher(name, shared).match(texts)
            return [n_words, [_pack(h) for h in hit], [sorted(i) for i in items]]

        return X.per_text(docs, id_col, text_col, _FIELDS, run, SLICE)
    hits = blocks.hits(docs, text_col)

    def count(texts):
        return [[_digest(t) for t in texts], [len(folded(t).split()) for t in texts]]

    key = X.fresh("digest", docs.select(id_col))
    counted = X.per_text(docs, id_col, text_col, [X.field(key, "string"), X.field("n_words", "long")], count, SLICE)
    met = counted.join(hits.drop("n_words").withColumnRenamed("digest", key), key, "left")
    return met.select(id_col, "n_words", F.coalesce("hit_words", F.lit(b"")).alias("hit_words"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    blocks = Blocks(benchmark, item_col, item_text_col)
    if blocks.single is not None:
        name, shared = blocks.single

        def keep(texts):
            n_words, hit, _ = _matcher(name, shared).match(texts)
            return np.array([not contaminated(int(n), len(h)) for n, h in zip(n_words, hit, strict=True)])

        return X.filter_texts(docs, text_col, keep)
    n_hit = F.length("hit_words") / F.lit(4)
    key = X.fresh("digest", docs)
    bad = blocks.hits(docs, text_col).where(20 * n_hit >= F.col("n_words")).select(F.col("digest").alias(key))
    return (docs.withColumn(key, F.sha2(docs[text_col].cast("string"), 256))
            .join(cut_lineage(bad), key, "left_anti").select(*docs.columns))
