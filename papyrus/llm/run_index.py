"""Substring dedup with a run-length index.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts
earlier (in a document of smaller id, or earlier in its own document).

Equal strings meet by content: every window of ``LENGTH`` bytes has an anchor,
the leftmost of its ``GRAM``-byte grams with the smallest hash, and windows in
a row with the same anchor form a segment.  Anchors are counted first, and
only segments whose anchor occurs again are sent, by anchor, to a shard; of
equal segments in one task only the first is sent.  A shard concatenates its
distinct segments in document order and builds a run-length index over
batches of whole anchors: the Burrows-Wheeler transform as runs, with the text
positions at the ends of the runs sampled.  From these samples the matching
statistics stream over the text (length and source of the match of every
position); sources with long matches form classes of equal windows, of which
all but the earliest are marked.

Defined results: a null text counts as empty; rows without an id rank after
all others (ids are below 2^62), in order of a hash; rows that repeat an id
rank in order of their text's hash, all 63 bits of which tell them apart, and
equal rows share one result, none being earlier than the other; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrus.llm import texts as X
from papyrus.session import cut_lineage

LENGTH = 100
GRAM = 32
#: Bytes of segments that one index is built over.
BATCH_BYTES = 1 << 20
#: Segments that a task remembers to send equal ones once.
MEMORY = 1 << 18
_CHUNK = 1 << 19
#: Ranks of rows without an id start here and follow the hash.
_NULLS = 1 << 62


# ----------------------------------------------------------------- anchors

def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    out, size = x, 1
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:len(out) - (width - size)], out[width - size:]) if size < width else out


def segments(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first window, number of windows, anchor's offset in the first
    window, anchor's hash) of every segment, in order."""
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    grams = length - gram + 1
    found = []
    for at in range(0, max(0, len(buf) - length + 1), _CHUNK):
        body = buf[at:at + _CHUNK + length - 1]
        hashes = X.gram_hashes(body, gram)
        place = np.arange(len(hashes), dtype=np.uint64)
        spot = _sliding_min((hashes >> np.uint64(20) << np.uint64(20)) | place, grams) & np.uint64((1 << 20) - 1)
        spot = spot.astype(np.int64)
        window = at + np.arange(len(spot))
        owner = np.searchsorted(ends, window, side="right")
        inside = window + length <= ends[np.minimum(owner, len(ends) - 1)]
        new = np.flatnonzero(inside & ((np.diff(spot, prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0)
                                       | ~np.concatenate([[False], inside[:-1]])))
        total = np.concatenate([[0], np.cumsum(inside)])
        count = total[np.append(new[1:], len(spot))] - total[new]
        text = owner[new]
        found.append((text, window[new] - (ends[text] - sizes[text]), count, spot[new] - new,
                      hashes[spot[new]].view(np.int64)))
    if not found:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


# ------------------------------------------------------------------- index

def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling from eight bytes on; only suffixes that
    are still tied are sorted again."""
    n = len(text)
    raw = text.tobytes() + bytes(8)
    # ends are told from zero bytes by the suffix length, as the lower key
    key = np.ndarray((n,), dtype=">u8", buffer=raw, strides=(1,)).astype(np.uint64)
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    sorted_ = key[order]
    # among equal padded keys a suffix that ends within them is smaller the
    # shorter it is: only the keys of the last seven can have such a tie
    for value in np.unique(key[max(0, n - 7):]):
        a, b = np.searchsorted(sorted_, value), np.searchsorted(sorted_, value, side="right")
        if b - a > 1:
            order[a:b] = order[a:b][np.argsort(np.minimum(n - order[a:b], 8), kind="stable")]
    short = np.minimum(n - order, 8)
    new = np.concatenate([[True], (np.diff(sorted_) != 0) | (np.diff(short) != 0)])
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    depth = 8
    # tied rows: those that share their rank with a neighbour; later ones are among them
    at, ranks = np.arange(n), rank[order]
    while True:
        same = np.diff(ranks) == 0
        tied = at[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if n else at
        if not len(tied):
            return order
        rows = order[tied]
        ahead = rows + depth
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        pair = rank[rows] * (n + 1) + after
        turn = np.argsort(pair)
        rows, pair = rows[turn], pair[turn]
        order[tied] = rows
        new = np.concatenate([[True], np.diff(pair) != 0])
        at, ranks = tied, tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rank[rows] = ranks
        depth *= 2


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b, eight bytes a
    step."""
    n = len(text)
    words = np.ndarray((n,), dtype="<u8", buffer=text.tobytes() + bytes(8), strides=(1,))
    out = np.zeros(len(a), dtype=np.int64)
    at = np.arange(len(a))
    a, b = a.copy(), b.copy()
    while len(at):
        diff = words[a] ^ words[b]
        low = diff & (~diff + np.uint64(1))
        step = np.where(diff == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
        step = np.minimum(step, n - np.maximum(a, b))
        out[at] += step
        go = (step == 8) & (np.maximum(a, b) + 8 < n)
        at, a, b = at[go], a[go] + 8, b[go] + 8
    return out


@dataclass
class RunIndex:
    """Burrows-Wheeler transform of a text as runs, sampled at run ends.

    ``symbol`` and ``length`` are the runs in order; ``head`` is the text
    position of each run's first row and ``before`` that of the row above it,
    which ends the run above; ``match`` is the length these two share."""

    symbol: np.ndarray
    length: np.ndarray
    head: np.ndarray
    before: np.ndarray
    match: np.ndarray
    size: int

    @classmethod
    def build(cls, text: np.ndarray) -> RunIndex:
        order = suffix_order(text)
        last = np.where(order > 0, text[order - 1].astype(np.int16), np.int16(-1))
        first = np.flatnonzero(np.diff(last, prepend=np.int16(-2)))
        head = order[first]
        before = np.where(first > 0, order[first - 1], -1)
        match = np.zeros(len(first), dtype=np.int64)
        match[1:] = common_prefix(text, head[1:], before[1:])
        return cls(last[first], np.diff(np.append(first, len(order))), head, before, match, len(order))

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, source) for every position of the text: the match with
        the suffix next before it in order.  Inside a run both suffixes step
        on together, so the match of a position is that of the last run head
        before it, shortened by the distance."""
        at = np.argsort(self.head)
        head, before, match = self.head[at], self.before[at], self.match[at]
        # position 0 precedes no symbol and so is always a run head
        distance = np.arange(self.size) - np.repeat(head, np.diff(np.append(head, self.size)))
        run = np.repeat(np.arange(len(head)), np.diff(np.append(head, self.size)))
        return np.maximum(match[run] - distance, 0), before[run] + distance


def mark(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For distinct pieces in document order: the windows of each whose
    string also starts at an earlier place."""
    text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    ends = np.cumsum(sizes)
    long, source = RunIndex.build(text).matching_statistics()
    left = np.repeat(ends, sizes) - np.arange(len(text))  # bytes to the piece's end
    whole = left >= length
    # chains of sources run through places that cross into the next piece,
    # which do not count as occurrences themselves
    link = np.where(long >= length, source, np.arange(len(text)))
    while True:
        further = link[link]
        if np.array_equal(further, link):
            break
        link = further
    earliest = np.full(len(text), len(text))
    # from the last place to the first, which stays
    places = np.flatnonzero(whole)[::-1]
    earliest[link[places]] = places
    later = whole & (earliest[link] < np.arange(len(text)))
    bounds = np.concatenate([[0], ends])
    return [np.flatnonzero(later[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def mark_by_parts(pieces: list[bytes], spots: list[int], length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """:func:`mark` for the distinct pieces of one anchor, which stands at
    ``spots`` in them, of any total size.  Windows are parted by where they
    have the anchor, and by the bytes that all windows of a part have to the
    left or right of it: equal windows stay together, and a part is cut
    further until an index of bounded size holds it."""
    out: list[list[np.ndarray]] = [[np.zeros(0, dtype=np.int64)] for _ in pieces]
    work = [[(i, 0, len(p) - length) for i, p in enumerate(pieces)]]
    while work:
        texts: dict[bytes, tuple[int, int, int]] = {}
        for i, a, b in work.pop():
            text = pieces[i][a:b + length]
            if text in texts:
                out[i].append(np.arange(a, b + 1))
            else:
                texts[text] = (i, a, b)
        if sum(map(len, texts)) <= BATCH_BYTES:
            for (i, a, _), windows in zip(texts.values(), mark(list(texts), length), strict=True):
                out[i].append(a + windows)
            continue
        low = min(spots[i] - b for i, _, b in texts.values())
        high = max(spots[i] - a for i, a, _ in texts.values())
        if low == high:  # single windows, and all of them differ
            continue
        middle = (low + high + 1) // 2
        groups: dict[tuple[int, bytes], list[tuple[int, int, int]]] = {}
        for i, a, b in texts.values():
            at, last = spots[i], spots[i] - middle
            if a <= last:
                groups.setdefault((0, pieces[i][at - middle:at]), []).append((i, a, min(b, last)))
            if b > last:
                right = pieces[i][at + gram:at + length - middle + 1]
                groups.setdefault((1, right), []).append((i, max(a, last + 1), b))
        part, size = [], 0
        for group in groups.values():
            own = sum(b - a + length for _, a, b in group)
            if part and size + own > BATCH_BYTES:
                work.append(sorted(part))
                part, size = [], 0
            part += group
            size += own
        work.append(sorted(part))
    return [np.sort(np.concatenate(o)) for o in out]


def runs(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte ranges that the windows cover, touching ones joined."""
    if not len(windows):
        return []
    cut = np.flatnonzero(np.diff(windows) > length)
    first, last = np.concatenate([[0], cut + 1]), np.append(cut, len(windows) - 1)
    return list(zip(windows[first].tolist(), (windows[last] + length).tolist(), strict=True))


# ------------------------------------------------------------------- spark

_LIGHT = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("rank", T.LongType()),
                       T.StructField("twin", T.LongType()), T.StructField("segment", T.LongType())])
_PIECE = T.StructType([*_LIGHT, T.StructField("piece", T.BinaryType())])
_SPAN = T.StructType([T.StructField("rank", T.LongType()), T.StructField("twin", T.LongType()),
                      T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
#: A segment as one integer: first window, number of windows, anchor's offset.
_FIRST, _COUNT, _SMALL = 14, 7, 127
#: Bits of an anchor's hash that do not travel.  Anchors that then fall
#: together share a shard and nothing else.
_SHORT = 16
_ANCHOR = (1 << 47) - 1
#: What tells the rows of the texts apart, in document order.
_PLACE = ["rank", "twin"]


#: Never null, so that no join adds a filter and both read one shuffle.
_PACKED = T.StructType([T.StructField("rank", T.LongType(), False), T.StructField("twin", T.LongType(), False),
                        T.StructField("packed", T.BinaryType(), False)])


def _pack(batches):
    """Texts compressed for the one shuffle that they take."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    for part in X.slices(batches, 2):
        packed = pa.array([squeeze(t) for t in X.as_bytes(part.column(2))], pa.binary())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), packed], names=_PACKED.names)


def _unpacked(column: pa.Array) -> list[bytes]:
    loosen = zstandard.ZstdDecompressor().decompress
    return [loosen(b) for b in column.to_pylist()]


def _anchors(length: int, gram: int):
    def run(batches):
        for part in X.slices(batches, 2):
            text, first, count, offset, anchor = segments(X.as_bytes(part.column(2)), length, gram)
            text = pa.array(text)
            packed = (first << _FIRST) | (count << _COUNT) | offset
            yield pa.RecordBatch.from_arrays([pa.array(anchor >> _SHORT), part.column(0).take(text), part.column(1).take(text),
                                              pa.array(packed)], names=_LIGHT.names)
    return run


def _hash_at(text: bytes, spots: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the grams at rising positions of one text."""
    buf = np.frombuffer(text, dtype=np.uint8)
    out = np.empty(len(spots), dtype=np.uint64)
    for at in range(0, len(buf), _CHUNK):
        a, b = np.searchsorted(spots, [at, at + _CHUNK])
        if a < b:
            out[a:b] = X.gram_hashes(buf[at:at + _CHUNK + gram - 1], gram)[spots[a:b] - at]
    return out.view(np.int64)


def _pieces(length: int, gram: int):
    """Segments by their anchors.  Rows come in document order, so a segment
    that the task has sent before is a later one, whose bytes all go; of equal
    rows only the first is read, as their segments are one place."""
    def run(batches):
        sent: set[bytes] = set()
        last = None
        for part in X.slices(batches, 2):
            columns: list[list] = [[] for _ in range(5)]
            ranks, twins = part.column(0).to_pylist(), part.column(1).to_pylist()
            wanted = part.column(3)
            for d, text in enumerate(_unpacked(part.column(2))):
                if (ranks[d], twins[d]) == last:
                    continue
                last = ranks[d], twins[d]
                packed = np.sort(wanted[d].values.to_numpy())
                starts, sizes = packed >> _FIRST, (packed >> _COUNT & _SMALL) - 1 + length
                anchors = _hash_at(text, starts + (packed & _SMALL), gram) >> _SHORT
                for start, size, anchor, segment in zip(starts.tolist(), sizes.tolist(), anchors.tolist(), packed.tolist(),
                                                        strict=True):
                    piece = text[start:start + size]
                    digest = hashlib.blake2b(piece, digest_size=16).digest()
                    again = digest in sent
                    if not again:
                        if len(sent) >= MEMORY:
                            sent.clear()
                        sent.add(digest)
                    if again:  # goes whole, wherever it is marked: spread over the shards
                        anchor, piece = (ranks[d] * 0x9E3779B1 ^ twins[d] ^ segment * 0x85EBCA77) & _ANCHOR, None
                    for column, value in zip(columns, (anchor, *last, segment, piece), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.binary()), strict=True)],
                names=_PIECE.names)
    return run


def _lone(batch: pa.RecordBatch) -> np.ndarray:
    """Pieces alone under their anchor, but at the batch's ends, where the
    group may go on.  They lose nothing: equal windows have equal anchors, and
    two windows of one segment have theirs at different offsets."""
    anchor = batch.column(0).to_numpy()
    lone = np.zeros(len(anchor), dtype=bool)
    if len(anchor) > 2:
        fresh = anchor[1:] != anchor[:-1]
        lone[1:-1] = fresh[:-1] & fresh[1:]
    return lone & batch.column(len(batch.columns) - 1).is_valid().to_numpy(zero_copy_only=False)


def _marked(length: int, gram: int):
    """Rows in order of anchor and document to the byte ranges they lose.
    Equal rows that two tasks have sent come one after the other and are one
    place."""
    def spans(rows, large=False):
        seen: set[bytes] = set()
        out, kept = [], []
        last = None
        for row in rows:
            if row == last:
                continue
            last = row
            _, rank, twin, segment, piece = row
            where = rank, twin, segment >> _FIRST
            if piece is None or piece in seen:
                out.append((*where, where[2] + (segment >> _COUNT & _SMALL) - 1 + length))
            else:
                seen.add(piece)
                kept.append((where, piece, segment & _SMALL))
        if len(kept) > 1:
            pieces = [k[1] for k in kept]
            found = mark_by_parts(pieces, [k[2] for k in kept], length, gram) if large else mark(pieces, length)
            for ((rank, twin, start), *_), windows in zip(kept, found, strict=True):
                out += [(rank, twin, start + a, start + b) for a, b in runs(windows, length)]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(4)], names=_SPAN.names)

    def groups(batches):
        rows: list[tuple] = []
        for batch in batches:
            batch = batch.filter(pa.array(~_lone(batch)))
            numbers = (c.to_numpy().tolist() for c in batch.columns[:-1])
            for values in zip(*numbers, batch.column(len(batch.columns) - 1).to_pylist(), strict=True):
                if rows and rows[-1][0] != values[0]:
                    yield rows
                    rows = []
                rows.append(values)
        if rows:
            yield rows

    def run(batches):
        held: list[tuple] = []
        size = 0
        for rows in groups(batches):
            if len(rows) == 1 and rows[0][4] is not None:
                continue
            own = sum(len(r[4] or b"") for r in rows)
            if own > BATCH_BYTES:
                yield spans(rows, large=True)
                continue
            if size + own > BATCH_BYTES:
                yield spans(held)
                held, size = [], 0
            held += rows
            size += own
        if held:
            yield spans(held)
    return run


def removed_spans(base: DataFrame, packed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(rank, twin, spans) of the documents (rank, twin, text) that lose
    bytes; ``packed`` are the same with their texts packed.  Spans are start
    and stop of ranges, which may overlap."""
    light = base.mapInArrow(_anchors(length, gram), _LIGHT)
    # written, so that the join's sides are plain shuffles, which adaptive
    # execution can split where one anchor has very many occurrences
    again = cut_lineage(light.groupBy("anchor").count().where("count > 1").select("anchor"))
    wanted = light.join(again, "anchor").groupBy(*_PLACE).agg(F.collect_set("segment").alias("wanted"))
    pieces = (packed.join(wanted, _PLACE).select(*_PLACE, "packed", "wanted")
              .sortWithinPartitions(*_PLACE).mapInArrow(_pieces(length, gram), _PIECE))
    marked = (pieces.repartition("anchor").sortWithinPartitions("anchor", *_PLACE, "segment")
              .mapInArrow(_marked(length, gram), _SPAN))
    return marked.groupBy(*_PLACE).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


FIELDS = [X.field("n_bytes", "long"), X.field("spans", "binary"), X.field("kept", "binary")]


def _joined(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Per document: n_bytes, spans (start and stop of each maximal removed
    run in bytes, unsigned 64-bit little-endian), kept (the other bytes)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hash_ = F.xxhash64(text)
    rank = F.coalesce(F.col(id_col).cast("long"), hash_.bitwiseAND(F.lit(_NULLS - 1)).bitwiseOR(F.lit(_NULLS)))
    base = docs.select(rank.alias("rank"), hash_.bitwiseAND(F.lit(-2)).alias("hash"),
                       F.isnull(id_col).cast("long").alias("no_id"), text.alias("text"))
    base = _told_apart(base)
    packed = base.mapInArrow(_pack, _PACKED)
    lost = removed_spans(base, packed, length)
    id_type = docs.schema[id_col].dataType
    # both joins read the same three columns, so one shuffle of the texts serves them
    both = packed.join(lost, _PLACE, "left").select(*_PLACE, "packed", "spans").mapInArrow(_cut, _CUT)
    id_ = F.when(F.col("twin").bitwiseAND(F.lit(1)) == 0, F.col("rank")).cast(id_type)
    return both.select(id_.alias(id_col), *(f.name for f in FIELDS))


def _told_apart(base: DataFrame) -> DataFrame:
    """(rank, twin, text): ``twin`` is the text's hash where different texts
    share the rank and else zero, so that it costs a shuffle next to nothing;
    its lowest bit tells a null id.  Such ranks are written first: with none,
    or few, the planner sends them to the tasks and no text moves."""
    shared = cut_lineage(base.select("rank", "hash").distinct().groupBy("rank").count().where("count > 1")
                         .select("rank", F.lit(True).alias("shared")))
    hash_ = F.when(F.col("shared"), F.col("hash")).otherwise(F.lit(0))
    return base.join(shared, "rank", "left").select("rank", hash_.bitwiseOR(F.col("no_id")).alias("twin"), "text")


_CUT = T.StructType([T.StructField("rank", T.LongType()), T.StructField("twin", T.LongType()), *FIELDS])


def _cut(batches):
    for part in X.slices(batches, 2):
        sizes, cuts, kept = [], [], []
        for text, spans in zip(_unpacked(part.column(2)), part.column(3).to_pylist(), strict=True):
            joined = _joined(spans)
            edges = [0, *(x for s in joined for x in s), len(text)]
            sizes.append(len(text))
            cuts.append(np.array(joined, dtype="<u8").tobytes())
            kept.append(b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(cuts, pa.binary()), pa.array(kept, pa.binary())],
            names=_CUT.names)
