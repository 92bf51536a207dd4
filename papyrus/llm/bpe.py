"""Byte-level BPE encoding and decoding in padded numpy matrices.

A text is split by the vocabulary's pattern; each distinct piece is encoded
once for many texts.  Pieces of similar length form the rows of a padded matrix of
token ids.  Every round looks up the ranks of neighbouring pairs in a hashed
table, merges the leftmost pair of minimum rank in every row, and compacts
the matrix; rows without a pair leave it.  A piece that is itself in the
vocabulary is one token.

Pieces over ``LONG`` bytes are rows of their own, where a round may merge all
occurrences of the minimum pair at once, up to the first one that brings a
pair which ranks before it, so that the result is that of single merges.

Defined results: a null or empty text has no ids; null and repeated document
ids pass through row by row; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import regex
from pyspark.sql import DataFrame

from papyrus.llm import texts as X

BUCKETS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256)
LONG = BUCKETS[-1]
CELLS = 1 << 20
PIECES = 1 << 18
#: Distinct chunks, and their characters, that a worker remembers before it
#: starts anew.
MEMORY, LETTERS = 3 << 17, 1 << 24
#: A space inside a piece: white space before it, white space or the end after.
CROSSED = regex.compile(r" (?:(?=\s)|\Z)(?<=\s )")
#: Marks a chunk that no space precedes; other chunks do not start with it.
BARE = " "
NONE = np.int32(np.iinfo(np.int32).max)
_MUL = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open-addressing hash table from (left id, right id) to the merged id."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(2 * len(left)).bit_length())
        self.key = np.full(1 << self.bits, -1, dtype=np.int64)
        self.value = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        while len(keys):
            free = self.key[slot] == -1
            self.key[slot[free]] = keys[free]
            put = self.key[slot] == keys
            self.value[slot[put]] = merged[put]
            keys, merged, slot = keys[~put], merged[~put], (slot[~put] + 1) & (len(self.key) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, ``NONE`` where there is none."""
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(keys.shape, NONE, dtype=np.int32)
        at = np.flatnonzero((left >= 0) & (right >= 0))
        flat, wanted = out.reshape(-1), keys.reshape(-1)[at]
        slot = self._slot(wanted)
        while len(at):
            seen = self.key[slot]
            hit = seen == wanted
            flat[at[hit]] = self.value[slot[hit]]
            go = ~hit & (seen != -1)
            at, wanted, slot = at[go], wanted[go], (slot[go] + 1) & (len(self.key) - 1)
        return out


class Pieces:
    """The ids of chunks, piece by piece; every piece is encoded once."""

    pattern: regex.Pattern

    def __init__(self) -> None:
        self.seen: dict[str, list[int]] = {}

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        raise TypeError("a vocabulary encodes its pieces")

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        if len(self.seen) > MEMORY:
            self.seen = {}
        seen, split = self.seen, list(map(self.pattern.findall, chunks))
        new = list({p for pieces in split for p in pieces if p not in seen})
        seen.update(zip(new, (ids.tolist() for ids in self.encode_pieces(new)), strict=True))
        return [seen[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in seen[p]] for pieces in split]


class Vocabulary(Pieces):
    """Ids are ranks; ``tokens[id]`` are the bytes of a token."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = (np.array(x, dtype=np.int32) for x in (left, right, merged))
        self.pairs = PairTable(left, right, merged)

    def encode_pieces(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [t.encode() for t in texts]
        out: list[np.ndarray] = [None] * len(pieces)  # type: ignore[list-item]
        buckets: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = np.array([rank], dtype=np.int32)
            elif len(piece) > LONG:
                out[i] = self._long(piece)
            else:
                buckets.setdefault(next(b for b in BUCKETS if b >= len(piece)), []).append(i)
        for width, rows in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                self._matrix(pieces, rows[at:at + step], width, out)
        return out

    def _matrix(self, pieces, rows, width, out) -> None:
        raw = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in rows), dtype=np.uint8)
        length = np.array([len(pieces[i]) for i in rows])
        ids = self.byte[raw].reshape(len(rows), width)
        ids[np.arange(width) >= length[:, None]] = -1
        row = np.array(rows)
        rank = self.pairs.find(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), dtype=np.int64)
            low = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            done = low == NONE
            for r, tokens in zip(row[done].tolist(), ids[done], strict=True):
                out[r] = tokens[tokens >= 0]
            go = ~done
            row, ids, rank, at, low = row[go], ids[go], rank[go], at[go], low[go]
            if not len(row):
                return
            n, w = ids.shape
            line = np.arange(n)
            ids[line, at] = low
            keep = np.ones((n, w), dtype=bool)
            keep[line, at + 1] = False
            ids = ids[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), dtype=bool)
            keep[line, at] = False
            rank = rank[keep].reshape(n, w - 2)
            before = np.flatnonzero(at > 0)
            rank[before, at[before] - 1] = self.pairs.find(ids[before, at[before] - 1], ids[before, at[before]])
            after = np.flatnonzero(at < w - 2)
            rank[after, at[after]] = self.pairs.find(ids[after, at[after]], ids[after, at[after] + 1])

    def _long(self, piece: bytes) -> np.ndarray:
        ids = self.byte[np.frombuffer(piece, dtype=np.uint8)]
        while True:
            rank = self.pairs.find(ids[:-1], ids[1:])
            low = rank.min(initial=NONE)
            if low == NONE:
                return ids
            at = np.flatnonzero(rank == low)
            # of runs of overlapping pairs every other one, from the left
            run = np.cumsum(np.diff(at, prepend=-2) != 1)
            start = np.flatnonzero(np.diff(run, prepend=0))
            at = at[(np.arange(len(at)) - start[run - 1]) % 2 == 0]
            # up to the first merge that brings a pair which ranks before it
            edged = np.concatenate([[-1], ids, [-1]])
            token = np.full(len(at), low)
            twin = np.flatnonzero(np.diff(at, prepend=-2) == 2)
            before, after = edged[at], edged[at + 3]
            lower = (self.pairs.find(before, token) < low) | (self.pairs.find(token, after) < low)
            if len(twin) and self.pairs.find(token[:1], token[:1])[0] < low:
                lower[twin] = True
            if lower.any():
                at = at[:int(lower.argmax()) + 1]
            ids = ids.copy()
            ids[at] = low
            ids = np.delete(ids, at + 1)


class Numbers(dict):
    """Numbers things in the order in which they are first looked up."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class Encoder:
    """Encodes texts, remembering the ids of chunks seen before.

    A chunk is what stands between two spaces, with the space before it.  A
    piece of the pattern crosses the start of a chunk only in a run of white
    space of any kind; texts with ``CROSSED`` spaces are split by the pattern
    itself.  ``vocab`` has the ``pattern`` and ``encode_chunks``."""

    def __init__(self, vocab, memory: int = MEMORY):
        self.vocab, self.memory = vocab, memory
        self.letters = 0
        self.known = Numbers()
        self.flat = np.zeros(0, dtype=np.int32)
        self.count = np.zeros(0, dtype=np.int64)
        self.at = np.zeros(0, dtype=np.int64)
        self.used = np.zeros(0, dtype=np.int64)

    def _forget(self) -> None:
        """Keep the chunks that came more than once, half of the memory at
        most, the most frequent first."""
        chunks = list(self.known)
        kept = np.argsort(-self.used, kind="stable")[:self.memory // 2]
        size = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        kept = np.sort(kept[(self.used[kept] > 1) & (np.cumsum(size[kept]) <= LETTERS // 2)])
        self.letters = int(size[kept].sum())
        self.known = Numbers((chunks[i], k) for k, i in enumerate(kept.tolist()))
        self.flat = self._gather(kept)
        self.count = self.count[kept]
        self.at = np.cumsum(self.count) - self.count
        self.used = self.used[kept] // 2

    def _gather(self, which: np.ndarray) -> np.ndarray:
        """The ids of chunks, joined."""
        n = self.count[which]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.at[which] - (ends - n), n) + np.arange(n.sum())]

    def _chunks(self, text: str) -> Iterator[list[str]]:
        """The chunks of a text, each without the space before it; one that
        has none starts with a mark."""
        if CROSSED.search(text):
            found = (m.group() for m in self.vocab.pattern.finditer(text))
            while pieces := list(islice(found, PIECES)):
                yield [p[1:] if p[0] == " " and p[1:2] != " " else BARE + p for p in pieces]
            return
        at = 0
        while at <= len(text):
            # a long text in parts that end before a space
            to = text.find(" ", at + X.SLICE_BYTES)
            part = text[at:] if to < 0 else text[at:to]
            parts = part.split(" ")
            if not at:
                parts[0] = BARE + parts[0]
            yield parts
            if to < 0:
                return
            at = to + 1

    def _blocks(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """(chunks per text, chunks) in blocks of bounded size: all short
        texts at once, long ones in parts."""
        counts, block = [0] * len(texts), []
        for d, text in enumerate(texts):
            for part in self._chunks(text):
                if counts[d]:
                    yield counts, block
                    counts, block = [0] * len(texts), []
                counts[d] = len(part)
                block += part
        yield counts, block

    def _ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, joined, and how many each has."""
        ids = self.vocab.encode_chunks([c[1:] if c[:1] == BARE else " " + c for c in new])
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(count.sum())), count

    def _learn(self, new: list[str]) -> None:
        new_flat, count = self._ids(new)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.used = np.concatenate([self.used, np.zeros(len(new), dtype=np.int64)])
        self.flat = np.concatenate([self.flat, new_flat])
        self.letters += sum(map(len, new))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for counts, chunks in self._blocks(texts):
            if len(self.known) > self.memory or self.letters > LETTERS:
                self._forget()
            which = np.fromiter(map(self.known.__getitem__, chunks), dtype=np.int64, count=len(chunks))
            if len(self.known) > len(self.count):
                self._learn(list(islice(reversed(self.known), len(self.known) - len(self.count)))[::-1])
            self.used += np.bincount(which, minlength=len(self.used))
            ids = self._gather(which)
            cuts = np.concatenate([[0], np.cumsum(self.count[which])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
            for d, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if counts[d]:
                    parts[d].append(ids[a:b])
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, dtype=np.int32) for p in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process."""
    return Encoder(Vocabulary(path, pattern))


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ids (unsigned 32-bit little-endian integers, joined) and
    decoded (the bytes that these ids stand for).  ``path`` names the rank
    file, which is installed on all executors."""
    def work(texts: list[bytes]) -> list:
        bpe = encoder(path, pattern)
        ids = bpe.encode([t.decode("utf-8", "replace") for t in texts])
        return [[i.astype("<u4").tobytes() for i in ids], [bpe.decode(i) for i in ids]]

    return X.per_text(docs, id_col, text_col, [X.field("ids", "binary"), X.field("decoded", "binary")], work)
