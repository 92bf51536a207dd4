"""Token-id output with Re-Pair grammar compression.

Documents are encoded by the tokenizers library and written in ascending id
order (nulls last), cut into shards of about ``SHARD_IDS`` ids.  Inside a
shard, rounds of Re-Pair replace frequent pairs of neighbouring symbols by
nonterminals; a shard stores its rules, the length each of them expands to,
the remaining symbols and the end of every document, so that any range of ids
is decoded from the symbols that cover it.

The file format is Parquet with one row per shard (Spark's readers and
writers reach any store): ``part`` and ``nth`` order the shards, ``start`` is
the number of ids before the shard in its part, ``ids`` the document ids,
``ends`` the document ends inside the shard, ``rules`` pairs of symbols,
``lengths`` their expansions, ``symbols`` three byte planes.

Defined results: a null or empty text is the end id alone; rows that repeat a
document id stand together, ordered by the hash of their text; an empty table
writes no shard; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import compress as compress_list
from operator import ne, not_

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrus.llm import texts as X
from papyrus.llm.bpe import MEMORY, Encoder

SHARD_IDS = 1 << 20
END = 0
#: First nonterminal; ids are below it.
BASE = 1 << 17
#: A pair becomes a rule from this count on.
FREQUENT = 16
#: Rules of one round, and the share of symbols below which rounds stop.
ROUND_RULES = 1 << 13
LEAST_GAIN = 0.03
#: Chunks that go through one call of the library.
CALL = 1 << 10
#: How a byte-level vocabulary spells a space.
SPACE = "\u0120"
_SLOTS = 20
_MUL = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- grammar

def _frequent(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair keys by falling count, rank of the pair at each position or a
    number past the last)."""
    key = (left.astype(np.int64) << 32) | right
    slot = ((key.view(np.uint64) * _MUL) >> np.uint64(64 - _SLOTS)).astype(np.int64)
    busy = np.flatnonzero(np.bincount(slot, minlength=1 << _SLOTS)[slot] >= FREQUENT)
    coded = pa.array(key[busy]).dictionary_encode()
    pairs, which = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    count = np.bincount(which, minlength=len(pairs))
    best = np.flatnonzero(count >= FREQUENT)
    best = best[np.lexsort((pairs[best], -count[best]))][:ROUND_RULES]
    rank_of = np.full(len(pairs) + 1, len(best))
    rank_of[best] = np.arange(len(best))
    rank = np.full(len(key), len(best))
    rank[busy] = rank_of[which]
    return pairs[best], rank


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): rules[k] are the two symbols of nonterminal BASE + k."""
    symbols, rules = ids.astype(np.int64), [np.zeros((0, 2), dtype=np.int64)]
    known = 0
    while len(symbols) > 1:
        pairs, rank = _frequent(symbols[:-1], symbols[1:])
        if not len(pairs):
            break
        # where pairs overlap the more frequent one goes first; in a run of
        # one symbol every other pair does
        padded = np.concatenate([[len(pairs)], rank, [len(pairs)]])
        run = np.flatnonzero(np.diff(rank, prepend=-1))
        odd = (np.arange(len(rank)) - np.repeat(run, np.diff(np.append(run, len(rank))))) % 2 == 1
        take = (rank < len(pairs)) & (rank <= padded[:-2]) & (rank <= padded[2:]) & ~odd
        at = np.flatnonzero(take)
        at = at[np.diff(at, prepend=-2) > 1]
        used, which = np.unique(rank[at], return_inverse=True)
        rules.append(np.stack([pairs[used] >> 32, pairs[used] & 0xFFFFFFFF], axis=1))
        before = len(symbols)
        symbols[at] = BASE + known + which
        known += len(used)
        keep = np.ones(before, dtype=bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        if before - len(symbols) < LEAST_GAIN * before:
            break
    return symbols, np.concatenate(rules)


def expansions(rules: np.ndarray) -> np.ndarray:
    """Ids that each nonterminal stands for; a rule only uses earlier ones."""
    length = np.zeros(len(rules), dtype=np.int64)
    parts = rules - BASE
    todo = np.arange(len(rules))
    while len(todo):
        size = np.where(parts[todo] < 0, 1, length[np.maximum(parts[todo], 0)])
        ready = (size > 0).all(axis=1)
        length[todo[ready]] = size[ready].sum(axis=1)
        todo = todo[~ready]
    return length


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    while True:
        inner = symbols >= BASE
        if not inner.any():
            return symbols
        size = 1 + inner
        at = np.cumsum(size) - size
        out = np.empty(int(size.sum()), dtype=np.int64)
        out[at] = symbols
        spot, rule = at[inner], rules[symbols[inner] - BASE]
        out[spot], out[spot + 1] = rule[:, 0], rule[:, 1]
        symbols = out


def decode_range(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Ids start:stop of a shard, from the symbols that cover them."""
    size = np.ones(len(symbols), dtype=np.int64)
    inner = symbols >= BASE
    size[inner] = lengths[symbols[inner] - BASE]
    ends = np.cumsum(size)
    first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left")
    base = int(ends[first - 1]) if first else 0
    return expand(symbols[first:last + 1], rules)[start - base:stop - base]


def pack(symbols: np.ndarray) -> bytes:
    """Three byte planes, low first."""
    return symbols.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes()


def unpack(planes: bytes) -> np.ndarray:
    bytes_ = np.frombuffer(planes, dtype=np.uint8).reshape(3, -1).astype(np.int64)
    return bytes_[0] | (bytes_[1] << 8) | (bytes_[2] << 16)


# ----------------------------------------------------------------- encoder

class Library:
    """The tokenizers library behind the cache of :class:`Encoder`."""

    def __init__(self, path: str, pattern: str):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(pattern)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.stop = next(((t.content, i) for i, t in added.items() if not (t.lstrip or t.rstrip or t.single_word)), None)
        vocab = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocab.values(), default=-1) + 1, dtype=bool)
        self.spaced[[i for t, i in vocab.items() if t.startswith(SPACE)]] = True

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(f.ids, dtype=np.int32) for f in found]

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Many chunks go through one call, with a special token between
        them, where the library splits before anything else."""
        if self.stop is None:
            return [ids.tolist() for ids in self.whole(chunks)]
        mark, number = self.stop
        out: list[list[int]] = []
        for k in range(0, len(chunks), CALL):
            ids = self.whole([mark.join([*chunks[k:k + CALL], ""])])[0]
            ends = np.flatnonzero(ids == number).tolist()
            every = ids.tolist()
            out += [every[a + 1:b] for a, b in zip([-1, *ends[:-1]], ends, strict=True)]
        return out


    def encode_spaced(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """``(ids, ids per chunk)`` of chunks that begin with their only space
        and have no white space after it or at their end: as one text, where
        each space begins a piece and so a token, and no other token begins
        with one.  None where the tokenizer marks spaces in another way."""
        flat, counts = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for k in range(0, len(chunks), CALL):
            part = chunks[k:k + CALL]
            ids = self.whole(["".join(part)])[0]
            starts = np.flatnonzero(self.spaced[ids])
            if len(starts) != len(part) or starts[0]:
                return None
            flat.append(ids)
            counts.append(np.diff(starts, append=len(ids)))
        return np.concatenate(flat), np.concatenate(counts)


class LibraryEncoder(Encoder):
    """Ids as the library gives them for the whole text: a text that spells
    out a special token goes to the library uncut."""

    def _ids(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Most chunks go to the library side by side; those with white space
        at an end, where two could run into one piece, are kept apart."""
        apart = np.fromiter(map(ne, new, map(str.strip, new)), dtype=bool, count=len(new))
        apart |= np.fromiter(map(not_, new), dtype=bool, count=len(new))
        found = self.vocab.encode_spaced([" " + c for c in compress_list(new, ~apart)])
        if found is None:
            return super()._ids(new)
        rest, rest_count = super()._ids(list(compress_list(new, apart)))
        # the two results, laid in the order of ``new``
        count = np.empty(len(new), dtype=np.int64)
        count[~apart], count[apart] = found[1], rest_count
        flat = np.empty(int(count.sum()), dtype=np.int32)
        mine = np.repeat(apart, count)
        flat[~mine], flat[mine] = found[0], rest
        return flat, count

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = ["" if any(s in t for s in self.vocab.special) else t for t in texts]
        ids = super().encode(plain)
        for d, (text, cut) in enumerate(zip(texts, plain, strict=True)):
            if text is not cut:
                ids[d] = self.vocab.whole([text])[0]
        return ids


@lru_cache(maxsize=1)
def encoder(path: str, pattern: str) -> LibraryEncoder:
    return LibraryEncoder(Library(path, pattern), 2 * MEMORY)


# ------------------------------------------------------------------- files

def _shard_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("nth", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("ids", T.ArrayType(kind)),
        T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("rules", T.BinaryType()),
        T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("symbols", T.BinaryType())])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, pattern: str, id_col: str = "doc_id",
                 text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode and write all documents, in ascending id order."""
    id_type = docs.schema[id_col].dataType
    schema = _shard_schema(id_type)
    first = F.col("id").asc_nulls_last()
    rows = (docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
            .repartitionByRange(first).sortWithinPartitions(first, F.xxhash64("text"), "text"))

    def run(batches):
        part, nth, start = TaskContext.get().partitionId(), 0, 0
        names: list[pa.Array] = []
        runs: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            ids = np.concatenate(runs)
            symbols, rules = compress(ids)
            ends = np.cumsum([len(r) for r in runs])
            values = (part, nth, start, pa.concat_arrays(names), ends, rules.astype("<i4").tobytes(),
                      expansions(rules), pack(symbols))
            kinds = (pa.int32(), pa.int32(), pa.int64(), None, pa.list_(pa.int64()), pa.binary(),
                     pa.list_(pa.int64()), pa.binary())
            columns = [pa.ListArray.from_arrays([0, len(v)], v) if k is None else pa.array([v], k)
                       for v, k in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for piece in X.slices(batches, 1):
            texts = [t.decode("utf-8", "replace") for t in X.as_bytes(piece.column(1))]
            for d, ids in enumerate(encoder(tokenizer, pattern).encode(texts)):
                names.append(piece.column(0).slice(d, 1))
                runs.append(np.append(ids, END))
                size += len(runs[-1])
                if size >= shard_ids:
                    yield shard()
                    nth, start, size = nth + 1, start + size, 0
                    names.clear()
                    runs.clear()
        if runs:
            yield shard()

    rows.mapInArrow(run, schema).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: its id, start, n_tokens, ids (unsigned
    32-bit little-endian integers, joined)."""
    shards = spark.read.parquet(path)
    kind = shards.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField(id_col, kind),
                           T.StructField("inside", T.LongType()), T.StructField("n_tokens", T.LongType()),
                           T.StructField("tokens", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in ("part", "start", "ends", "rules", "symbols")}
                rules = np.frombuffer(row["rules"].as_py(), dtype="<i4").reshape(-1, 2).astype(np.int64)
                tokens = expand(unpack(row["symbols"].as_py()), rules).astype("<u4")
                ends = np.array(row["ends"].as_py(), dtype=np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"].as_py()] * n, pa.int32()), batch.column("ids")[k].values,
                     pa.array(row["start"].as_py() + starts), pa.array(ends - starts),
                     pa.array([tokens[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())],
                    names=schema.names)

    found = shards.select("part", "start", "ids", "ends", "rules", "symbols").mapInArrow(run, schema)
    # one row per written part, so it is as small as the number of tasks: what comes before it
    totals = shards.groupBy("part").agg(F.max(F.col("start") + F.element_at("ends", -1)).alias("size"))
    before = totals.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return found.join(F.broadcast(before), "part").select(
        id_col, (F.col("inside") + F.col("before")).alias("start"), "n_tokens", "tokens")


def crc(tokens: DataFrame) -> DataFrame:
    """With ids_crc32, the unsigned CRC-32 of the tokens' bytes."""
    return tokens.withColumn("ids_crc32", F.crc32("tokens"))


__all__ = ["compress", "crc", "decode_range", "expand", "expansions", "pack", "read_tokens",
           "unpack", "write_tokens"]
