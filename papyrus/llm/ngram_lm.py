"""Language-model scoring with an interpolated modified Kneser-Ney model.

Words (A-Z lower-cased) are 64-bit hashes.  Spark counts words and word pairs
of the training documents; counts are gathered inside tasks first and sent in
blocks per bucket.  The model is a folder of sorted hash arrays: one file of
(pair hash, count) per bucket, and files of (word, statistics).  Workers map
the files into memory and search them; nothing of the corpus passes the
driver but single figures and the words that alone make up over ``1 / HOT`` of
the training tokens (fewer than ``HOT``), whose pairs are spread over all
buckets.

The order is two (pairs): with the disk that a run may use, triples of an open
vocabulary do not fit (see the README).  Probability of word w after u::

    p(w | u) = max(c(uw) - D, 0) / c(u) + g(u) * q(w)
    q(w)     = max(t(w) - D', 0) / t + g' / (V + 1)

c counts pairs, t(w) the distinct words before w, t all distinct pairs, D and
D' are the three modified discounts by count, g and g' the mass they free.

The folder must be one that the workers mount: ``spark.checkpoint.dir`` on a
shared file system.

Defined results: a null or empty text is one token, the end; a document whose
id is null is never held out; with nothing to train on, every probability is
1 / (V + 1) with V = 0; repeated rows are scored alike; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrus.llm import texts as X
from papyrus.session import cut_lineage, scratch_path

FOLDS, HELD_OUT = 7, 2
END, START = 1 << 16, 2 << 16
HOT = 1024
#: Training tokens (words) per file of pairs (words).
BUCKET_TOKENS, BUCKET_WORDS = 1 << 21, 1 << 18
#: Tokens that a task gathers before it sends their pairs.
GATHER = 2 << 20
SLICE = 4 << 20
_MUL = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.frombuffer(X.LOWER_AZ, dtype=np.uint8)


class Tokens:
    """Words and ends of a slice of texts: ``word`` (64-bit hashes), ``after``
    and ``before`` (short forms of each word and of the one before it) and
    ``first`` (tokens ``first[d]:first[d + 1]`` are of row d)."""

    def __init__(self, texts: list[bytes]):
        w = X.Words(texts)
        n = np.diff(w.first)
        self.word = np.full(len(w.starts) + len(texts), END, dtype=np.uint64)
        self.word[np.arange(len(w.starts)) + w.doc] = X.range_hashes(_LOWER[w.buf], w.starts, w.ends)
        self.first = np.concatenate([[0], np.cumsum(n + 1)])
        before = np.roll(self.word, 1)
        before[self.first[:-1]] = START
        #: short forms: the high 48 bits
        self.after = self.word >> np.uint64(16)
        self.before = before >> np.uint64(16)


def pair_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return X.mix(before * _MUL + after)


def bucket_of(before: np.ndarray, pair: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """By the first word, or by the pair where that word is hot."""
    spread = np.where(np.isin(before, hot), pair, X.mix(before))
    return (spread % np.uint64(buckets)).astype(np.int64)


def _squeeze(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _pack(before: np.ndarray, after: np.ndarray, count: np.ndarray) -> bytes:
    """Pairs sorted by their first word: its steps, the second word's six
    bytes and the count, column by column."""
    step = np.diff(before, prepend=np.uint64(0))
    planes = after.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return len(before).to_bytes(8, "little") + _squeeze(
        step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T, planes, count.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:]), dtype=np.uint8)
    wide = np.zeros((2, n, 8), dtype=np.uint8)
    wide[0, :, :6] = raw[:6 * n].reshape(6, n).T
    wide[1, :, :6] = raw[6 * n:12 * n].reshape(n, 6)
    words = wide.view("<u8")[..., 0]
    count = np.ascontiguousarray(raw[12 * n:].reshape(4, n).T).view("<u4")[:, 0]
    return np.cumsum(words[0], dtype=np.uint64), words[1].astype(np.uint64), count.astype(np.int64)


def _merged(before: np.ndarray, after: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """Equal pairs added up, sorted by first word, then second."""
    order = np.lexsort((after, before))
    before, after, count = before[order], after[order], count[order]
    new = np.flatnonzero((np.diff(before, prepend=np.uint64(0)) != 0) | (np.diff(after, prepend=np.uint64(0)) != 0)
                         | (np.arange(len(before)) == 0))
    return before[new], after[new], np.add.reduceat(count, new) if len(new) else count


# ---------------------------------------------------------------- counting

def _gathered(batches, text: int):
    """Tokens of about ``GATHER`` at a time: (words, first words, second words)."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for part in X.slices(batches, text):
        t = Tokens(X.as_bytes(part.column(text)))
        held.append((t.word, t.before, t.after))
        size += len(t.word)
        if size >= GATHER:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held, size = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def count_words(train: DataFrame) -> DataFrame:
    """(word, n) over the training texts (one column)."""
    def run(batches):
        for word, _, _ in _gathered(batches, 0):
            found, n = np.unique(word, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["word", "n"])

    return train.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _local(folder: str) -> str:
    """The path by which workers reach a folder of the shared file system."""
    scheme, _, rest = folder.partition(":")
    if rest and scheme != "file" and "/" not in scheme:
        raise ValueError(f"language models need a shared folder that workers can map into memory, not {folder}")
    return "/" + rest.lstrip("/") if scheme == "file" and rest else folder


def _save(folder: str, name: str, **columns: np.ndarray) -> None:
    """Write columns as files; a repeated attempt replaces them by the same."""
    for column, values in columns.items():
        path = os.path.join(folder, f"{name}.{column}.npy")
        part = f"{path}.{uuid.uuid4().hex}.tmp"
        with open(part, "wb") as f:
            np.save(f, np.ascontiguousarray(values))
        os.replace(part, path)


def _buckets(batches, read):
    """(bucket, rows) of batches sorted by bucket in column 0."""
    now, rows = None, []
    for batch in batches:
        for bucket, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and bucket != now:
                yield now, rows
                rows = []
            now = bucket
            rows.append(read(values))
    if rows:
        yield now, rows


def count_pairs(train: DataFrame, folder: str, buckets: int, hot: list[int]) -> DataFrame:
    """Write the files of pairs; return (word, total, one, two, more, kinds):
    of a first word its pairs' count and how many occur once, twice or more
    often, of a second word its distinct first words.  Rows -1 to -4 hold in
    ``kinds`` how many pairs occur so often."""
    rare = np.array(sorted(hot), dtype=np.uint64)

    def send(batches):
        for _, before, after in _gathered(batches, 0):
            before, after, n = _merged(before, after, np.ones(len(before), dtype=np.int64))
            bucket = bucket_of(before, pair_hash(before, after), rare, buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets <= len(order) else None
            filled = np.unique(bucket)
            for b in filled.tolist():
                rows = order[cut[b]:cut[b + 1]] if cut is not None else np.flatnonzero(bucket == b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int64()), pa.array([_pack(before[rows], after[rows], n[rows])], pa.binary())],
                    names=["bucket", "pairs"])

    def store(batches):
        for bucket, blobs in _buckets(batches, lambda v: _unpack(v[0])):
            before, after, n = _merged(*(np.concatenate(c) for c in zip(*blobs, strict=True)))
            key = pair_hash(before, after)
            order = np.argsort(key)
            _save(folder, f"pairs-{bucket}", key=key[order], count=n[order].astype(np.uint32))
            first = np.flatnonzero(np.concatenate([[True], np.diff(before) != 0]))
            add = lambda x: np.add.reduceat(x.astype(np.int64), first)
            none = np.zeros
            yield _statistics(before[first], add(n), add(n == 1), add(n == 2), add(n > 2), none(len(first), np.int64))
            word, kinds = np.unique(after, return_counts=True)
            zero = none(len(word), np.int64)
            yield _statistics(word, zero, zero, zero, zero, kinds)
            often = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
            zero = none(4, np.int64)
            yield _statistics(np.arange(-1, -5, -1), zero, zero, zero, zero, often)

    sent = train.mapInArrow(send, "bucket long, pairs binary")
    kept = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(store, _STATISTICS)
    return kept.groupBy("word").agg(*(F.sum(c).alias(c) for c in _FIGURES))


_FIGURES = ("total", "one", "two", "more", "kinds")
_STATISTICS = ", ".join(f"{c} long" for c in ("word", *_FIGURES))


def _statistics(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["word", *_FIGURES])


def discounts(often: list[int]) -> list[float]:
    """The modified discounts of counts 1, 2 and 3 or more, from how many
    items occur one to four times; where these are too few for the formula,
    half of the count (at most 1.5) is freed."""
    out = []
    one, two = often[0], often[1]
    y = one / (one + 2 * two) if one and two else 0.0
    for k in (1, 2, 3):
        d = k - (k + 1) * y * often[k] / often[k - 1] if y and often[k - 1] else k / 2
        out.append(d if 0 < d <= k else k / 2)
    return out


def _write_words(rows: DataFrame, folder: str, name: str, buckets: int, kinds: dict[str, type]) -> None:
    """Files of (word, figures) by the word's bucket, sorted."""
    def store(batches):
        for bucket, found in _buckets(batches, tuple):
            columns = [np.array(c) for c in zip(*found, strict=True)]
            word = columns[0].astype(np.int64).view(np.uint64)
            order = np.argsort(word)
            _save(folder, f"{name}-{bucket}", word=word[order],
                  **{k: c[order].astype(t) for (k, t), c in zip(kinds.items(), columns[1:], strict=True)})
            yield pa.RecordBatch.from_arrays([pa.array([len(order)], pa.int64())], names=["n"])

    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets))
    rows = rows.select(bucket.alias("bucket"), "word", *kinds)
    rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(store, "n long").agg(F.sum("n")).collect()


def held_out(id_col: str) -> Column:
    """True for the documents that the model does not learn from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Learn from the documents that are not held out; the model's folder."""
    spark = docs.sparkSession
    folder = _local(scratch_path(spark, "lm"))
    os.makedirs(folder)
    train = docs.where(~held_out(id_col)).select(F.col(text_col).cast("string"))

    words = cut_lineage(count_words(train))
    tokens, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    hot = [r["word"] for r in words.where(F.col("n") * HOT > tokens).select("word").collect()]
    hot = [(w % (1 << 64)) >> 16 for w in hot] + [START >> 16]
    pair_buckets, word_buckets = 1 + tokens // BUCKET_TOKENS, 1 + distinct // BUCKET_WORDS
    _write_words(words, folder, "counts", word_buckets, {"n": np.int64})

    found = cut_lineage(count_pairs(train, folder, pair_buckets, hot))
    often = {-r["word"]: r["kinds"] for r in found.where("word < 0").collect()}
    lower = found.where("word >= 0")
    spread = lower.agg(*(F.coalesce(F.sum((F.col("kinds") == k).cast("long")), F.lit(0)).alias(f"k{k}") for k in (1, 2, 3, 4)),
                       F.coalesce(F.sum((F.col("kinds") > 2).cast("long")), F.lit(0)).alias("more"),
                       F.coalesce(F.sum("kinds"), F.lit(0)).alias("all")).first()
    pair = discounts([often.get(k, 0) for k in (1, 2, 3, 4)])
    word = discounts([spread[f"k{k}"] for k in (1, 2, 3, 4)])
    every = max(spread["all"], 1)
    free = (word[0] * spread["k1"] + word[1] * spread["k2"] + word[2] * spread["more"]) / every if spread["all"] else 1.0
    floor = free / (distinct + 1)
    cut = (F.when(F.col("kinds") == 0, 0.0).when(F.col("kinds") == 1, word[0]).when(F.col("kinds") == 2, word[1])
           .otherwise(word[2]))
    weight = (F.col("one") * pair[0] + F.col("two") * pair[1] + F.col("more") * pair[2]) / F.col("total")
    figures = lower.select("word", "total", F.when(F.col("total") > 0, weight).otherwise(1.0).alias("free"),
                           ((F.col("kinds") - cut) / every + floor).alias("chance"))
    _write_words(figures, folder, "words", word_buckets,
                 {"total": np.float64, "free": np.float64, "chance": np.float64})
    with open(os.path.join(folder, "model.json"), "w") as f:
        json.dump({"tokens": tokens, "distinct": distinct, "hot": hot, "pair_buckets": pair_buckets,
                   "word_buckets": word_buckets, "discounts": pair, "floor": floor}, f)
    return folder


# ----------------------------------------------------------------- scoring

class Files:
    """Sorted arrays of one name, mapped into memory bucket by bucket; the
    ``OPEN`` buckets opened last stay mapped, so that descriptors do not grow
    with the model."""

    OPEN = 24

    def __init__(self, folder: str, name: str, key: str, columns: tuple[str, ...]):
        self.folder, self.name, self.key, self.columns = folder, name, key, columns
        self.maps: dict[int, list[np.ndarray]] = {}

    def _open(self, bucket: int) -> list[np.ndarray]:
        if bucket not in self.maps:
            while len(self.maps) >= self.OPEN:
                del self.maps[next(iter(self.maps))]
            paths = [os.path.join(self.folder, f"{self.name}-{bucket}.{c}.npy") for c in (self.key, *self.columns)]
            self.maps[bucket] = [np.load(p, mmap_mode="r") for p in paths] if os.path.exists(paths[0]) else []
        return self.maps[bucket]

    def find(self, bucket: np.ndarray, key: np.ndarray, missing: tuple[float, ...]) -> list[np.ndarray]:
        """The columns' values of each key (in rising order inside a bucket)."""
        out = [np.full(len(key), m, dtype=np.float64) for m in missing]
        order = np.argsort(bucket, kind="stable")
        sorted_ = bucket[order]
        cuts = np.flatnonzero(np.diff(sorted_, prepend=-1))
        for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(order)).tolist(), strict=True):
            held = self._open(int(sorted_[a]))
            if not held or not len(held[0]):
                continue
            rows = order[a:b]
            at = np.minimum(np.searchsorted(held[0], key[rows]), len(held[0]) - 1)
            hit = held[0][at] == key[rows]
            for values, column in zip(out, held[1:], strict=True):
                values[rows[hit]] = column[at[hit]]
        return out


class Model:
    def __init__(self, folder: str):
        with open(os.path.join(folder, "model.json")) as f:
            about = json.load(f)
        self.tokens, self.distinct = about["tokens"], about["distinct"]
        self.hot = np.array(sorted(about["hot"]), dtype=np.uint64)
        self.pair_buckets, self.word_buckets = about["pair_buckets"], about["word_buckets"]
        self.cut = np.array([0.0, *about["discounts"]])
        self.floor = about["floor"]
        self.counts = Files(folder, "counts", "word", ("n",))
        self.words = Files(folder, "words", "word", ("total", "free", "chance"))
        self.pairs = Files(folder, "pairs", "key", ("count",))

    def _word_bucket(self, word: np.ndarray) -> np.ndarray:
        """As Spark's pmod(xxhash64(word), buckets)."""
        return (_xxhash64(word).view(np.int64) % self.word_buckets)

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """Per text: tokens, known tokens, base score, log10 probability."""
        t = Tokens(texts)
        word, at = np.unique(t.word, return_inverse=True)
        n, = self.counts.find(self._word_bucket(word), word, (0.0,))
        count = n[at]
        short, at = np.unique(np.concatenate([t.before, t.after]), return_inverse=True)
        total, free, chance = self.words.find(self._word_bucket(short), short, (0.0, 1.0, self.floor))
        before, after = at[:len(t.word)], at[len(t.word):]
        key, first, at = np.unique(pair_hash(t.before, t.after), return_index=True, return_inverse=True)
        bucket = bucket_of(t.before[first], key, self.hot, self.pair_buckets)
        seen, = self.pairs.find(bucket, key, (0.0,))
        seen = seen[at]
        direct = (seen - self.cut[np.minimum(seen, 3).astype(np.int64)]) / np.maximum(total[before], 1)
        p = np.maximum(direct, 0) + free[before] * chance[after]
        base = np.log10((count + 1) / (self.tokens + self.distinct + 1))
        per = lambda x: np.add.reduceat(x, t.first[:-1])
        return np.diff(t.first), per((count > 0).astype(np.int64)), per(base), per(np.log10(p))


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _xxhash64(x: np.ndarray) -> np.ndarray:
    """XXH64 (seed 42) of 64-bit integers, the function that Spark's SQL has."""
    with np.errstate(over="ignore"):
        h = np.uint64(42) + _P5 + np.uint64(8) ^ _rotate(x * _P2, 31) * _P1
        h = _rotate(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=1)
def model(folder: str) -> Model:
    """One mapped model per worker process."""
    return Model(folder)


FIELDS = [X.field("n_tokens", "long"), X.field("n_known", "long"), X.field("train_tokens", "long"),
          X.field("base_score", "double"), X.field("score", "double"), X.field("perplexity", "double")]


def score(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: tokens, known tokens, the model's training tokens, base
    and model score (log10), perplexity."""
    def work(texts):
        m = model(folder)
        n, known, base, prob = m.score(texts)
        return [n, known, np.full(len(n), m.tokens), base, prob, 10.0 ** (-prob / n)]

    return X.per_text(docs, id_col, text_col, FIELDS, work, SLICE)
