"""Shared helpers: bounded slices of a text column inside ``mapInArrow``, and
numpy word hashing.

All operators treat a null text as the empty text.  A task never holds more
than one slice of texts besides the Arrow batch that Spark hands it; a text
longer than a slice is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER_AZ = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into row ranges whose texts hold ``limit`` bytes at most
    (one row, if that row alone is longer)."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        ends = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes per row, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b if b is not None else b"" for b in column.cast(kind).to_pylist()]


def per_text(docs: DataFrame, id_col: str, text_col: str, fields: list[T.StructField],
             work: Callable[[list[bytes]], list], limit: int = SLICE_BYTES) -> DataFrame:
    """One output row per input row: the id column as it is, then ``fields``.

    ``work`` gets the texts of a slice as bytes and returns one sequence per
    field.  Only the two named columns leave the scan; other columns of
    ``docs`` may have any name."""
    return per_row(docs, id_col, text_col, fields, lambda ids, texts: work(texts), limit)


def per_row(docs: DataFrame, id_col: str, text_col: str, fields: list[T.StructField],
            work: Callable[[list, list[bytes]], list], limit: int = SLICE_BYTES) -> DataFrame:
    """:func:`per_text` for work that needs the ids of the slice as well."""
    chosen = docs.select(docs[id_col], docs[text_col].cast("string"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType, True), *fields])

    def run(batches):
        for part in slices(batches, 1, limit):
            columns = work(part.column(0).to_pylist(), as_bytes(part.column(1)))
            arrays = [part.column(0)]
            for field, values in zip(fields, columns, strict=True):
                arrays.append(pa.array(values, type=_ARROW[field.dataType.typeName()]))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema])

    return chosen.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "binary": pa.binary(),
          "boolean": pa.bool_(), "double": pa.float64(), "array": pa.list_(pa.string())}


def filter_texts(docs: DataFrame, text_col: str, keep: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """The rows of ``docs`` (all columns) for which ``keep`` says true."""
    at = docs.columns.index(text_col)

    def run(batches):
        for part in slices(batches, at):
            yield part.filter(pa.array(keep(as_bytes(part.column(at))), type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fresh(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def field(name: str, kind: str) -> T.StructField:
    kinds = {"long": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(),
             "double": T.DoubleType(), "binary": T.BinaryType(), "integer": T.IntegerType()}
    return T.StructField(name, kinds[kind], True)


class Words:
    """White-space separated words (space, tab to carriage return) of a slice
    of texts, as byte ranges of one buffer; ``doc`` is the row of each word
    and ``first[d]:first[d + 1]`` are the words of row ``d``."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.bounds = np.concatenate([[0], np.cumsum(lengths)])
        space = _SPACE[self.buf]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.bounds)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.space = space

    def code_points(self) -> np.ndarray:
        """Code points of each word."""
        lead = np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80)])
        return lead[self.ends] - lead[self.starts]


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BLOCK = 1 << 20
_LONG = 512
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, name: str) -> np.ndarray:
    if name not in _powers:
        p = np.full(_BLOCK + _LONG + 1, base, dtype=np.uint64)
        p[0] = 1
        _powers[name] = np.cumprod(p, dtype=np.uint64)
    return _powers[name]


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range (ranges in order, not overlapping).

    Prefix sums of a polynomial modulo 2^64, block by block; ranges of over
    512 bytes take a digest, as such polynomials are weak on long inputs."""
    up, down = _power(_P, "up"), _power(_P_INV, "down")
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, base + _BLOCK)))
        s, e = starts[at:to] - base, ends[at:to] - base
        short = (e - s) <= _LONG
        stop = min(int(e[-1]), _BLOCK + _LONG)
        body = buf[base:base + stop].astype(np.uint64) + np.uint64(1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(body * up[:stop], dtype=np.uint64)])
        s1, e1 = s[short], e[short]
        value = (total[e1] - total[s1]) * down[s1]
        piece = out[at:to]
        piece[short] = mix(value + (e1 - s1).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        for i in np.flatnonzero(~short):
            raw = buf[base + s[i]:base + e[i]].tobytes()
            piece[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
        at = to
    return out


def gram_hashes(buf: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-byte grams from every position of at most 2^20 + 512
    bytes."""
    up, down = _power(_P, "up"), _power(_P_INV, "down")
    body = (buf.astype(np.uint64) + np.uint64(1)) * up[:len(buf)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(body, dtype=np.uint64)])
    return mix((total[n:] - total[:-n]) * down[:max(0, len(buf) - n + 1)])


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
