"""Substring dedup by line hashing.

A unit is a line, or a part of one that ends with a run of ``.``, ``!`` or ``?``;
every unit with a word counts, and the units of a text, put together, are the text.
Units are normalised (A-Z lower-cased, white space collapsed), their digests grouped
globally, and the occurrence that ranks first by (document id, hash of its text,
unit number) stays.  Later occurrences are removed where consecutive ones hold
``RUN_WORDS`` words together and ``UNIT_WORDS`` on average, so that a phrase, a short
line that many texts use or a row of single words stays, while a passage goes whatever
its line breaks; their offsets in the original text are retained.

Digests are written once, with the rank of their unit, and read twice: grouped by
a partially aggregated minimum and count, and joined back where a digest occurs
twice or more.

Defined results: a null or empty text has no units; a null id ranks after all
others; rows that share an id, or have none, are told apart by the hash of
their text, and equal rows share one result, none being earlier than the
other; an empty table gives an empty result; other columns are not read.  A text
longer than a slice is a slice of its own.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrus.llm import texts as X
from papyrus.session import cut_lineage

#: A removed run has this many words, and this many for each of its units.
RUN_WORDS, UNIT_WORDS = 20, 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
UNIT = re.compile(rb"[^\n.!?]*[.!?\n]+|[^\n.!?]+")


def normalised(unit: bytes) -> bytes:
    """A-Z lower-cased, runs of white space as one space, ends trimmed."""
    return b" ".join(unit.translate(X.LOWER_AZ).split())


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, unit, digest) of each unit with a word; ``hash`` is that of
    the whole text, ``unit`` its number in the text."""
    text = F.col(text_col).cast("string")
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType, True), X.field("hash", "long"),
                           X.field("unit", "integer"), X.field("digest", "binary")])

    def run(batches):
        for part in X.slices(batches, 2):
            row, number, digests = [], [], []
            for k, body in enumerate(X.as_bytes(part.column(2))):
                for n, unit in enumerate(UNIT.findall(body)):
                    key = normalised(unit)
                    if key:
                        row.append(k)
                        number.append(n)
                        digests.append(hashlib.md5(key).digest())
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(number, pa.int32()),
                                              pa.array(digests, pa.binary())], names=schema.names)

    return keyed.mapInArrow(run, schema)


def later_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hash, units): the numbers of the units that occur earlier as well."""
    every = cut_lineage(units(docs, id_col, text_col))
    rank = F.struct(F.isnull("id").alias("last"), F.col("id"), F.col("hash"), F.col("unit"))
    # written, so that the join's sides are plain shuffles, which adaptive
    # execution can split where one digest has very many occurrences
    first = cut_lineage(every.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n"))
                        .where("n > 1").select("digest", "first"))
    lost = every.join(first, "digest").where(rank > F.col("first"))
    return lost.groupBy("id", "hash").agg(F.collect_set("unit").alias("units"))


def cut(body: bytes, later: set[int], run_words: int = RUN_WORDS) -> tuple[int, list[tuple[int, int]], bytes]:
    """(units, byte ranges of the removed units, remaining bytes)."""
    parts = UNIT.findall(body)
    if not later:
        return len(parts), [], body
    removed, run, words = set(), [], 0
    for n, part in enumerate([*parts, None]):
        count = len(part.split()) if part is not None and n in later else 0
        if count:
            run.append(n)
            words += count
        elif part is None or part.split():
            if words >= max(run_words, UNIT_WORDS * len(run)):
                removed.update(run)
            run, words = [], 0
    ends = np.cumsum([len(p) for p in parts])
    spans = [(int(ends[n]) - len(parts[n]), int(ends[n])) for n in sorted(removed)]
    return len(parts), spans, b"".join(p for n, p in enumerate(parts) if n not in removed)


FIELDS = [X.field("n_units", "long"), X.field("n_removed", "long"),
          T.StructField("spans", T.ArrayType(T.StringType()), True), X.field("kept", "binary")]


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """Per document: n_units, n_removed, spans (start:end of each removed unit
    in code points of the original text) and kept (the remaining units)."""
    lost = later_units(docs, id_col, text_col)
    text = F.col(text_col).cast("string")
    left = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    lost = lost.withColumnsRenamed({"id": "owner", "hash": "of"})
    same = F.col("id").eqNullSafe(F.col("owner")) & (F.col("hash") == F.col("of"))
    both = left.join(lost, same, "left").select("id", "text", "units")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType, True), *FIELDS])

    def run(batches):
        for part in X.slices(batches, 1):
            rows = []
            for body, later in zip(X.as_bytes(part.column(1)), part.column(2).to_pylist(), strict=True):
                n, spans, kept = cut(body, set(later or ()), run_words)
                if spans:
                    lead = np.concatenate([[0], np.cumsum((np.frombuffer(body, dtype=np.uint8) & 0xC0) != 0x80)])
                    spans = [f"{lead[a]}:{lead[b]}" for a, b in spans]
                rows.append((n, len(spans), spans, kept))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(
                    (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.binary())))], names=schema.names)

    return both.mapInArrow(run, schema)


SQL = rf"""WITH units AS (
  SELECT doc_id, unnest(generate_series(1, len(u))) AS k, unnest(u) AS unit
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\n.!?]*[.!?\n]+|[^\n.!?]+') AS u FROM documents WHERE text <> '') d),
norm AS (
  SELECT *, trim(regexp_replace(translate(unit, '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS key
  FROM units),
ranked AS (
  SELECT *, len(string_split(key, ' ')) AS words,
    row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS LAST, k) > 1 AS later
  FROM norm WHERE key <> ''),
runs AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - row_number() OVER (PARTITION BY doc_id, later ORDER BY k) AS run
  FROM ranked),
lost AS (
  SELECT doc_id, k FROM runs
  QUALIFY later AND sum(words) OVER (PARTITION BY doc_id, later, run)
    >= greatest({RUN_WORDS}, {UNIT_WORDS} * count(*) OVER (PARTITION BY doc_id, later, run))),
kept AS (
  SELECT u.doc_id, count(*) AS n_units, count(l.k) AS n_removed,
    string_agg(unit, '' ORDER BY u.k) FILTER (l.k IS NULL) AS body
  FROM units u LEFT JOIN lost l ON l.doc_id IS NOT DISTINCT FROM u.doc_id AND l.k = u.k GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id IS NOT DISTINCT FROM k.doc_id"""
