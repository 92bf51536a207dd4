"""Quantiles of a text column by a mergeable sketch.

Spark's own quantile functions take numbers; text keys that share a long
prefix can't be turned into numbers without losing their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.session import cut_lineage

#: Keys that a level holds before half of them move up.
LEVEL_KEYS = 4096
#: Sketches that one task merges.
FAN_IN = 32


class KeySketch:
    """Levels of keys: a key of level ``k`` stands for ``2 ** k`` rows.  A
    full level is sorted and every second key moves up, the odd ones and the
    even ones by turns; the others are dropped, so that the ranks of all
    keys change by at most ``2 ** k`` at a time, to either side."""

    def __init__(self, size: int = LEVEL_KEYS):
        self.size = size
        self.levels: list[list[str]] = [[]]
        self.turn: list[int] = [0]

    def add(self, keys: list[str], level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
            self.turn.append(0)
        self.levels[level].extend(keys)
        while level < len(self.levels) and len(self.levels[level]) > self.size:
            ordered = sorted(self.levels[level])
            # an odd key out stays, so that the weights add up to the rows
            whole = len(ordered) // 2 * 2
            if level + 1 == len(self.levels):
                self.levels.append([])
                self.turn.append(0)
            self.levels[level + 1].extend(ordered[self.turn[level]:whole:2])
            self.levels[level] = ordered[whole:]
            self.turn[level] ^= 1
            level += 1

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame([(k, level) for level, keys in enumerate(self.levels) for k in keys],
                            columns=["key", "level"])


def key_sketch(df: DataFrame, column: str, size: int = LEVEL_KEYS) -> DataFrame:
    """``(key, level)``: a sketch of the keys that are not null, of at most
    ``size`` keys a level and a level per doubling of the rows.

    Tasks sketch their rows; sketches are merged ``FAN_IN`` at a time, so no
    task and not the driver takes more than that many.
    """
    def first(batches: Iterator[pa.RecordBatch]):
        sketch = KeySketch(size)
        for b in batches:
            sketch.add(b.column(0).to_pylist())
        rows = sketch.rows().assign(task=TaskContext.get().partitionId())
        yield from pa.Table.from_pandas(rows, schema=schema, preserve_index=False).to_batches()

    def merge(group, part: pd.DataFrame):
        sketch = KeySketch(size)
        for level, found in part.groupby("level")["key"]:
            sketch.add(found.tolist(), int(level))
        return sketch.rows().assign(task=group[0])

    schema = pa.schema([("key", pa.string()), ("level", pa.int32()), ("task", pa.int32())])
    keys = df.select(F.col(column).cast("string").alias("key")).where(F.col("key").isNotNull())
    found = cut_lineage(keys.mapInArrow(first, "key string, level int, task int"))
    tasks = (found.agg(F.max("task")).first()[0] or 0) + 1
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        found = (found.withColumn("part", F.floor(F.col("task") / F.lit(FAN_IN)).cast("int"))
                 .groupBy("part").applyInPandas(merge, "key string, level int, task int"))
    return found.select("key", "level")


def key_bounds(df: DataFrame, column: str, parts: int, size: int = LEVEL_KEYS) -> list[str]:
    """At most ``parts - 1`` keys, rising, that cut the rows with a key into
    ranges of about the same number of rows.

    A key with more rows than a range has is a bound once, and there are
    fewer ranges then.  No rows, or one part, give no bounds.
    """
    if parts < 1:
        raise ValueError("parts must be at least 1")
    rows = sorted((r["key"], 1 << r["level"]) for r in key_sketch(df, column, size).collect())
    total = sum(n for _, n in rows)
    bounds: list[str] = []
    seen, due = 0, 1
    for key, n in rows:
        if due < parts and seen >= total * due / parts:
            if not bounds or bounds[-1] != key:
                bounds.append(key)
            due = int(seen * parts / total) + 1
        seen += n
    return bounds
