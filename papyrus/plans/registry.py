"""Registered queries: one Spark plan and (where SQL can express it) one
DuckDB twin per key.  Every plan reads the whole driver tables through
:mod:`papyrus.sources.testdata`; query parameters (a source paper, an
author, a year) are picked from the data by a fixed rule, so the plans do
the same work at any scale.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.plans import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rnd(c: str, alias: str | None = None) -> F.Column:
    return F.round(F.col(c), O.DP).alias(alias or c)
