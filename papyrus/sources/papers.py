"""Papers and authors sources.

The reference pulled the papers through pandas on the driver; here the
table is read by the executors: parquet/ORC files, a catalog table, or a
relational database over JDBC split into ranges of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.functions.quantiles import key_bounds
from papyrus.schemas import AUTHORS, PAPERS

PAPER_COLUMNS = [f.name for f in PAPERS.fields]


def read_papers(spark: SparkSession, path: str | None = None, table: str | None = None,
                fmt: str = "parquet", columns: list[str] | None = None) -> DataFrame:
    """Papers from files (``path``, ``fmt``) or a catalog ``table``; only the
    requested ``columns`` are read (the projection reaches the scan)."""
    if (path is None) == (table is None):
        raise ValueError("give exactly one of path and table")
    df = spark.read.format(fmt).load(path) if path is not None else spark.table(table)
    return df.select(*(columns or PAPER_COLUMNS))


def key_ranges(column: str, bounds: list[str]) -> list[str]:
    """Predicates that cut a text key into ranges at ``bounds``: every row
    with a key is in exactly one, rows without a key in the last."""
    quoted = ["'" + b.replace("'", "''") + "'" for b in sorted(set(bounds))]
    if not quoted:
        return [f"{column} IS NOT NULL", f"{column} IS NULL"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(quoted, quoted[1:])]
    return [f"{column} < {quoted[0]}", *inner, f"{column} >= {quoted[-1]}", f"{column} IS NULL"]


def paper_bounds(papers: DataFrame, parts: int) -> list[str]:
    """Bounds that cut the papers into ``parts`` ranges of their key with
    about the same number of rows, from a sketch of the keys."""
    return key_bounds(papers, "paper_doi", parts)


def read_papers_jdbc(spark: SparkSession, url: str, dbtable: str, properties: dict[str, str],
                     bounds: list[str], columns: list[str] | None = None) -> DataFrame:
    """Papers from a database over JDBC, one task for each range of the text
    key between ``bounds`` (see :func:`key_ranges`; an earlier copy of the
    table gives them by :func:`paper_bounds`).  Credentials come from
    the caller's ``properties``; nothing is hard-coded.  Array columns map to
    Spark arrays where the driver supports them."""
    table = spark.read.jdbc(url, dbtable, predicates=key_ranges("paper_doi", bounds), properties=properties)
    return table.select(*(columns or PAPER_COLUMNS))


def read_authors(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path).select(*[f.name for f in AUTHORS.fields])


def graph_input(papers: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """The three columns graph building needs, hash-partitioned by the
    paper id (count from the session config unless given)."""
    cols = papers.select("paper_doi", "author_id", "refs_doi")
    if num_partitions:
        return cols.repartition(num_partitions, F.col("paper_doi"))
    return cols.repartition(F.col("paper_doi"))
