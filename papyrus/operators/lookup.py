"""Point lookups and author resolution.

Identifier and title lookups are equality filters, pushed into the scan where
the column is stored as such.  Membership in an array is never pushed, so
keyword and author lookups on the papers table read it whole;
:func:`keyword_index` and :func:`author_index` give the exploded form, sorted
by its key, whose equality filter skips row groups.  :class:`Postings` stores
that form with the length of every list and answers several keywords at once.
Where the first or a random match is wanted, a total order makes the result
deterministic.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AUTHOR_ID = re.compile("[0-9]+")
#: Stored length up to which a posting list is sent to the tasks of a join.
SHORT_LIST = 100_000


def search_by_doi(papers: DataFrame, doi: str) -> DataFrame:
    """The paper with this identifier (at most one row)."""
    return papers.filter(F.col("paper_doi") == F.lit(doi)).orderBy("paper_doi").limit(1)


def search_by_title(papers: DataFrame, title: str) -> DataFrame:
    """First paper with exactly this title (case-sensitive); several
    papers may share a title, the smallest identifier is returned."""
    return papers.filter(F.col("title") == F.lit(title)).orderBy("paper_doi").limit(1)


def search_by_keyword(papers: DataFrame, keyword: str) -> DataFrame:
    """P10: all papers whose IEEE keywords contain ``keyword`` exactly."""
    return papers.filter(F.array_contains(F.col("ieee_keywords"), F.lit(keyword)))


def pick_by_keyword(papers: DataFrame, keyword: str, seed: int = 0) -> DataFrame:
    """K7: one seeded pseudo-random match (ordered by md5 of id and seed)."""
    key = F.md5(F.concat(F.col("paper_doi"), F.lit(f"#{seed}")))
    return search_by_keyword(papers, keyword).orderBy(key, "paper_doi").limit(1)


def papers_by_author(papers: DataFrame, author_id: int) -> DataFrame:
    """Papers whose author list contains ``author_id``."""
    return papers.filter(F.array_contains(F.col("author_id"), F.lit(int(author_id))))


def resolve_author(authors: DataFrame, arg: str | int) -> int:
    """An all-digit argument is an id; anything else must name exactly
    one author (zero or several matches raise ``LookupError``)."""
    s = str(arg)
    if AUTHOR_ID.fullmatch(s):
        return int(s)
    hits = (authors.filter(F.col("author_name") == F.lit(s))
            .select("author_id").limit(2).collect())
    if len(hits) != 1:
        raise LookupError(f"{len(hits) or 'no'} author(s) named {s!r}")
    return int(hits[0][0])


def _index(papers: DataFrame, array: str, key: str) -> DataFrame:
    pairs = papers.select(F.explode(array).alias(key), "paper_doi").distinct()
    return pairs.repartitionByRange(key, "paper_doi").sortWithinPartitions(key, "paper_doi")


def keyword_index(papers: DataFrame) -> DataFrame:
    """``(keyword, paper_doi)`` sorted by keyword; write it as a table."""
    return _index(papers, "ieee_keywords", "keyword")


def author_index(papers: DataFrame) -> DataFrame:
    """``(author, paper_doi)`` sorted by author; write it as a table."""
    return _index(papers, "author_id", "author")


def lookup(index: DataFrame, papers: DataFrame, value) -> DataFrame:
    """P10 / P11 through a stored index: the papers of one key."""
    hits = index.filter(F.col(index.columns[0]) == F.lit(value)).select("paper_doi")
    return papers.join(hits, "paper_doi", "left_semi")


@dataclass(frozen=True)
class Postings:
    """P10 / P11 for several keys: posting lists stored as two tables.

    ``postings`` is ``(key, paper_doi)``, distinct and sorted by both, so that
    a key is a filter pushed to the scan and skips row groups; ``lengths`` is
    ``(key, papers)``.  A null array, a null key and a null identifier have no
    posting, repeated ones have one; a key that is not stored has an empty
    list; an empty table gives empty postings.
    """

    postings: DataFrame
    lengths: DataFrame

    @classmethod
    def build(cls, papers: DataFrame, array: str, path: str) -> Postings:
        """Write the postings of an array column below ``path``."""
        spark = papers.sparkSession
        pairs = papers.where(F.col("paper_doi").isNotNull()).select(F.explode(array).alias("key"), "paper_doi")
        _sorted(pairs.where(F.col("key").isNotNull()).distinct()).write.parquet(f"{path}/postings")
        lengths = spark.read.parquet(f"{path}/postings").groupBy("key").agg(F.count(F.lit(1)).alias("papers"))
        lengths.repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/lengths")
        return cls.open(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Postings:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))

    def papers_of(self, key) -> DataFrame:
        """``paper_doi`` of one key's list."""
        return self.postings.where(F.col("key") == F.lit(key)).select("paper_doi")

    def _rarest_first(self, keys: Sequence) -> list[tuple]:
        """Each of the given keys once, with its stored length."""
        stored = dict(self.lengths.where(F.col("key").isin(list(keys))).select("key", "papers").collect())
        return sorted(((k, stored.get(k, 0)) for k in dict.fromkeys(keys)), key=lambda pair: pair[1])

    def having_all(self, keys: Sequence) -> DataFrame:
        """Papers with every key.  The rarest list is met with the next rarer
        one first.  What is left after each step is no longer than the
        rarest list: up to ``SHORT_LIST`` identifiers by its stored length it
        is sent to the tasks, and a long list is read where it lies;
        beyond it both sides are shuffled by the identifier."""
        if not keys:
            raise ValueError("at least one key is needed")
        (rarest, length), *others = self._rarest_first(keys)
        left = self.papers_of(rarest)
        for key, _ in others:
            side = F.broadcast(left) if length <= SHORT_LIST else left
            left = self.papers_of(key).join(side, "paper_doi")
        return left

    def having_any(self, keys: Sequence) -> DataFrame:
        """Papers with at least one of the keys, with the number of them."""
        hits = self.postings.where(F.col("key").isin(list(dict.fromkeys(keys))))
        return hits.groupBy("paper_doi").agg(F.count(F.lit(1)).alias("matches"))


def _sorted(pairs: DataFrame) -> DataFrame:
    return pairs.repartitionByRange("key", "paper_doi").sortWithinPartitions("key", "paper_doi")
