"""Descriptive reports.

Each report is one scan of the papers table, a pushed-down filter and a
partial-aggregated ``groupBy``; the reference ran one database query per
year and counted words in Python loops.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrus.operators.lookup import papers_by_author


@dataclass(frozen=True)
class YearSpec:
    """Parsed year argument: ``b-e`` (inclusive, empty when ``b >= e``),
    ``a, b, c`` (blanks removed; order and repeats kept) or ``y``."""
    kind: str
    years: tuple[int, ...] | range

    @staticmethod
    def parse(text: str) -> "YearSpec":
        text = str(text)
        if "-" in text:
            b, e = (int(x) for x in text.split("-")[:2])
            return YearSpec("range", range(b, e + 1) if b < e else range(0))
        if "," in text:
            return YearSpec("list", tuple(int(x) for x in text.replace(" ", "").split(",")))
        return YearSpec("single", (int(text),))


def papers_per_year(papers: DataFrame, spec: str | YearSpec) -> DataFrame:
    """A7 + J7: ``(pos, year, paper_count)`` for every requested year in
    request order; years without papers count 0."""
    ys = spec if isinstance(spec, YearSpec) else YearSpec.parse(spec)
    spark: SparkSession = papers.sparkSession
    year = F.col("publicationDate")
    if ys.kind == "range" and ys.years:
        # a range stays a distributed range and a pushed-down BETWEEN,
        # however long it is
        b, e = ys.years[0], ys.years[-1]
        wanted = spark.range(b, e + 1).select((F.col("id") - b).cast("int").alias("pos"),
                                             F.col("id").cast("int").alias("year"))
        keep = year.between(b, e)
    else:
        wanted = spark.createDataFrame(list(enumerate(ys.years)), "pos int, year int")
        keep = year.isin(sorted(set(ys.years)))
    counts = (papers.filter(keep)
              .groupBy(year.alias("year"))
              .agg(F.count(F.lit(1)).alias("paper_count")))
    return (wanted.join(counts, "year", "left")
            .select("pos", "year", F.coalesce(F.col("paper_count"), F.lit(0)).alias("paper_count")))


def author_year_histogram(papers: DataFrame, author_id: int) -> DataFrame:
    """``(year, paper_count)`` of one author, newest year first;
    papers without a year are left out."""
    return (papers_by_author(papers, author_id)
            .filter(F.col("publicationDate").isNotNull())
            .groupBy(F.col("publicationDate").alias("year"))
            .agg(F.count(F.lit(1)).alias("paper_count"))
            .orderBy(F.desc("year")))


def hotspot_terms(papers: DataFrame) -> DataFrame:
    """U4: ``(paper_doi, word)``: title words (lower case, split on single
    blanks, empty strings kept) plus whole keyword phrases (lower case)."""
    def lowered(c: str) -> F.Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(x))
    terms = F.concat(F.split(F.lower(F.col("title")), " "),
                     lowered("ieee_keywords"), lowered("authors_keywords"))
    return papers.select("paper_doi", F.explode(terms).alias("word"))


def hotspots(papers: DataFrame, stopwords: DataFrame) -> DataFrame:
    """A9/A10 + J6: ``(word, n)`` over the given papers minus stop words
    (exact comparison), most frequent first, ties by word.
    """
    return (hotspot_terms(papers)
            .join(stopwords.select("word"), "word", "left_anti")
            .groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "word"))


def hotspots_by_year(papers: DataFrame, stopwords: DataFrame, year: int) -> DataFrame:
    return hotspots(papers.filter(F.col("publicationDate") == F.lit(int(year))), stopwords)


def hotspots_by_author(papers: DataFrame, stopwords: DataFrame, author_id: int) -> DataFrame:
    return hotspots(papers_by_author(papers, author_id), stopwords)
