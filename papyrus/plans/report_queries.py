"""Lookup and descriptive-report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyrus.operators import lookup, reports
from papyrus.plans import oracle as O
from papyrus.plans.graph_queries import top_author
from papyrus.plans.registry import register
from papyrus.session import scratch_path
from papyrus.sources import stopwords as SW
from papyrus.sources import testdata as td

# Request values used by the registered lookups (like a user's input).
LOOKUP_DOI = "P7"          # a paper whose keyword arrays are null
KEYWORD_OF = "P8"          # the keyword searched is this paper's brand
HOTSPOT_YEAR = 1998
YEAR_RANGE = "1994-2002"   # two years without papers at the ends
YEAR_LIST = "2000, 1996,1996, 1990"
YEAR_SINGLE = "1998"

SCALARS = ["paper_doi", "title", "publishedby", "publicationDate"]
SQL_SCALARS = "paper_doi, title, publishedby, publicationDate"
BASE = [O.PAPERS, O.WROTE]
SQL_TA = ("TA AS (SELECT author_id FROM wrote GROUP BY author_id "
          "ORDER BY count(*) DESC, author_id LIMIT 1)")


def _top_author_id(spark, sf) -> int:
    return int(top_author(spark, sf).first()[0])


def _value(df, col):
    row = df.select(col).first()
    return None if row is None else row[0]


@register("search_doi", O.with_(*BASE)
          + f"SELECT {SQL_SCALARS} FROM papers WHERE paper_doi = '{LOOKUP_DOI}'")
def search_doi(spark, sf):
    return lookup.search_by_doi(td.papers(spark, sf, with_refs=False), LOOKUP_DOI).select(*SCALARS)


@register("search_title", O.with_(*BASE)
          + f"SELECT {SQL_SCALARS} FROM papers WHERE title = "
            f"(SELECT title FROM papers WHERE paper_doi = '{LOOKUP_DOI}') ORDER BY paper_doi LIMIT 1")
def search_title(spark, sf):
    p = td.papers(spark, sf, with_refs=False)
    title = _value(p.filter(F.col("paper_doi") == LOOKUP_DOI), "title")
    return lookup.search_by_title(p, title).select(*SCALARS)


SQL_KW = f"(SELECT p_brand FROM part WHERE 'P' || CAST(p_partkey AS VARCHAR) = '{KEYWORD_OF}')"


@register("search_keyword", O.with_(*BASE, O.KEYWORDS)
          + f"SELECT {SQL_SCALARS} FROM papers WHERE paper_doi IN "
            f"(SELECT paper_doi FROM keywords WHERE kw = {SQL_KW})")
def search_keyword(spark, sf):
    p = td.papers(spark, sf, with_refs=False)
    kw = _value(p.filter(F.col("paper_doi") == KEYWORD_OF), F.col("ieee_keywords")[0])
    return lookup.search_by_keyword(p, kw).select(*SCALARS)


@register("search_keyword_pick", O.with_(*BASE, O.KEYWORDS)
          + f"SELECT {SQL_SCALARS} FROM papers WHERE paper_doi IN "
            f"(SELECT paper_doi FROM keywords WHERE kw = {SQL_KW}) "
            "ORDER BY md5(paper_doi || '#0'), paper_doi LIMIT 1")
def search_keyword_pick(spark, sf):
    p = td.papers(spark, sf, with_refs=False)
    kw = _value(p.filter(F.col("paper_doi") == KEYWORD_OF), F.col("ieee_keywords")[0])
    return lookup.pick_by_keyword(p, kw, seed=0).select(*SCALARS)


SQL_TWO = ("(SELECT p_brand FROM part WHERE 'P' || CAST(p_partkey AS VARCHAR) = '%s')" % KEYWORD_OF,
           "(SELECT p_type FROM part WHERE 'P' || CAST(p_partkey AS VARCHAR) = '%s')" % KEYWORD_OF)


def _two_keywords(spark, sf) -> tuple[lookup.Postings, list[str]]:
    p = td.papers_long(spark, sf)
    index = lookup.Postings.build(p, "ieee_keywords", scratch_path(spark, "postings"))
    return index, _value(p.filter(F.col("paper_doi") == KEYWORD_OF), F.col("ieee_keywords"))


@register("search_keywords_all", O.with_(*BASE, O.KEYWORDS)
          + f"SELECT paper_doi FROM keywords WHERE kw = {SQL_TWO[0]} "
            f"INTERSECT SELECT paper_doi FROM keywords WHERE kw = {SQL_TWO[1]}")
def search_keywords_all(spark, sf):
    """P10 for several keywords, from stored postings alone."""
    index, words = _two_keywords(spark, sf)
    return index.having_all(words)


@register("search_keywords_any", O.with_(*BASE, O.KEYWORDS)
          + f"SELECT paper_doi, count(DISTINCT kw) AS matches FROM keywords WHERE kw IN ({SQL_TWO[0]}, {SQL_TWO[1]}) GROUP BY paper_doi")
def search_keywords_any(spark, sf):
    """Papers with one or both of two keywords, from stored postings alone."""
    index, words = _two_keywords(spark, sf)
    return index.having_any(words)


@register("papers_by_author", O.with_(*BASE, SQL_TA)
          + f"SELECT {SQL_SCALARS} FROM papers WHERE paper_doi IN "
            "(SELECT paper_doi FROM wrote WHERE author_id = (SELECT author_id FROM TA))")
def papers_by_author(spark, sf):
    return lookup.papers_by_author(td.papers(spark, sf, with_refs=False), _top_author_id(spark, sf)).select(*SCALARS)


@register("resolve_author", O.with_(*BASE, SQL_TA, O.AUTHORS)
          + "SELECT author_id, author_name FROM authors WHERE author_name = "
            "(SELECT author_name FROM authors WHERE author_id = (SELECT author_id FROM TA))")
def resolve_author(spark, sf):
    """The name of the top author resolved back to exactly one author."""
    authors = td.authors(spark, sf)
    name = _value(authors.filter(F.col("author_id") == _top_author_id(spark, sf)), "author_name")
    aid = lookup.resolve_author(authors, name)
    return authors.filter(F.col("author_id") == aid).select("author_id", "author_name")


# ------------------------------------------------------------ year reports

def _years_sql(spec: str) -> str:
    ys = reports.YearSpec.parse(spec)
    if not ys.years:
        wanted = "SELECT CAST(NULL AS INTEGER) AS pos, CAST(NULL AS INTEGER) AS year WHERE false"
    else:
        wanted = " UNION ALL ".join(f"SELECT {i} AS pos, {y} AS year" for i, y in enumerate(ys.years))
    return (O.with_(O.PAPERS, f"Y AS ({wanted})")
            + "SELECT Y.pos, Y.year, CAST(count(papers.paper_doi) AS BIGINT) AS paper_count "
              "FROM Y LEFT JOIN papers ON papers.publicationDate = Y.year GROUP BY Y.pos, Y.year")


@register("papers_per_year_range", _years_sql(YEAR_RANGE))
def papers_per_year_range(spark, sf):
    return reports.papers_per_year(td.papers_long(spark, sf), YEAR_RANGE)


@register("papers_per_year_list", _years_sql(YEAR_LIST))
def papers_per_year_list(spark, sf):
    return reports.papers_per_year(td.papers_long(spark, sf), YEAR_LIST)


@register("papers_per_year_single", _years_sql(YEAR_SINGLE))
def papers_per_year_single(spark, sf):
    return reports.papers_per_year(td.papers_long(spark, sf), YEAR_SINGLE)


@register("author_year_histogram", O.with_(*BASE, SQL_TA)
          + "SELECT publicationDate AS year, count(*) AS paper_count FROM papers "
            "WHERE publicationDate IS NOT NULL AND paper_doi IN (SELECT paper_doi FROM wrote "
            "WHERE author_id = (SELECT author_id FROM TA)) GROUP BY publicationDate")
def author_year_histogram(spark, sf):
    return reports.author_year_histogram(td.papers(spark, sf, with_refs=False), _top_author_id(spark, sf))


def _hotspot_sql(paper_filter: str, extra=()) -> str:
    return (O.with_(*BASE, *extra, O.KEYWORDS, O.AUTHOR_KEYWORDS,
                    f"SEL AS (SELECT paper_doi FROM papers WHERE {paper_filter})",
                    "T AS (SELECT w AS word FROM papers, unnest(string_split(lower(title), ' ')) AS t(w) "
                    "WHERE paper_doi IN (SELECT paper_doi FROM SEL) "
                    "UNION ALL SELECT lower(kw) FROM keywords WHERE paper_doi IN (SELECT paper_doi FROM SEL) "
                    "UNION ALL SELECT lower(kw) FROM author_keywords "
                    "WHERE paper_doi IN (SELECT paper_doi FROM SEL))")
            + f"SELECT word, count(*) AS n FROM T WHERE word NOT IN "
              f"(SELECT word FROM {SW.sql_values()}) GROUP BY word")


@register("hotspots_year", _hotspot_sql(f"publicationDate = {HOTSPOT_YEAR}"))
def hotspots_year(spark, sf):
    return reports.hotspots_by_year(td.papers(spark, sf, with_refs=False), SW.stopwords_frame(spark), HOTSPOT_YEAR)


AUTHOR_FILTER = "paper_doi IN (SELECT paper_doi FROM wrote WHERE author_id = (SELECT author_id FROM TA))"


@register("hotspots_author", _hotspot_sql(AUTHOR_FILTER, [SQL_TA]))
def hotspots_author(spark, sf):
    return reports.hotspots_by_author(td.papers(spark, sf, with_refs=False), SW.stopwords_frame(spark),
                                      _top_author_id(spark, sf))


@register("hotspots_author_name", _hotspot_sql(AUTHOR_FILTER, [SQL_TA]))
def hotspots_author_name(spark, sf):
    """A10 with the author given by name (resolved to exactly one id)."""
    authors = td.authors(spark, sf)
    name = _value(authors.filter(F.col("author_id") == _top_author_id(spark, sf)), "author_name")
    aid = lookup.resolve_author(authors, name)
    return reports.hotspots_by_author(td.papers(spark, sf, with_refs=False), SW.stopwords_frame(spark), aid)
