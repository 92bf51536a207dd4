"""Lookups and descriptive reports (P8-P14, A7-A10) on hand-made papers."""

import pytest

from papyrus.operators import lookup, reports
from papyrus.schemas import PAPERS
from papyrus.sources.stopwords import stopwords_frame


def papers(spark):
    base = {f.name: None for f in PAPERS.fields}

    def p(doi, title, year, authors, ieee=None, akw=None):
        d = dict(base, paper_doi=doi, title=title, publicationDate=year, author_id=authors,
                 ieee_keywords=ieee, authors_keywords=akw)
        return tuple(d[f.name] for f in PAPERS.fields)
    data = [
        p("p1", "Cloud Computing  for the Grid", 2000, [1, 2], ["Cloud computing", "Grid"], ["grid"]),
        p("p2", "Grid scheduling", 2000, [2], None, ["Cloud computing"]),
        p("p3", "The deep nets", 2002, [3], ["Deep learning"], None),
        p("p4", "Grid scheduling", None, [2], None, None),
        p("p5", "Untitled", 1998, [1], ["Grid"], None),
    ]
    return spark.createDataFrame(data, PAPERS)


def test_year_spec_parsing():
    def P(text):
        return tuple(reports.YearSpec.parse(text).years)
    assert P("2000-2002") == (2000, 2001, 2002)
    assert P("2000-2000") == () and P("2002-2000") == ()
    assert P("2000, 1998,1998") == (2000, 1998, 1998)
    assert P("1999") == (1999,)
    with pytest.raises(ValueError):
        P("2000,,2001")
    assert len(reports.YearSpec.parse("1-1000000000").years) == 1000000000


def test_papers_per_year_keeps_zero_and_order(spark):
    out = reports.papers_per_year(papers(spark), "2001, 2000,2000, 1990").orderBy("pos").collect()
    assert [(r.year, r.paper_count) for r in out] == [(2001, 0), (2000, 2), (2000, 2), (1990, 0)]
    assert reports.papers_per_year(papers(spark), "2002-2000").count() == 0


def test_author_year_histogram_drops_null_years(spark):
    out = reports.author_year_histogram(papers(spark), 2).collect()
    assert [(r.year, r.paper_count) for r in out] == [(2000, 2)]


def test_hotspots_phrases_and_exact_stopwords(spark):
    stop = stopwords_frame(spark, ["the", "for", ""])
    out = {r.word: r.n for r in reports.hotspots_by_year(papers(spark), stop, 2000).collect()}
    # title words split on single blanks (the double blank yields "", a stop word here)
    assert out["grid"] == 4 and out["cloud computing"] == 2
    assert "the" not in out and "for" not in out and "" not in out
    ranked = reports.hotspots_by_author(papers(spark), stop, 1).collect()
    assert [r.n for r in ranked] == sorted((r.n for r in ranked), reverse=True)


def test_lookups(spark):
    p = papers(spark)
    assert lookup.search_by_doi(p, "p3").first().title == "The deep nets"
    assert lookup.search_by_title(p, "Grid scheduling").first().paper_doi == "p2"
    assert {r.paper_doi for r in lookup.search_by_keyword(p, "Grid").collect()} == {"p1", "p5"}
    assert lookup.search_by_keyword(p, "grid").count() == 0
    pick1 = lookup.pick_by_keyword(p, "Grid", seed=3).first().paper_doi
    assert pick1 == lookup.pick_by_keyword(p, "Grid", seed=3).first().paper_doi in {"p1", "p5"}
    assert {r.paper_doi for r in lookup.papers_by_author(p, 2).collect()} == {"p1", "p2", "p4"}


def test_resolve_author(spark):
    a = spark.createDataFrame([(1, "Ann"), (2, "Bo"), (3, "Bo")], "author_id int, author_name string")
    assert lookup.resolve_author(a, "42") == 42
    assert lookup.resolve_author(a, "Ann") == 1
    with pytest.raises(LookupError):
        lookup.resolve_author(a, "Bo")
    with pytest.raises(LookupError):
        lookup.resolve_author(a, "Nobody")
