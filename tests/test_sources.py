"""Sources: stop words, saved rank tables, cluster lists, JSON corpus, models."""

import json
import os

import pytest

from papyrus import session
from papyrus.operators import lookup
from papyrus.operators import text as T
from papyrus.operators import vectors as V
from papyrus.sources import models, papers, results, stopwords


def test_read_stopwords_strip_modes(spark, tmp_path):
    p = tmp_path / "stop.txt"
    p.write_text("a\nthe \n\nof\n")
    assert sorted(r.word for r in stopwords.read_stopwords(spark, str(p)).collect()) == ["a", "of", "the"]
    raw = sorted(r.word for r in stopwords.read_stopwords(spark, str(p), strip=False).collect())
    assert raw == ["a", "of", "the "]


def test_read_rank_tables_and_cluster(spark, tmp_path):
    (tmp_path / "r.csv").write_text(",related_paper,pagerank\n0,x,0.5\n1,y,0.25\n")
    (tmp_path / "a.csv").write_text(",related_author,simrank\n0,88854,0.07\n")
    (tmp_path / "c.txt").write_text("p1\np2 \n\n")
    assert [tuple(r) for r in results.read_paper_ranks(spark, str(tmp_path / "r.csv")).collect()] == \
        [("x", 0.5), ("y", 0.25)]
    assert results.read_author_ranks(spark, str(tmp_path / "a.csv")).first().related_author == 88854
    assert [r.related_paper for r in results.read_cluster(spark, str(tmp_path / "c.txt")).collect()] == ["p1", "p2"]


def test_read_corpus_json(spark, tmp_path):
    recs = [{"doi": "1", "title": "t", "abstract": "a", "extra": 1},
            {"doi": "1", "title": "t", "abstract": "a"}, {"doi": "2", "title": None, "abstract": "b"}]
    (tmp_path / "c.json").write_text("\n".join(json.dumps(r) for r in recs))
    c = T.read_corpus_json(spark, str(tmp_path / "c.json"))
    assert c.columns == ["doi", "title", "abstract"] and c.count() == 1


def test_model_roundtrip(spark, tmp_path):
    words = spark.createDataFrame([("d", ["a", "b", "a", "b", "a", "b"])], "doi string, words array<string>")
    m = V.train_word2vec(words, vector_size=4, min_count=1, num_partitions=1)
    models.save_model(m, str(tmp_path / "w2v"))
    back = models.load_word2vec(str(tmp_path / "w2v"))
    before = sorted((r.word, tuple(r.vector)) for r in V.word_vectors(m).collect())
    after = sorted((r.word, tuple(r.vector)) for r in V.word_vectors(back).collect())
    assert before == after


def test_written_ranks_read_back(spark, tmp_path):
    ranks = spark.createDataFrame([("10.1/a", 0.5), ("10.1/b", 0.25)], "related_paper string, pagerank double")
    results.write_ranks(ranks, str(tmp_path / "r"))
    back = results.read_paper_ranks(spark, str(tmp_path / "r"))
    assert sorted(map(tuple, back.collect())) == [("10.1/a", 0.5), ("10.1/b", 0.25)]
    sims = spark.createDataFrame([(7, 0.5)], "related_author int, simrank double")
    results.write_ranks(sims, str(tmp_path / "a"))
    assert [tuple(r) for r in results.read_author_ranks(spark, str(tmp_path / "a")).collect()] == [(7, 0.5)]


def test_key_ranges_hold_every_key_once():
    import duckdb
    keys = ["", "10.1/a", "10.1/b", "10.2", "m", "o'k", "zz", None]
    ranges = papers.key_ranges("k", ["10.2", "o'k", "10.2"])
    con = duckdb.connect()
    con.execute("CREATE TABLE t(k VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?)", [[k] for k in keys])
    found = [r[0] for p in ranges for r in con.execute(f"SELECT k FROM t WHERE {p}").fetchall()]
    assert sorted(found, key=repr) == sorted(keys, key=repr) and len(ranges) == 4


def test_read_papers_and_graph_input(spark, tmp_path):
    rows = [("p1", [1, 2], ["p2"]), ("p2", [2], None)]
    table = spark.createDataFrame(rows, "paper_doi string, author_id array<int>, refs_doi array<string>")
    table.write.parquet(str(tmp_path / "papers"))
    read = papers.read_papers(spark, str(tmp_path / "papers"), columns=["paper_doi", "author_id", "refs_doi"])
    cut = papers.graph_input(read, 3)
    assert cut.rdd.getNumPartitions() == 3 and sorted(r.paper_doi for r in cut.collect()) == ["p1", "p2"]


def test_lookup_index_pushes_its_key(spark, tmp_path):
    rows = [("p1", [1, 2], ["a", "b"]), ("p2", [2], None), ("p3", None, ["b"])]
    table = spark.createDataFrame(rows, "paper_doi string, author_id array<int>, ieee_keywords array<string>")
    for name, build, value, want in (("k", lookup.keyword_index, "b", ["p1", "p3"]), ("a", lookup.author_index, 2, ["p1", "p2"])):
        build(table).write.parquet(str(tmp_path / name))
        hits = lookup.lookup(spark.read.parquet(str(tmp_path / name)), table, value)
        assert "EqualTo" in hits._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.paper_doi for r in hits.collect()) == want


@pytest.mark.parametrize("name", ["pagerank_tol", "lpa_related", "keywords_top20", "recommend_lsh", "model_roundtrip"])
def test_scratch_tables_go_with_their_owner(spark, name):
    import __spark_entry__ as E

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = {f for f in os.listdir(folder) if f.startswith("papyrus-")}
    with session.scratch():
        E.queries()[name](spark, "/root/testdata/sf0.001").collect()
    assert {f for f in os.listdir(folder) if f.startswith("papyrus-")} <= before
    with pytest.raises(ZeroDivisionError), session.scratch():
        session.cut_lineage(spark.range(3))
        raise ZeroDivisionError
    assert {f for f in os.listdir(folder) if f.startswith("papyrus-")} <= before
