"""Bounded vocabulary, posting lists, term statistics that grow."""

import random

import pytest
from pyspark.sql import functions as F

from papyrus.operators import lookup
from papyrus.operators import text as T
from papyrus.session import scratch, scratch_path
from papyrus.sources.models import TermStore


def idf(spark, rows):
    return spark.createDataFrame(rows, "word string, df long, total long").withColumn("idf", F.col("total") * 0.5)


def words_of(df):
    return {r.word for r in df.collect()}


@pytest.mark.parametrize("bin_size", [2, 10_000])
def test_bounded_vocabulary_equals_a_sort(spark, monkeypatch, bin_size):
    monkeypatch.setattr(T, "BIN", bin_size)
    rng = random.Random(3)
    pool = ["a", "ab", "abc", "abd", "é", "éa", "", "zz" * 40, "zz" * 40 + "y", "\x00", *(f"w{rng.randrange(500)}" for _ in range(60))]
    rows = [(w, rng.randrange(1, 5), rng.choice([1, 1, 1, 2, 300, 70_000, 1 << 40])) for w in dict.fromkeys(pool)]
    table = idf(spark, [*rows, (None, 9, 9)]).cache()
    for size, least in [(0, 1), (1, 1), (7, 2), (30, 1), (len(rows), 1), (10_000, 1)]:
        order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[2], r[0].encode()))
        assert words_of(T.bounded_vocabulary(table, size, least)) == {r[0] for r in order[:size]}
    assert words_of(T.bounded_vocabulary(table, 10_000, 0.5, n_docs=6)) == {r[0] for r in rows if r[1] >= 3}
    with pytest.raises(ValueError):
        T.bounded_vocabulary(table, 5, 0.5)
    assert T.bounded_vocabulary(table.limit(0), 5).count() == 0
    table.unpersist()


def test_count_vectors_leave_other_words_out(spark):
    tf = spark.createDataFrame([(1, "d", "a", 2), (1, "d", "b", 1), (2, "e", "b", 4), (2, "e", "c", 1)],
                               "row long, doi string, word string, tf long")
    got = T.count_vectors(tf, T.bounded_vocabulary(T.idf_table(tf, 2), 2)).collect()
    assert {tuple(r) for r in got} == {(1, "d", 0, 1), (2, "e", 0, 4), (1, "d", 1, 2)}


PAPERS = "paper_doi string, ieee_keywords array<string>, key string"


@pytest.mark.parametrize("short", [0, 100_000])
def test_postings(spark, monkeypatch, short):
    monkeypatch.setattr(lookup, "SHORT_LIST", short)
    rows = [(f"p{k}", ["all", *(["even"] if k % 2 == 0 else []), *(["third"] * 2 if k % 3 == 0 else [])], "x") for k in range(60)]
    rows += [("n1", None, "x"), ("n2", [None, "even"], "x"), (None, ["all", "even"], "x"), ("p0", ["all", "even"], "y"), ("e", [], "x")]
    with scratch():
        index = lookup.Postings.build(spark.createDataFrame(rows, PAPERS).repartition(3), "ieee_keywords", scratch_path(spark))
        found = index.having_all(["all", "third", "even", "even"])
        assert sorted(r[0] for r in found.collect()) == sorted(f"p{k}" for k in range(0, 60, 6))
        assert index.having_all(["even"]).count() == 31
        assert index.having_all(["all", "unknown"]).count() == 0
        many = {r.paper_doi: r.matches for r in index.having_any(["even", "third", "third"]).collect()}
        assert many["p0"] == 2 and many["p3"] == 1 and many["n2"] == 1 and "p1" not in many
        plan = found._jdf.queryExecution().explainString(found.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "EqualTo(key,third)" in plan and "Cartesian" not in plan
        assert [k for k, _ in index._rarest_first(["all", "third", "even"])] == ["third", "even", "all"]
        with pytest.raises(ValueError):
            index.having_all([])


def test_postings_of_an_empty_table(spark):
    with scratch():
        index = lookup.Postings.build(spark.createDataFrame([], PAPERS), "ieee_keywords", scratch_path(spark))
        assert index.having_all(["a", "b"]).count() == 0 and index.having_any(["a"]).count() == 0


CORPUS = "doi string, title string, abstract string, part string"


def numbers(df):
    return {(r.word, r.df, r.total, round(r.idf, 12)) for r in df.collect()}


def test_term_statistics_grow(spark):
    rng = random.Random(8)
    rows = [(f"d{k}", rng.choice(["t", "u", None]), " ".join(f"word{rng.randrange(30)}" for _ in range(rng.randrange(12))), "x")
            for k in range(80)]
    rows += rows[:5]
    frame = lambda some: spark.createDataFrame(some, CORPUS)
    with scratch():
        one, two = (TermStore(spark, scratch_path(spark)) for _ in range(2))
        assert numbers(one.idf()) == set()
        whole = one.add("all", frame(rows), ["word3"])
        # the parts overlap, and one of them is empty
        added = [two.add(name, frame(part), ["word3"])
                 for name, part in (("a-1", rows[:50]), ("none", []), ("b", rows[30:]))]
        assert sum(added) == whole and added[1] == 0
        assert numbers(two.idf()) == numbers(one.idf()) != set()
        corpus = T.number_rows(T.clean_corpus(frame(rows)))
        assert numbers(one.idf()) == numbers(T.corpus_statistics(corpus, ["word3"])[2].select("word", "df", "total", "idf"))
        with pytest.raises(ValueError):
            two.add("b", frame(rows), [])
        with pytest.raises(ValueError):
            two.add("x/../y", frame(rows), [])


def test_an_interrupted_part_is_not_read(spark, monkeypatch):
    rows = [("d1", "t", "alpha beta", "x"), ("d2", "t", "beta gamma", "x")]
    with scratch():
        store = TermStore(spark, scratch_path(spark))
        store.add("a", spark.createDataFrame(rows[:1], CORPUS), [])
        before, write = numbers(store.idf()), store._write
        monkeypatch.setattr(store, "_write", lambda df, table, part: write(df, table, part) if table != "manifest" else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.add("b", spark.createDataFrame(rows, CORPUS), [])
        assert numbers(store.idf()) == before
        monkeypatch.setattr(store, "_write", write)
        assert store.add("b", spark.createDataFrame(rows, CORPUS), []) == 1
        assert {(w, n) for w, n, _, _ in numbers(store.idf())} == {("alpha", 1), ("beta", 2), ("gamma", 1)}
