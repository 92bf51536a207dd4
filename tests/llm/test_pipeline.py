"""The whole pipeline against brute force, and the registered queries."""

import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T

import __spark_entry__ as entry
import corpus_pipeline
from papyrus.llm import bpe, quality
from papyrus.session import scratch
from tests.llm import cases as C

DOCUMENTS = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()),
    ("n_chars", T.LongType()))])


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [r for r in C.corpus() if r[0] != 600]
    rows += [(700 + k, C.prose(rng, 60, 3000) + f'\ntoken = "{C.sha(bytes([k]))[:40]}" end ' + C.prose(rng, 20, 3000)) for k in range(12)]
    passage = C.prose(rng, 40, 3000)
    rows += [(800 + k, C.prose(rng, 50, 3000) + "\n" + passage + "\n" + C.prose(rng, 30, 3000)) for k in range(4)]
    items = [(1, passage), (2, C.prose(rng, 30, 3000)), (3, None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    wide = [(i, t, "en", None, None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(wide, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_pipeline_against_brute_force(spark, sf_dir):
    folder, rows, items = sf_dir
    kept = [r for r in rows if C.verdict(r[1])]
    roots = C.components(kept, [C.fingerprint(t) for _, t in kept])
    kept = [r for r, root in zip(kept, roots) if r[0] == root]
    hits = C.hits(kept, items)
    clean = [(i, C.masked(t)) for (i, t), h in zip(kept, hits) if not h[4]]
    assert 0 < len(clean) < len(kept) < len(rows) and any("[SECRET]" in t for _, t in clean)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.Vocabulary(path, public_tokenizers.PATTERN).ranks)
    want = {i: np.array(library.encode_ordinary(t), dtype="<u4").tobytes() for i, t in clean}
    with scratch():
        got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"]: bytes(r["ids"]) for r in got} == want and len(got) == len(want)
    texts = dict(clean)
    for r in got:
        assert r["n_tokens"] == len(want[r["doc_id"]]) // 4
        assert r["ids_sha256"] == C.sha(want[r["doc_id"]]) and r["decoded_sha256"] == C.sha(C.data(texts[r["doc_id"]]))


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[0]}/documents.parquet")
    with scratch():
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir[0])
            assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in docs.schema]
        masked = corpus_pipeline.secret_scan(spark, docs, sf_dir[0]).where("text IS NOT NULL").collect()
        assert all(r["n_chars"] == len(r["text"]) for r in masked)
        none = docs.limit(0)
        assert [stage(spark, none, sf_dir[0]).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_coverage_figures_against_brute_force():
    texts = [t for _, t in C.corpus()]
    rng = random.Random(12)
    line = C.prose(rng, 7, 3000)
    texts += ["\n".join([C.prose(rng, 40, 3000), *[line] * k]) for k in range(1, 8)]
    got = quality.measure([C.data(t) for t in texts])["kept"].tolist()
    assert got == [C.verdict(t) for t in texts] and 0 < sum(got) < len(got)


def test_every_dealt_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_dedup", "decontamination", "secret_scan", "byte_bpe"]
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op") and n[2].isdigit()])
def test_registered_query_covers_its_table(spark, name):
    con = duckdb.connect()
    table, key = {"op2": ("pages", "page_id"), "op12": ("embeddings", "vec_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    with scratch():
        df = entry.queries()[name](spark, SF)
        rows = df.collect()
    keys = [r[0] for r in con.execute(f"SELECT {key} FROM {table} ORDER BY 1").fetchall()]
    if table == "embeddings":  # a row per anchor, positive and negative: the SQL below tells whether they are all there
        assert rows and {r["anchor_id"] for r in rows} <= {k for k in keys if k % 50 == 0} and name in entry.oracle_sql()
    else:
        assert sorted(r[key] for r in rows) == keys
    if name in entry.oracle_sql():
        found = con.sql(entry.oracle_sql()[name])
        order = sorted(df.columns)
        at = [found.columns.index(c) for c in order]
        assert sorted(tuple(r[c] for c in order) for r in rows) == sorted(tuple(r[i] for i in at) for r in found.fetchall())
