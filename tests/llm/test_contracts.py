"""Each operator on the same small corpus of odd cases, against brute force."""

import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from papyrus.llm import bpe, decontaminate, line_dedup, ngram_lm, quality, queries, run_index, secrets, simhash, token_files, wrappers
from papyrus.session import scratch_path
from tests.llm import cases as C

ROWS = C.corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return C.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return C.frame(spark, [])


def by_text(rows, value):
    """Multiset of (id, value) pairs."""
    return sorted(((r["doc_id"], value(r)) for r in rows), key=repr)


def expected(values):
    return sorted(((i, v) for (i, _), v in zip(ROWS, values)), key=repr)


def test_run_index(docs, nothing):
    want = C.removed(ROWS)
    got = run_index.dedup_substrings(docs).collect()
    assert by_text(got, lambda r: (r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]) // 16, C.sha(r["kept"]))) \
        == expected([want[r] for r in ROWS])
    assert run_index.dedup_substrings(nothing).collect() == []


def test_run_index_keeps_one_place_of_equal_rows(spark):
    rng = C.random.Random(11)
    rows = [(k, C.prose(rng, 60, 4000)) for k in (1, 2, None, 4)]
    rows = [rows[0], *[rows[1]] * 2, *[rows[2]] * 3, rows[3], (9, rows[1][1])]
    want = [(i, b"" if i == 9 else C.data(t)) for i, t in rows]
    for parts in (1, 3):
        got = run_index.dedup_substrings(C.frame(spark, rows, parts)).collect()
        assert by_text(got, lambda r: bytes(r["kept"])) == sorted(want, key=repr)


def test_run_index_marks_no_place_that_two_tasks_have_sent():
    piece = b"".join(b"%d " % k for k in range(200))[:150]
    rows = [(5, 2, 7, 0, piece), (5, 2, 7, 0, piece), (5, 3, 9, 0, piece)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), (*[pa.int64()] * 4, pa.binary()))], names=run_index._PIECE.names)
    found = [r for b in run_index._marked(100, 32)(iter([batch])) for r in b.to_pylist()]
    assert {(r["rank"], r["twin"]) for r in found} == {(3, 9)}


def test_suffix_order_sorts_ties_alone(monkeypatch):
    """Short suffixes among equal keys stand right, without a sort of all keys by two columns."""
    monkeypatch.setattr(run_index.np, "lexsort", None)
    rng = np.random.default_rng(11)
    for k in range(300):
        text = rng.choice([0, 1, 97], rng.integers(1, 60)).astype(np.uint8) if k % 2 else np.zeros(1 + k % 40, np.uint8)
        raw = text.tobytes()
        assert run_index.suffix_order(text).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def test_run_index_keeps_groups_that_cross_batches():
    piece, other = (b"".join(b"%d " % (k * m) for k in range(200))[:150] for m in (1, 7))
    rows = [(1, 2, 0, 0, other), (3, 2, 0, 0, other), (5, 2, 0, 0, piece), (5, 3, 0, 0, piece), (8, 4, 0, 0, None), (9, 5, 0, 0, other)]
    for cut in range(len(rows) + 1):
        batches = [pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in part], t) for k, t in enumerate((*[pa.int64()] * 4, pa.binary()))], names=run_index._PIECE.names)
            for part in (rows[:cut], rows[cut:])]
        found = {r["rank"] for b in run_index._marked(100, 32)(iter(batches)) for r in b.to_pylist()}
        assert found == {3, 4}


def test_run_index_tells_rows_of_one_id_apart(spark):
    """Two texts of one id whose hashes agree in 13 bits: only the one that
    repeats a passage loses it; and an id of very many rows."""
    rng = C.random.Random(5)
    passage, other = C.prose(rng, 40, 4000)[:150], C.prose(rng, 80, 4000)
    bits = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 8 & 8191
    repeats = passage + " and its own end"
    twin = next(t for t in (f"{other} {k}" for k in range(1 << 20)) if bits(t) == bits(repeats))
    rows = [(1, "first " + passage), (5, repeats), (5, twin), *((7, f"{k} {k} short") for k in range(300)), (7, passage)]
    want = C.removed(rows)
    for parts in (1, 3):
        got = run_index.dedup_substrings(C.frame(spark, rows, parts)).collect()
        assert sorted((r["doc_id"], r["n_bytes"] - len(r["kept"]), C.sha(r["kept"])) for r in got) == \
            sorted((i, want[i, t][1], want[i, t][3]) for i, t in rows)
        assert [len(r["kept"]) for r in got if r["n_bytes"] == len(twin)] == [len(twin)]


def test_run_index_marks_as_a_scan_does():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = int(rng.choice([3, 5, 8]))
        pieces = list({bytes(rng.choice([97, 98], size=rng.integers(1, 30)).astype(np.uint8)) for _ in range(6)})
        seen = set()
        for piece, marked in zip(pieces, run_index.mark(pieces, n)):
            want = []
            for k in range(len(piece) - n + 1):
                if piece[k:k + n] in seen:
                    want.append(k)
                seen.add(piece[k:k + n])
            assert want == marked.tolist()


def test_large_anchor_groups_are_marked_by_parts(monkeypatch):
    passage = C.prose(C.random.Random(3), 40, 4000)
    rows = [(k, C.prose(C.random.Random(50 + k % 30), 12, 3000) + " " + passage + " " + C.prose(C.random.Random(k), 9, 3000))
            for k in range(60)]
    monkeypatch.setattr(run_index, "BATCH_BYTES", 700)
    texts = [t.encode() for _, t in rows]
    text, first, count, offset, anchor = run_index.segments(texts)
    groups = {}
    for d, f, c, o, a in zip(*(x.tolist() for x in (text, first, count, offset, anchor))):
        groups.setdefault(a, []).append((texts[d][f:f + c + 99], o))
    large = [g for g in groups.values() if sum(len(p) for p, _ in g) > 4000]
    assert large
    for group in large:
        distinct = dict(group)
        got = run_index.mark_by_parts(list(distinct), list(distinct.values()))
        assert [x.tolist() for x in got] == [x.tolist() for x in run_index.mark(list(distinct))]


def test_matching_statistics_are_those_of_the_sorted_suffixes():
    text = np.frombuffer(b"abracadabra\x00abracadabra\x00\x00cad", dtype=np.uint8)
    index = run_index.RunIndex.build(text)
    assert len(index.symbol) < len(text) and index.length.sum() == len(text)
    raw = text.tobytes()
    order = sorted(range(len(raw)), key=lambda k: raw[k:])
    length, source = index.matching_statistics()
    for a, b in zip(order, order[1:]):
        n = 0
        while n < min(len(raw) - a, len(raw) - b) and raw[a + n] == raw[b + n]:
            n += 1
        assert length[b] == n and (not n or source[b] == a)


def test_byte_bpe(docs, nothing):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.Vocabulary(path, public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = [(np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes(), C.data(t)) for _, t in ROWS]
    got = bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()
    assert by_text(got, lambda r: (bytes(r["ids"]), bytes(r["decoded"]))) == expected(want)
    assert bpe.encode_decode(nothing, path, public_tokenizers.PATTERN).collect() == []


def test_byte_bpe_odd_pieces():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoder = bpe.Encoder(bpe.Vocabulary(path, public_tokenizers.PATTERN))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocab.ranks, special_tokens={})
    rng = np.random.default_rng(2)
    texts = ["a" * 3000, "the" * 900, "." * 700 + "=-" * 400, " " * 999 + "x", "".join(rng.choice(list("einstrh"), 4000)),
             "中文" * 300, "x\x85y\xa0z\x1c w ", "<|endoftext|>"]
    texts += ["".join(rng.choice(["a", " ", "\n", "é", "中", "1", "'s", "!", "\t", "²", "ा"], 40)) for _ in range(200)]
    assert [i.tolist() for i in encoder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_simhash(docs, nothing):
    prints = [C.fingerprint(t) for _, t in ROWS]
    want = list(zip(prints, C.components(ROWS, prints)))
    got = simhash.near_duplicates(docs).collect()
    assert by_text(got, lambda r: (r["bits"] % (1 << 64), r["component_id"])) == expected(want)
    assert simhash.near_duplicates(nothing).collect() == []


def test_simhash_keeps_one_row_of_each_component(docs):
    prints = [C.fingerprint(t) for _, t in ROWS]
    roots = C.components(ROWS, prints)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len(set(roots)) and {r["doc_id"] for r in rows} == set(roots)


def test_vantage_tree_finds_all_pairs():
    rng = np.random.default_rng(3)
    points = rng.integers(0, 2 ** 63, 1500, dtype=np.uint64)
    flips = points[:700] ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    dense = np.uint64(5) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    every = np.unique(np.concatenate([points, flips, dense]))
    found = {(a, b) for q, m in simhash.near(every, every, 3) for a, b in zip(q.tolist(), m.tolist())}
    a, b = np.nonzero(np.bitwise_count(every[:, None] ^ every[None, :]) <= 3)
    assert found == set(zip(a.tolist(), b.tolist()))


@pytest.mark.parametrize("blocks", [2, 4])
def test_shards_bring_every_pair_together(spark, blocks):
    rng = np.random.default_rng(4)
    points = rng.integers(0, 2 ** 63, 40, dtype=np.uint64)
    every = np.unique(np.concatenate([points, points ^ np.uint64(1 << 40 | 1 << 3), points ^ np.uint64(7)])).view(np.int64)
    prints = spark.createDataFrame([(int(x),) for x in every], "bits long")
    shards = simhash.to_shards(prints, int(points[0]), blocks, 3).collect()
    members = {r["bits"]: r["shard"] for r in shards if r["member"]}
    assert len(members) == len(every) == sum(r["member"] for r in shards)
    together = {(r["shard"], r["bits"]) for r in shards}
    for x in every.tolist():
        for y in every.tolist():
            if bin((x ^ y) % (1 << 64)).count("1") <= 3:
                assert (members[x], y) in together or (members[y], x) in together


def test_ngram_model(docs, nothing):
    want, p, count = C.kneser_ney(ROWS)
    assert abs(sum(p(b"one", w) for w in count) + p(b"one", b"never seen") - 1) < 1e-9
    scored = ngram_lm.score(docs, ngram_lm.train_model(docs)).withColumn("held_out", ngram_lm.held_out("doc_id")).collect()
    names = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    got = by_text(scored, lambda r: tuple(round(r[n], 6) if isinstance(r[n], float) else r[n] for n in names))
    assert got == expected([tuple(round(v, 6) if isinstance(v, float) else v for v in w) for w in want])
    folder = ngram_lm.train_model(nothing)
    assert ngram_lm.score(nothing, folder).collect() == []
    first = ngram_lm.score(docs, folder).first()
    assert first["n_known"] == 0 and first["base_score"] == 0 and first["score"] == 0


def test_decontamination(spark, docs, nothing):
    long = ROWS[10][1]
    items = [(1, long), (2, "one TWO"), (3, None), (4, "..."), (None, "a text without, an id"), (6, long), (7, ROWS[12][1][:300])]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, n_words string")
    got = decontaminate.scan(docs, benchmark).collect()
    rows = by_text(got, lambda r: (r["n_words"], len(r["hit_words"]) // 4, len(r["items"]), C.sha(",".join(r["items"]).encode()),
                                   decontaminate.contaminated(r["n_words"], len(r["hit_words"]) // 4)))
    want = C.hits(ROWS, items)
    assert rows == expected(want)
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for (i, _), w in zip(ROWS, want) if not w[4]), key=repr)
    assert decontaminate.scan(nothing, benchmark).collect() == []
    assert all(r["hit_words"] == b"" for r in decontaminate.scan(docs, benchmark.limit(0)).collect())


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = [(k, ROWS[k][1]) for k in range(12)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.scan(docs, benchmark).collect()), key=repr)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    assert len(list(decontaminate.benchmark_blocks(benchmark, "item_id", "text"))) > 2
    assert sorted(map(tuple, decontaminate.scan(docs, benchmark).collect()), key=repr) == whole


def test_clean_documents_in_blocks(spark, docs, nothing, monkeypatch):
    """The same rows stay, whether the benchmark is one block or several:
    items that share windows, an item whose hits only reach the limit together
    with another block's, copies of a contaminated text, and columns with the
    names used inside."""
    halves = [" ".join(f"w{k}x{j}" for j in range(14)) for k in range(2)]
    filler = " ".join(f"f{j}" for j in range(440))
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame(
        [(9000 + n, t) for n in range(40) for t in (halves[0] + " " + filler + " " + halves[1],)]
        + [(9100, halves[0] + " " + filler), (9101, None), (9102, "")], "doc_id long, text string"))
    odd = odd.withColumn("digest", F.lit("d")).withColumn("n_words", F.lit(1)).withColumn("items", F.lit("i"))
    items = [(k, ROWS[k][1]) for k in range(6)] + [(50, halves[0]), (51, halves[1]), (52, halves[0] + " more")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    key = lambda df: sorted(map(tuple, df.collect()), key=repr)
    whole, kept = key(decontaminate.scan(odd, benchmark)), key(decontaminate.keep_clean(odd, benchmark))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert key(decontaminate.scan(odd, benchmark)) == whole
    many = decontaminate.keep_clean(odd, benchmark)
    assert many.columns == odd.columns and key(many) == kept
    # 28 of 468 words are hit by two items, 14 of 454 by one
    ids = {r[0] for r in kept}
    assert not ids & set(range(9000, 9040)) and {9100, 9101, 9102} <= ids
    assert decontaminate.scan(nothing, benchmark).collect() == [] == decontaminate.keep_clean(nothing, benchmark).collect()


def test_quality(docs, nothing):
    got = quality.quality_report(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_text(got, lambda r: tuple(r[n] for n in names)) == expected([C.repetition(t) for _, t in ROWS])
    assert all(not (r["kept"] and r["base_failed"]) for r in got)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in got if r["kept"])
    assert quality.quality_report(nothing).collect() == []


def test_quality_rejects_repeated_lines_that_the_base_rule_lets_pass():
    line = b"four words a line"
    plain = [b" ".join(b"w%d" % (k + 50 * j) for k in range(12)) for j in range(6)]
    seen = quality.measure([b"\n".join([*plain, *[line] * 8]), b"\n".join(plain)])
    assert seen["base_failed"].tolist() == [False, False] or seen["n_repeat_words"][0] > 0
    assert seen["kept"].tolist() == [False, True]


def test_token_files(spark, docs, nothing):
    path = scratch_path(spark, "tokens")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    token_files.write_tokens(docs, path, vocabulary, public_tokenizers.PATTERN, shard_ids=500)
    got = token_files.crc(token_files.read_tokens(spark, path)).collect()
    library = Tokenizer.from_file(vocabulary)
    want = {}
    for i, t in ROWS:
        raw = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        want.setdefault(i, []).append((len(raw) // 4, raw, zlib.crc32(raw)))
    at = 0
    for row in sorted(got, key=lambda r: r["start"]):
        assert row["start"] == at
        want[row["doc_id"]].remove((row["n_tokens"], bytes(row["tokens"]), row["ids_crc32"]))
        at += row["n_tokens"]
    assert not any(want.values())
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    empty = scratch_path(spark, "tokens")
    token_files.write_tokens(nothing, empty, vocabulary, public_tokenizers.PATTERN)
    assert token_files.read_tokens(spark, empty).collect() == []


def test_new_chunks_go_to_the_library_side_by_side():
    """Marks stand only beside chunks with white space at an end."""
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(vocabulary)
    encoder = token_files.LibraryEncoder(token_files.Library(vocabulary, public_tokenizers.PATTERN))
    marked, inner = [], encoder.vocab.encode_chunks
    encoder.vocab.encode_chunks = lambda chunks: marked.extend(chunks) or inner(chunks)
    texts = ["Start the line\nhere, it's \u00e9t\u00e9 'so' 12.5\n and \t on", "", " ", "the 'so' end\xa0", "\u0120a \u0120 b"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in encoder.encode(texts)] == want
    assert "Start" in marked and " the" not in marked and " it's" not in marked
    encoder.vocab.spaced[:] = False  # a tokenizer that spells spaces in another way
    assert [i.tolist() for i in encoder.encode(["other words " + t for t in texts])] == [
        library.encode("other words " + t, add_special_tokens=False).ids for t in texts]


def test_token_ids_over_runs_of_white_space():
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(vocabulary)
    rng = np.random.default_rng(9)
    signs = ["a", "b1", ".", " ", " ", " ", "\xa0", "\xa0", "\n", "\t", "\u3000", "\x85"]
    texts = ["Home \xa0 \xa0 About us", "x" + " \xa0" * 9 + " y", "\xa0 ", "a\n b", "a  b", "a \xa0"]
    texts += ["".join(rng.choice(signs, rng.integers(1, 25))) for _ in range(20000)]
    encoder = token_files.LibraryEncoder(token_files.Library(vocabulary, public_tokenizers.PATTERN))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [i.tolist() for i in encoder.encode(texts)] == want


def test_grammar_gives_random_access():
    rng = np.random.default_rng(5)
    for ids in (rng.integers(0, 30, 20000), np.zeros(5000, int), np.array([4]), np.zeros(0, int), np.tile([1, 1, 1, 2], 800)):
        symbols, rules = token_files.compress(ids)
        lengths = token_files.expansions(rules)
        assert token_files.expand(token_files.unpack(token_files.pack(symbols)), rules).tolist() == ids.tolist()
        for _ in range(20 if len(ids) else 0):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert token_files.decode_range(symbols, rules, lengths, a, b).tolist() == ids[a:b].tolist()
    symbols, rules = token_files.compress(np.tile([1, 2, 3, 4], 4000))
    assert len(symbols) < 2000 and len(rules)


def test_grammar_goes_on_while_it_saves():
    single = np.random.default_rng(10).permutation(100000)[:20000]
    seldom = np.concatenate([[*single[k::30], 100001, 100002] for k in range(30)])
    assert len(token_files.compress(seldom)[0]) == 20030
    # three rounds, each of which saves about one symbol in 24
    phrase = np.concatenate([[*single[k::1000], 100001, 100002, 100003, 100004] for k in range(1000)])
    assert len(token_files.compress(phrase)[0]) == 21000


def test_secrets(spark, nothing):
    hexes = [C.sha(bytes([k]))[:40] for k in range(60)]
    rows = [(k, f"intro é {'token' if k % 2 else 'Api_Key'} = \"{h}\" tail") for k, h in enumerate(hexes)]
    rows += [(100, "secret:token: abcdefgh"), (101, "password=short"), (102, "password==abc.def"), (103, None), (None, "AKIA" + "A1B2" * 5),
             (104, "AKIASHORT"), (105, f"x{hexes[0].upper()}y"), (106, "deadbeef" * 3), (107, "ſecret=abcdefgh"), (108, "an ordinary text, 1234567890123456")]
    docs = C.frame(spark, rows)
    model = secrets.train(docs)
    got = {r["doc_id"]: r for r in secrets.find(docs, model).collect()}
    assert got[0]["base"] == [f"assign:8:{8 + 11 + 40}", "hex:19:59"]
    assert got[100]["base"] == [] and got[101]["base"] == []
    assert got[102]["base"] == ["assign:0:17"] and got[103]["base"] == [] == got[103]["spans"]
    assert got[None]["base"] == ["access:0:24"] and got[104]["base"] == [] and got[106]["base"] == ["hex:0:24"]
    assert got[107]["base"] == [] and got[108]["spans"] == []
    for r in got.values():
        assert set(r["base"]) <= set(r["spans"])
    masked = secrets.redact(docs, model)
    assert masked.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[0] == 'intro é [SECRET]" tail' and texts[108] == rows[-1][1] and texts[103] is None
    assert secrets.train(nothing) == {} and secrets.find(nothing, {}).collect() == []


def test_secret_query_counts_its_base_spans(spark, tmp_path):
    hexes = "0123456789abcdef" * 2
    rows = [(1, f"token={hexes} password: abcdefgh"), (2, "AKIA" + "A1B2" * 5), (2, f"{hexes} é {hexes}"), (3, None), (None, "secret=short")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op6_secret_scan"](spark, str(tmp_path)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    spans = {0: "assign:0:38,hex:6:38,assign:39:57", 1: "access:0:24", 2: "hex:0:32,hex:35:67", 3: "", 4: ""}
    want = [(1, 2, 0, 1), (2, 0, 1, 0), (2, 0, 0, 2), (3, 0, 0, 0), (None, 0, 0, 0)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        ((*w, C.sha(spans[k].encode())) for k, w in enumerate(want)), key=str)


def test_added_spans_are_those_of_scoring_every_run(spark):
    """Unlabelled credentials of the labelled formats, against scoring each run
    outside the plain cases symbol by symbol."""
    rng = np.random.default_rng(16)
    make = lambda chars, n: "".join(rng.choice(list(chars), n))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    rows = [(k, f"{C.prose(rng=C.random.Random(k), n=20)} token={make('xyz', 4)}-{make('0123456789', 8)} and AKIA{make(upper, 16)}") for k in range(120)]
    rows += [(200 + k, f"an {make('xyz', 4)}-{make('0123456789', 8)} é {make(lower, 20)}, AKIA{make(upper, 12)} xxyy-123 zz") for k in range(30)]
    rows += [(300, "password=abcdef\u00e9" + "xyzx-12345678"), (301, None), (302, ""), (303, "xyzz-" + "1" * 5000), (304, "xyzz-12345678 " * 3)]
    docs = C.frame(spark, rows)
    model = secrets.train(docs)
    assert len(model[0].states) > 1 and len(model[1].states) > 1

    def plain(automaton, value):
        at, total = 0, 0.0
        for c in value:
            s = automaton.states[at]
            n = s.seen.get(c, 0) + 0.5 / 64
            total += np.log2(n / (s.count + 1))
            at = s.to.get(c, at)
        return (total + np.log2((automaton.states[at].ends + 0.5) / (automaton.states[at].count + 1))) / (len(value) + 1)

    added = 0
    for r in secrets.find(docs, model).collect():
        text = dict(rows)[r["doc_id"]] or ""
        covered = [False] * len(text)
        for x in r["base"]:
            _, a, b = x.split(":")
            covered[int(a):int(b)] = [True] * (int(b) - int(a))
        free = "".join("\n" if c else t for c, t in zip(covered, text))
        want = set(r["base"])
        for m in re.finditer(r"[A-Za-z0-9+/_.=-]{6,}", free):
            scores = [(plain(a, m.group().encode()), -k) for k, a in model.items() if plain(a, m.group().encode()) >= a.threshold]
            if scores:
                want.add(f"{secrets.KINDS[-max(scores)[1]]}:{m.start()}:{m.end()}")
                added += 1
        assert set(r["spans"]) == want
    assert added >= 30


def test_automata_tell_formats_apart():
    """Held-out accuracy on labelled credentials and other tokens."""
    rng = np.random.default_rng(6)
    digits, upper = list("0123456789abcdef"), list("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    hexes = ["".join(rng.choice(digits, 40)).encode() for _ in range(300)]
    access = ["AKIA" + "".join(rng.choice(upper, 16)) for _ in range(300)]
    model = {2: secrets.infer(hexes[:150]), 1: secrets.infer([a.encode() for a in access[:150]])}
    assert len(model[1].states) >= 5  # the fixed prefix stays apart
    kept = [secrets.judge(model, h) == 2 for h in hexes[150:]] + [secrets.judge(model, a.encode()) == 1 for a in access[150:]]
    assert sum(kept) / len(kept) > 0.9
    words = ["".join(rng.choice(list("etaoinshrdlu"), 40)).encode() for _ in range(100)]
    wrong = [secrets.judge(model, x) for x in words] + [secrets.judge(model, a[::-1].encode()) for a in access]
    assert not any(wrong)


def plain_dedup(rows, run_words=20):
    """Units, later occurrences and runs of them, row by row."""
    def key(unit):
        return b" ".join(C.WORD.findall(C.lower(unit)))

    def place(i, t, k):
        return (i is None, i or 0, k)

    first, cut = {}, {}
    for i, t in rows:
        cut[i, t] = re.findall(rb"[^\n.!?]*[.!?\n]+|[^\n.!?]+", C.data(t))
        for k, u in enumerate(cut[i, t]):
            if key(u):
                first[key(u)] = min(first.get(key(u), place(i, t, k)), place(i, t, k))
    out = []
    for i, t in rows:
        units = cut[i, t]
        worded = [k for k, u in enumerate(units) if key(u)]
        runs, gone = [[]], set()
        for k in worded:
            if place(i, t, k) > first[key(units[k])]:
                runs[-1].append(k)
            elif runs[-1]:
                runs.append([])
        for run in runs:
            if sum(len(key(units[k]).split()) for k in run) >= max(run_words, 3 * len(run)):
                gone.update(run)
        out.append((len(units), len(gone), b"".join(u for k, u in enumerate(units) if k not in gone)))
    return out


def test_line_dedup(docs, nothing):
    # rows of id 600 are ranked by their texts' hashes, so they have a test of their own
    some = [(i, t) for i, t in ROWS if i != 600]
    got = [r for r in line_dedup.dedup_lines(docs.where("doc_id <> 600 or doc_id is null")).collect()]
    assert by_text(got, lambda r: (r["n_units"], r["n_removed"], bytes(r["kept"]))) \
        == sorted(((i, w) for (i, _), w in zip(some, plain_dedup(some))), key=repr)
    assert sum(r["n_removed"] for r in got) > 10
    texts = dict(ROWS)
    for r in got:
        spans = [tuple(map(int, x.split(":"))) for x in r["spans"]]
        text, at, kept = texts[r["doc_id"]] or "", 0, ""
        for a, b in spans:
            kept, at = kept + text[at:a], b
        assert kept + text[at:] == bytes(r["kept"]).decode()
    assert line_dedup.dedup_lines(nothing).collect() == []


def test_line_dedup_finds_passages_whatever_their_line_breaks(spark):
    rng = C.random.Random(31)
    verse = [C.prose(rng, 4, 4000) for _ in range(15)]
    own = [C.prose(rng, 30, 4000) for _ in range(8)]
    short, phrase = "Licensed under the terms of it.", "Six words that all texts use."
    wrapped = [C.prose(rng, 9, 4000) + "." for _ in range(7)]
    rows = [(1, "\n".join([own[0], *verse, short])), (2, "\n".join([own[1], short, *verse, own[2]])),
            (3, own[3] + ". " + " ".join(wrapped) + " " + own[4]), (4, phrase + " start of it. " + " ".join(wrapped) + "\n" + own[5]),
            (5, own[6] + "\n" + short + "\n" + own[7]), (6, phrase + "\n\n\n" + short)]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(C.frame(spark, rows)).collect()}
    assert [got[k]["n_removed"] for k in range(1, 7)] == [0, 16, 0, 7, 0, 0]
    assert bytes(got[2]["kept"]).decode() == own[1] + "\n" + own[2]
    assert plain_dedup(rows) == [(got[k]["n_units"], got[k]["n_removed"], bytes(got[k]["kept"])) for k in range(1, 7)]


def test_line_dedup_tells_rows_of_one_id_apart(spark):
    rng = C.random.Random(32)
    line = [C.prose(rng, 22, 4000) for _ in range(40)]
    rows = [(1, "\n".join(line[:3])), (600, "\n".join(["x", line[0], line[3]])), (600, "\n".join(["y", line[4], line[5]])),
            (600, "\n".join(["y", line[4], line[5]])), (None, "\n".join([line[6], line[1], line[7]])),
            (None, "\n".join([line[8], line[9], line[2]])), (None, "\n".join([line[10], line[11], line[12]])),
            (None, line[13]), (None, line[13])]
    want = [(i, "".join(x for x in t.splitlines(True) if i == 1 or x.strip() not in line[:3]).encode()) for i, t in rows]
    got = line_dedup.dedup_lines(C.frame(spark, rows)).collect()
    assert by_text(got, lambda r: bytes(r["kept"])) == sorted(want, key=repr)
    shared = [(None, "\n".join(["a", line[20], line[21]])), (None, "\n".join(["b", line[22], line[20]]))]
    got = line_dedup.dedup_lines(C.frame(spark, shared)).collect()
    assert sum(bytes(r["kept"]).count(line[20].encode()) for r in got) == 1
    assert all(sum(bytes(r["kept"]).count(line[k].encode()) for r in got) == 1 for k in (21, 22))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">{0} menu</a><li><a href="/b">two</a></ul></nav><div class="ad banner">buy {0}</div>
<article><h1>Head &lt;{0}&gt;</h1><p><b>First &eacute;  line {0}<br>goes
on</b><p>Second {0} block</p><div class="newsletter">subscribe</div><form><input><p>mail</form>{1}</article>
<aside><p>side {0}</p></aside><div id="comments"><p>I like {0}</p></div><footer>&copy; {0}"""


def test_wrappers(spark):
    rows = [(k, f"https://Host.example/{k}", PAGE.format(f"n{k}", "<ul><li>x<li>y</ul>" if k % 3 else "")) for k in range(9)]
    rows += [(20, "https://other.example/", "<html><body><div class=menu>m</div><div class='post'><p>only " + "words " * 30 + "</p><p>and more of it here</p></div>"),
             (21, None, None), (22, "no url", ""), (None, "https://host.example/z", "plain text &amp; no tags <b>bold"), (20, "https://other.example/", "<p>twice")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string").repartition(3)
    got = {(r["page_id"], r["url"]): r["text"] for r in wrappers.extract(pages).collect() if r["page_id"] != 20}
    for k in range(9):
        want = f"Head <n{k}>\nFirst é line n{k} goes on\nSecond n{k} block" + ("\nx\ny" if k % 3 else "")
        assert got[k, f"https://Host.example/{k}"] == want
    assert got[21, None] == "" == got[22, "no url"]
    assert got[None, "https://host.example/z"] == "plain text & no tags bold"
    twice = sorted(r["text"] for r in wrappers.extract(pages).where("page_id = 20").collect())
    assert twice[0].startswith("only words") and twice[0].endswith("and more of it here") and twice[1] == "twice"
    assert wrappers.extract(pages.limit(0)).collect() == []


@pytest.mark.parametrize("page, want", [
    ("<body class='skin-vector-search-vue no-sidebar'><article><h1>Head</h1><p>Text of it</p></article></body>", "Head\nText of it"),
    ("<body class=sidebar><div class='content-with-comments'><p>Text of it</p><p>goes on</p></div></body>", "Text of it\ngoes on"),
    ("<body><article><div class='entry-header'><h1>Head</h1></div><p>" + "words " * 20 + "</p></article>", "Head\n" + "words " * 19 + "words"),
    ("<body><div class='overlay'><article><p>Text of it</p></article></div><p>by</p>", "Text of it"),
    ("<body><div class=a><p>" + "one " * 60 + "</p></div><div class=b><p>" + "two " * 38 + "</p></div>",
     ("one " * 60).strip() + "\n" + ("two " * 38).strip()),
    ("<body><form id=all><div class=widget><p>Text of it</p></div></form>", "Text of it"),
    ("<body><div class=post><p>" + "words " * 40 + "</p><div class='site-footer'>end</div></div><div id=comments><article>I like it</article></div>",
     "words " * 39 + "words")])
def test_containers_of_the_article_are_no_furniture(page, want):
    root = wrappers.parse("<html><head><title>t</title></head>" + page)
    host = wrappers.regions(wrappers.expression(root))
    for where in (host, None):
        assert wrappers.main_text("<html><head><title>t</title></head>" + page, where) == want


def test_what_differs_between_pages_of_a_host_is_the_article(spark):
    """No element or name tells the article: long fixed parts around it do not
    differ between the pages, optional parts come and go."""
    fixed = C.prose(C.random.Random(1), 120, 4000)
    rows, want = [], {}
    for k in range(40):
        host, rng = k % 4, C.random.Random(100 + k)
        body = [C.prose(rng, 12, 4000) for _ in range(2 + k % 3)]
        note = "<section class=qn>" + C.prose(C.random.Random(host), 40, 4000) + "</section>" if k % 8 < 4 else ""
        tag = ("div", "section", "td", "center")[host]
        rows.append((k, f"https://h{host}.example/{k}", f"<html><body><div class=qa>{fixed}<p>{fixed}</div>{note}"
                     f"<{tag} class=qb>" + "".join(f"<p>{b}</p>" for b in body) + f"</{tag}><div class=qc><p>{fixed}</p><p>{fixed}</div></body>", "x"))
        want[k] = "\n".join(body)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").repartition(3)
    assert {r["page_id"]: r["text"] for r in wrappers.extract(pages).collect()} == want


@pytest.mark.parametrize("page", [
    "<div>" * 100_000 + "deep text" + "</div>" * 100_000, "<b>" * 100_000 + "deep text", "<a " * 1_700_000 + "<p>deep text",
    "<p>deep text<p>" + "<textarea>" * 50_000, '<a "' * 300_000 + "<p>deep text", "<!x " * 500_000 + "<p>deep text",
    "<p>deep text" + "<div>" * 50_000 + "</i>" * 100_000, "".join(f"<div class=c{'z' * (k % 50)}{'y' * (k // 50)}>deep text</div>" for k in range(5_000))],
    ids=["nested", "inline", "open tags", "textarea", "quotes", "declarations", "ends", "unique"])
def test_odd_pages_take_seconds(page):
    began = time.time()
    assert "deep text" in wrappers.main_text(page, None)
    made = wrappers.expression(wrappers.parse(page))
    wrappers.align(made, wrappers.expression(wrappers.parse("<p>other</p>" + page[:len(page) // 2] + page[len(page) // 3:])))
    assert time.time() - began < 30


def test_common_places_are_a_longest_subsequence_of_short_lists():
    rng = np.random.default_rng(1)
    for _ in range(100):
        p, q = ([("t", str(x)) for x in rng.integers(0, 5, rng.integers(0, 15))] for _ in range(2))
        got = wrappers._common(p, q)
        assert all(p[i] == q[j] for i, j in got) and got == sorted(got) and len({j for _, j in got}) == len(got)
        assert [j for _, j in got] == sorted(j for _, j in got) and len(got) == len(wrappers._table(p, q))
    long = [("t", str(k)) for k in range(3000)]
    assert wrappers._common(long, long[:1000] + [("t", "x")] + long[1200:]) == [(k, k if k < 1000 else k - 199) for k in (*range(1000), *range(1200, 3000))]


def test_long_repeats_become_groups():
    page = "<dl>" + "".join(f"<{t}>v{n}</{t}>" for n in range(3) for t in ("i", "b", "u", "s", "em", "q")) + "</dl>"
    inner = wrappers.expression(wrappers.parse(page))[0][5]
    assert len(inner) == 1 and inner[0][0] == "g" and len(inner[0][5]) == 6


def test_alignment_makes_optional_and_repeated_groups():
    one = wrappers.expression(wrappers.parse("<dl><dt>a<dd>b<dt>c<dd>d</dl><p>same</p><p>x</p>"))
    two = wrappers.expression(wrappers.parse("<dl><dt>a<dd>b</dl><hr><p>same</p>"))
    both = wrappers.align(one, two)
    names = [(i[0], i[1], i[2], i[3]) for i in both]
    assert ("t", "hr", 0, 1) in names and ("t", "p", 1, 0) in names
    group = both[0][5][0]
    assert group[0] == "g" or any(i[0] == "g" for i in both[0][5])
