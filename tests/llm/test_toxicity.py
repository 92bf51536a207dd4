"""Toxicity: held-out accuracy and the effect of counterfactual pairs."""

import random
import zlib

import pytest

from papyrus.llm import queries, toxicity as X
from tests.llm import cases as C

LABELS = "doc_id long, toxic int, text string, label string"


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def label_frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x") for i, t in rows], LABELS)


def made_up(seed=5):
    """Toxic texts hold an insult; most of them, and few neutral ones, name
    one group."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 4 == 0
        words = C.prose(rng, rng.randint(8, 40), 300).split()
        if toxic and rng.random() < 0.9:
            words.insert(rng.randrange(len(words)), rng.choice(["grobblet", "snarfle", "grobbler"]))
        if rng.random() < (0.8 if toxic else 0.02):
            words.insert(rng.randrange(len(words)), "muslims")
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = made_up()
    args = C.frame(spark, docs), label_frame(spark, labels)
    return {p: X.train(*args, penalty=p) for p in (0.0, 1.0)}


def test_neutral_mentions_of_groups(trained):
    """A text that only names a group: scores differ less between groups, and
    fewer neutral mentions are taken for toxic."""
    rng = random.Random(77)
    neutral = [C.prose(rng, 12, 300) for _ in range(200)]
    named = {t: [x + f" {t} came." for x in neutral] for t in ("muslims", "christians", "jews")}
    gap, wrong = {}, {}
    for p, model in trained.items():
        score = {t: model.scores(texts) for t, texts in named.items()}
        gap[p] = abs(score["muslims"] - score["christians"]).mean()
        wrong[p] = (score["muslims"] >= 0.5).mean()
    assert gap[1.0] < 0.1 * gap[0.0] and gap[0.0] > 0.05
    assert wrong[1.0] <= wrong[0.0]
    for model in trained.values():
        insulted = model.scores([x + " grobblet snarfle" for x in neutral])
        assert (insulted >= 0.5).mean() > 0.95 and (model.scores(neutral) < 0.5).mean() > 0.95


def test_pairs_are_all_swaps(spark):
    index = {"=muslims": 0, "mu": 1, "=jews": 2, "=old": 3, "=women": 4, "wo": 5}
    rows = spark.createDataFrame([("Muslims and jews met. Work of Women", 0), ("nothing said", 1), (None, 0)], "text string, label int")
    used, square, pairs = X.counterfactual_sums(rows, index)
    one = X.Counterfactuals(index)
    one.show("Muslims and jews met. Work of Women", 0)
    # each of the two terms of the first sentence for four others, women for men
    assert pairs == one.pairs == 2 * 4 + 1
    cells = {(int(i), int(j)): square[a, b] for a, i in enumerate(used) for b, j in enumerate(used) if square[a, b]}
    assert cells == {k: v for k, v in one.sums.items() if v}
    # the pair women -> men loses the whole word only: "work" has the beginning as well
    assert cells[4, 4] == 1 and (5, 5) not in cells
    # muslims -> christians loses 0 and 1; muslims -> jews loses 0 and 1 too, as the other word still shows 2
    assert cells[0, 0] == 4 and cells[0, 1] == 4 and cells[2, 2] == 4 and (0, 2) not in cells


def test_held_out_accuracy(spark):
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    assert len(got) == 10_000 and all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    fold = [(labels[i], got[i]["predicted"]) for i in labels if held(i)]
    caught = [p for t, p in fold if t]
    assert sum(caught) / len(caught) > 0.8
    clean = [p for t, p in fold if not t]
    assert sum(clean) / len(clean) < 0.01


def test_odd_rows(spark):
    docs, labels = made_up()
    model = X.train(C.frame(spark, docs + [(3, None), (None, "x"), (5, docs[5][1])]),
                    label_frame(spark, labels + [(None, 1), (7, None), (8, 1), (8, 0), (99_999, 1)]))
    rows = [(1, None), (2, ""), (3, "grobblet"), (3, "grobblet"), (None, "snarfle grobblet"), (4, "9 + 9 = ?"), (5, "word " * 1_000_000 + "grobblet")]
    got = sorted(((r["doc_id"], r["score"]) for r in X.score(C.frame(spark, rows), model).collect()), key=repr)
    assert len(got) == len(rows)
    base = [s for i, s in got if i in (1, 2, 4)]
    assert len(set(base)) == 1 and base[0] < 0.5
    assert len({s for i, s in got if i == 3}) == 1
    assert all(s > base[0] for i, s in got if i in (3, 5, None))
    assert X.score(C.frame(spark, []), model).collect() == []


def test_no_labels_or_one_kind(spark):
    docs = C.frame(spark, [(1, "a text"), (2, "b")])
    none = X.train(docs, label_frame(spark, []))
    assert none.weights == {} and none.scores(["", "a"]).tolist() == pytest.approx([0.25, 0.25])
    one = X.train(docs, label_frame(spark, [(1, 0), (2, 0)]))
    assert one.weights == {} and one.scores(["a"])[0] < 0.5


def test_sample_is_a_bound(spark):
    docs, labels = made_up()
    rows = X.labelled(C.frame(spark, docs + [(1, "again")] * 5), label_frame(spark, labels), sample=50)
    assert 50 <= rows.count() <= 55
    bits, known = X.bit_sets(rows, {"=grobblet": 0}, sample=20)
    assert bits.shape == (20, 1) and len(known) == 20
