"""Cuts of the fill-in-middle operator against a plain one."""

import hashlib
import re

import numpy as np
import pytest

from papyrus.llm import fill_middle as M
from tests.llm import cases as C

ODD = [(700, "<P> in a text"), (701, "ends with <"), (702, "<S"), (703, "M>P>S> <m>"), (704, "é" * 50 + "abc"), (705, "a1b2 c3\n\n\td"),
       (706, "𝔘𝔫𝔦 code 中文 x"), (707, "Z"), (708, "<" * 40), (709, "long " * 300_000)]


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_forms_and_cuts(spark):
    rows = C.corpus() + ODD
    got = M.fill_in_middle(C.frame(spark, rows)).collect()
    seen = sorted(((r["doc_id"], (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], bytes(r["output"]).decode())) for r in got), key=repr)
    assert seen == sorted(((i, plain(i, t)) for i, t in rows), key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert sorted(r["restored_sha256"] for r in got) == sorted(C.sha(C.data(t)) for _, t in rows)
    assert M.fill_in_middle(C.frame(spark, [])).collect() == []


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_texts_come_back_whatever_their_ends(form):
    ends = [b"", b"<", b"<S", b">", b"S>", b"M>", b"<P", b"<M"]
    for p in ends:
        for m in ends:
            for s in ends:
                text = p + b" " + m + b"." + s
                parts = {"psm": [M.PREFIX, p + b" ", M.SUFFIX, b"." + s], "spm": [M.SUFFIX, b"." + s, M.PREFIX, p + b" "]}[form]
                if not any(x in text for x in (M.PREFIX, M.SUFFIX, M.MIDDLE)):
                    assert M.restore(b"".join([*parts, M.MIDDLE, m]), form) == text


def test_ranks_and_places_are_counted_ones():
    rng = np.random.default_rng(4)
    for size in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, size).astype(np.uint8)
        matrix = M.WaveletMatrix(symbols, 3)
        at = np.arange(size + 1)
        for s in range(8):
            assert matrix.rank(s, at).tolist() == [int((symbols[:k] == s).sum()) for k in at]
        some = (1, 4, 6)
        before = matrix.count(some, at)
        for want in range(int(before[-1]) + 1):
            place = matrix.reach(some, np.array([want]), np.array([0]), np.array([size]))[0]
            assert place == max(k for k in at if before[k] <= want)


def test_characters_as_units():
    text = "aé中 x".encode()
    done = M.transform([5], [text], unit="char", fim_percent=100, spm_percent=0)[0]
    assert done[0] == 5 and M.restore(done[4], done[1]) == text


def test_any_text_comes_back():
    rng = np.random.default_rng(8)
    letters = list("ab <>PSM.\né中")
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(300)]
    done = M.transform(list(range(300)), [t.encode() for t in texts])
    assert [M.restore(r[4], r[1]).decode() for r in done] == texts
    assert [r[:4] for r in done] == [plain(i, t)[:4] for i, t in enumerate(texts)]
