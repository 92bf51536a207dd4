"""Quality rules by repetition coverage.

Rolling hashes of word n-grams of several lengths tell which n-grams a text
repeats; the rules bound the share of a text's word characters that lies
inside later copies of n-grams or in repeated lines.

Defined results: a null or empty text has no words and fails the base rule;
null ids pass through; repeated rows and ties are judged one by one; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from papyrus.llm import texts as X

#: Largest share (per mille) of word characters in later copies of n-grams.
NGRAM_LIMITS = {5: 150, 6: 145, 7: 140, 8: 135, 9: 130, 10: 125}
#: Largest share (per mille) of word characters in repeated lines.
LINE_LIMIT = 200
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_ROLL = np.uint64(0xD6E8FEB86659FD93)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _covered(flags: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside any flagged window of n words."""
    step = np.zeros(size + 1, dtype=np.int64)
    at = np.flatnonzero(flags)
    step[at] += 1
    np.subtract.at(step, at + n, 1)
    return np.cumsum(step[:-1]) > 0


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal key anywhere, has an equal key before it)."""
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    any_ = later.copy()
    any_[order[:-1][same]] = True
    return any_, later


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The contract's base figures, the coverage figures (per mille of word
    characters) and the verdicts of each text."""
    w = X.Words(texts)
    n_words = np.diff(w.first)
    points = w.code_points()
    chars = _sums(points, w.first)
    out = {"n_words": n_words, "word_chars": chars, "n_symbols": _sums(_SYMBOL[w.buf], w.bounds)}

    base = X.mix(X.range_hashes(w.buf, w.starts, w.ends))
    salt = X.mix(np.arange(1, len(texts) + 1).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    size, total = len(base), np.maximum(chars, 1)
    out["n_repeat_words"] = np.zeros(len(texts), dtype=np.int64)
    grams = np.zeros(size, dtype=np.uint64)
    for n in range(1, max(NGRAM_LIMITS) + 1):
        if size < n:
            grams = grams[:0]
        else:
            grams = grams[:size - n + 1] * _ROLL + base[n - 1:]
        if n not in NGRAM_LIMITS:
            continue
        out[f"gram_{n}"] = np.zeros(len(texts), dtype=np.int64)
        inside = np.flatnonzero(w.doc[:size - n + 1] == w.doc[n - 1:]) if len(grams) else np.zeros(0, int)
        if not len(inside):
            continue
        any_, later = _repeats(X.mix(grams[inside] ^ salt[w.doc[inside]]))
        flags = np.zeros(size, dtype=bool)
        flags[inside] = later
        out[f"gram_{n}"] = 1000 * _sums(np.where(_covered(flags, n, size), points, 0), w.first) // total
        if n == 5:
            flags[inside] = any_
            out["n_repeat_words"] = _sums(_covered(flags, n, size), w.first)

    lines, line_chars = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    for d, text in enumerate(texts):
        seen: set[bytes] = set()
        for line in text.split(b"\n"):
            if line in seen:
                words = line.split()
                lines[d] += bool(words)
                line_chars[d] += sum(len(x.decode("utf-8", "replace")) for x in words)
            else:
                seen.add(line)
    out["n_dup_lines"], out["line_share"] = lines, 1000 * line_chars // total

    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
    clean = out["line_share"] <= LINE_LIMIT
    for n, limit in NGRAM_LIMITS.items():
        clean &= out[f"gram_{n}"] <= limit
    out["kept"] = ~out["base_failed"] & clean
    return out


COLUMNS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"),
           ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"),
           *((f"gram_{n}", "long") for n in NGRAM_LIMITS), ("line_share", "long")]


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The figures of :func:`measure`, one row per document."""
    def work(texts):
        found = measure(texts)
        return [found[name] for name, _ in COLUMNS]

    return X.per_text(docs, id_col, text_col, [X.field(*c) for c in COLUMNS], work)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return X.filter_texts(docs, text_col, lambda texts: measure(texts)["kept"])
