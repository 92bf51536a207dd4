"""Fill-in-middle: texts cut in three at unit boundaries, found by rank queries.

A slice of texts becomes one :class:`WaveletMatrix` over the classes of its
UTF-8 bytes: letter inside a run of letters, continuation byte of a code point,
first letter of a run, any other first byte.  Boundary counts are sums of ranks:
a token starts at each byte of the last two classes, a code point at each byte
that continues none.  The cut after k units of a text is the place where the
boundary count reaches that of the text's start plus k, found by bisection on
ranks for all cuts of the slice at once.  No text leaves its task.

Defined results: a null or empty text is the plain empty text; a null id takes
its numbers from the digest of ``1:`` alone; repeated rows give repeated, equal
rows; an empty table gives an empty result; other columns are not read.  A text
longer than a slice is a slice of its own and takes about ten times its bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from papyrus.llm import texts as X

INSIDE, CONTINUED, FIRST, OTHER = 0, 1, 2, 3
#: Classes whose bytes start a unit.
UNITS = {"token": (FIRST, OTHER), "char": (INSIDE, FIRST, OTHER)}
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FIM_PERCENT, SPM_PERCENT = 90, 20


class Bits:
    """A bit string with counts at every 64th place."""

    def __init__(self, bits: np.ndarray):
        words = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        packed = np.packbits(bits, bitorder="little")
        words.view(np.uint8)[:len(packed)] = packed
        self.words = words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """Rank over symbols below ``2 ** levels``: each level keeps one bit of
    every symbol, highest first, and deals the zeros before the ones."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = []
        for level in reversed(range(levels)):
            bits = (symbols >> level & 1).astype(bool)
            kept = Bits(bits)
            self.levels.append((level, kept, len(bits) - int(kept.before[-1])))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before each place."""
        first, last = np.zeros(len(at), dtype=np.int64), np.asarray(at, dtype=np.int64)
        for level, bits, zeros in self.levels:
            if symbol >> level & 1:
                first, last = zeros + bits.ones(first), zeros + bits.ones(last)
            else:
                first, last = first - bits.ones(first), last - bits.ones(last)
        return last - first

    def count(self, symbols: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """Occurrences of any of ``symbols`` before each place."""
        return sum(self.rank(s, at) for s in symbols)

    def reach(self, symbols: tuple[int, ...], want: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The last place of ``low..high`` before which no more than ``want``
        of ``symbols`` occur, by bisection on ranks."""
        low, high = low.copy(), high.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            fits = self.count(symbols, mid) <= want
            low, high = np.where(fits, mid, low), np.where(fits, high, np.maximum(mid - 1, low))
        return low


def classes(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each byte; runs of letters end at text starts."""
    lower = buf | 0x20
    letter = (lower >= 0x61) & (lower <= 0x7A)
    goes_on = letter.copy()
    goes_on[1:] &= letter[:-1]
    goes_on[:1] = False
    goes_on[starts[starts < len(buf)]] = False
    out = np.where(letter, FIRST, OTHER).astype(np.uint8)
    out[goes_on] = INSIDE
    out[(buf & 0xC0) == 0x80] = CONTINUED
    return out


def numbers(doc_id) -> list[int]:
    """h1 to h4 of a document."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]


def transform(ids: list, texts: list[bytes], unit: str = "token", fim_percent: int = FIM_PERCENT,
              spm_percent: int = SPM_PERCENT) -> list[tuple]:
    """Per text (units, form, prefix_chars, middle_chars, output)."""
    if not texts:
        return []
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - np.array([len(t) for t in texts])
    matrix = WaveletMatrix(classes(buf, starts), 2)
    base = matrix.count(UNITS[unit], starts)
    units = matrix.count(UNITS[unit], ends) - base
    h = [numbers(i) for i in ids]
    draws = np.array([sorted((x[0] % (n + 1), x[1] % (n + 1))) for x, n in zip(h, units.tolist())], dtype=np.int64).T
    cuts = [matrix.reach(UNITS[unit], base + k, starts, ends) for k in draws]
    points = [matrix.count(UNITS["char"], at) for at in (starts, *cuts)]
    out = []
    for d, text in enumerate(texts):
        n = int(units[d])
        if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[d][2] % 100 >= fim_percent:
            out.append((n, "plain", None, None, text))
            continue
        a, b = int(cuts[0][d] - starts[d]), int(cuts[1][d] - starts[d])
        form = "spm" if h[d][3] % 100 < spm_percent else "psm"
        parts = ([SUFFIX, text[b:], PREFIX, text[:a]] if form == "spm" else [PREFIX, text[:a], SUFFIX, text[b:]])
        out.append((n, form, int(points[1][d] - points[0][d]), int(points[2][d] - points[1][d]),
                    b"".join([*parts, MIDDLE, text[a:b]])))
    return out


def restore(output: bytes, form: str) -> bytes:
    """The text behind an output.  No part holds a mark, and no mark can begin
    inside another or in a part's end, so each is found where it was put."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    body, middle = output[len(PREFIX):].split(MIDDLE, 1)
    one, two = body.split(second, 1)
    return one + middle + two if form == "psm" else two + middle + one


FIELDS = [X.field("n", "long"), X.field("form", "string"), X.field("prefix_chars", "long"),
          X.field("middle_chars", "long"), X.field("output", "binary"), X.field("restored_sha256", "string")]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "token",
                   fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Per document: n (its units), form (plain, psm or spm), prefix_chars and
    middle_chars (code points), output (the bytes), restored_sha256 (of the
    text rebuilt from output and form)."""
    def work(ids, texts):
        done = transform(ids, texts, unit, fim_percent, spm_percent)
        return [*(list(c) for c in zip(*done)), [X.sha256(restore(r[4], r[1])) for r in done]] if done else [[]] * 6

    return X.per_row(docs, id_col, text_col, FIELDS, work)


SQL = r"""WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
drawn AS (
  SELECT doc_id, text, units, CAST(len(units) AS BIGINT) AS n,
    [CAST('0x' || substr(digest, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS h
  FROM parts),
cuts AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90
      THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
cut AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
    array_to_string(units[b + 1:], '') AS suffix
  FROM cuts)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM cut"""
