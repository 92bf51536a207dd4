"""Toxicity: a linear classifier whose score changes under swapped identity terms
are penalised (counterfactual logit pairing).

Features of a text are the presence of its words (runs of letters, lower case)
and of their beginnings of 2 to 8 letters.  The fit reads the documents of at
most ``SAMPLE`` labels (the first by hash of the id) and has three parts, each
a Spark job:

1. counts of every feature in toxic and other documents, added up in tasks and by
   ``groupBy``; the ``FEATURES`` features of highest log-likelihood ratio over
   ``LEAST_RATIO`` are used;
2. counterfactuals: in each labelled sentence that names a group, the term is swapped
   for each other term of its set; a sentence that is labelled neutral and names none
   gets one term added.  The pair's difference ``d`` changes the logit by ``w.d``, so the
   sum of all squared changes is ``w' C w`` with ``C`` the sum of ``d d'``, which
   tasks add up and ``groupBy`` merges; no pair is kept;
3. the sample as bit sets (``FEATURES`` / 8 bytes a document), on which the driver
   minimises log loss + ``PENALTY`` times the mean squared change + a ridge.

Scoring is one pass over whole texts without a shuffle.

Defined results: a null or empty text scores as the classifier's base rate; repeated
rows get repeated, equal results; without labels every score is that of the prior
(below 0.5); labels whose id or value is null are not read, a document with both labels
counts once for each; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrus.llm import texts as X
from papyrus.session import cut_lineage

#: Labels (and documents with them) that the classifier is fitted on at most.
SAMPLE = 16_384
FEATURES = 4_096
LEAST_RATIO, LEAST_DOCS = 20.0, 5
PENALTY, RIDGE = 1.0, 1e-3
STEPS, RATE = 300, 0.3
STARTS = range(2, 9)
FOLDS, HELD_OUT = 5, 0

# Neutral mentions of groups.  Terms of one set replace each other.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("gay", "straight", "lesbian", "bisexual"), ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists"),
    ("immigrant", "native"), ("deaf", "blind", "disabled"), ("old", "young"), ("american", "mexican", "african", "european"),
    ("frauen", "männer"), ("frau", "mann"), ("muslime", "christen", "juden"), ("schwule", "lesben"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("femme", "homme"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "français"),
    ("mujeres", "hombres"), ("mujer", "hombre"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "españoles"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of(word: str) -> list[str]:
    """The word and its beginnings; ``=`` marks whole words."""
    return ["=" + word, *(word[:k] for k in STARTS if k < len(word))]


def decoded(texts: list[bytes]) -> list[str]:
    return [t.decode("utf-8", "replace") for t in texts]


# ---------------------------------------------------------------- the sample

def held_out(id_col: str):
    """Whether a document's label may not be learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(text, label) of the documents of the first ``sample`` training labels,
    written.  The labels are at most ``sample`` narrow rows, so they are sent to
    all tasks and the texts stay in place."""
    known = labels.select(F.col(id_col).alias("of"), (F.col(label_col) > 0).cast("int").alias("label"))
    known = known.where(F.col("of").isNotNull() & F.col("label").isNotNull() & ~held_out("of")).distinct()
    first = known.orderBy(F.xxhash64("of"), "of", "label").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut_lineage(texts.join(F.broadcast(first), F.col("id") == F.col("of")).select("text", "label"))


# ------------------------------------------------------------- distributed sums

def feature_counts(rows: DataFrame) -> DataFrame:
    """(feature, n, toxic): documents and toxic documents with each feature."""
    def run(batches):
        count = ({}, {})
        for part in X.slices(batches, 0):
            for text, label in zip(decoded(X.as_bytes(part.column(0))), part.column(1).to_pylist(), strict=True):
                for f in {f for w in words_of(text) for f in features_of(w)}:
                    count[label][f] = count[label].get(f, 0) + 1
            if len(count[0]) + len(count[1]) > 500_000:
                yield from sent(count)
        yield from sent(count)

    def sent(count):
        for label, known in enumerate(count):
            n = pa.array(list(known.values()), pa.int64())
            zero = pa.array(np.zeros(len(known), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(list(known), pa.string()), n, n if label else zero], names=["feature", "n", "toxic"])
            known.clear()

    made = rows.mapInArrow(run, "feature string, n long, toxic long")
    return made.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))


def chosen_features(counts: DataFrame, docs: int, toxic: int, features: int = FEATURES,
                    least_ratio: float = LEAST_RATIO, least_docs: int = LEAST_DOCS) -> list[str]:
    """The features whose presence depends most on the label, by the
    log-likelihood ratio of the two-by-two table."""
    def part(seen, row, column):
        expected = row * column / docs
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    n, a = F.col("n"), F.col("toxic")
    ratio = 2 * (part(a, n, F.lit(toxic)) + part(n - a, n, F.lit(docs - toxic))
                 + part(toxic - a, docs - n, F.lit(toxic)) + part(docs - toxic - n + a, docs - n, F.lit(docs - toxic)))
    best = (counts.where(n >= least_docs).select("feature", F.round(ratio, 6).alias("ratio")).where(F.col("ratio") > least_ratio)
            .orderBy(F.desc("ratio"), "feature").limit(features))
    return [r["feature"] for r in best.collect()]


class Counterfactuals:
    """Sums of ``d d'`` over the pairs of the sentences it is shown."""

    def __init__(self, index: dict[str, int], identity=IDENTITY):
        self.index = index
        self.known: dict[str, frozenset[int]] = {}
        self.sets = {term: group for group in identity for term in group}
        self.terms = sorted(self.sets)
        self.own = {t: self._known(t) for t in self.terms}
        self.sums: Counter = Counter()
        self.pairs = 0

    def _known(self, word: str) -> frozenset[int]:
        if word not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[word] = frozenset(self.index[f] for f in features_of(word) if f in self.index)
        return self.known[word]

    def _pair(self, context: set[str], old: str | None, new: str) -> None:
        """The sentence's other words hide what they have themselves."""
        hidden = set().union(*(self._known(w) for w in context)) if context else set()
        before = self.own[old] - hidden if old else frozenset()
        after = self.own[new] - hidden
        signed = [(k, 1) for k in after - before] + [(k, -1) for k in before - after]
        for (i, x), (j, y) in itertools.product(signed, signed):
            self.sums[i, j] += x * y
        self.pairs += 1

    def show(self, text: str, label: int) -> None:
        for sentence in _SENTENCE.split(text):
            words = words_of(sentence)
            named = words & self.sets.keys()
            for old in sorted(named):
                for new in self.sets[old]:
                    if new != old:
                        self._pair(words - {old}, old, new)
            if words and not named and not label:
                self._pair(words, None, self.terms[zlib.crc32(sentence.encode()) % len(self.terms)])


def counterfactual_sums(rows: DataFrame, index: dict[str, int], identity=IDENTITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(features, C over these, pairs): no more features than the identity
    terms have."""
    def run(batches):
        seen = Counterfactuals(index, identity)
        for part in X.slices(batches, 0):
            for text, label in zip(decoded(X.as_bytes(part.column(0))), part.column(1).to_pylist(), strict=True):
                seen.show(text, label)
        cells = [*seen.sums.items(), ((-1, -1), seen.pairs)]
        yield pa.RecordBatch.from_arrays([pa.array([c[0][0] for c in cells], pa.int32()), pa.array([c[0][1] for c in cells], pa.int32()),
                                          pa.array([c[1] for c in cells], pa.int64())], names=["i", "j", "v"])

    cells = rows.mapInArrow(run, "i int, j int, v long").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    used = sorted({r["i"] for r in cells if r["i"] >= 0})
    at = {k: n for n, k in enumerate(used)}
    square = np.zeros((len(used), len(used)))
    pairs = 0
    for r in cells:
        if r["i"] < 0:
            pairs = r["v"]
        else:
            square[at[r["i"]], at[r["j"]]] = r["v"]
    return np.array(used, dtype=np.int64), square, pairs


def bit_sets(rows: DataFrame, index: dict[str, int], sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(bits, labels) of at most ``sample`` of the rows, the first by hash."""
    size = len(index) // 8 + 1

    def run(batches):
        for part in X.slices(batches, 0):
            texts = decoded(X.as_bytes(part.column(0)))
            bits = np.zeros((len(texts), size * 8), dtype=bool)
            for row, text in zip(bits, texts):
                row[np.array([index[f] for w in words_of(text) for f in features_of(w) if f in index], dtype=np.int64)] = True
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in np.packbits(bits, axis=1)], pa.binary()), part.column(1),
                                              part.column(2)], names=["bits", "label", "key"])

    keyed = rows.select("text", "label", F.xxhash64("text", "label").alias("key"))
    first = keyed.mapInArrow(run, "bits binary, label int, key long").orderBy("key", "bits").limit(sample).toArrow()
    raw = np.frombuffer(b"".join(first.column("bits").to_pylist()), dtype=np.uint8).reshape(-1, size)
    return np.unpackbits(raw, axis=1)[:, :len(index)].astype(bool), first.column("label").to_numpy()


# --------------------------------------------------------------------- the fit

class Model:
    """Weights of the chosen features and a bias."""

    def __init__(self, weights: dict[str, float], bias: float, pairs: int = 0):
        self.weights, self.bias, self.pairs = weights, bias, pairs

    def scores(self, texts: list[str]) -> np.ndarray:
        found: dict[str, tuple] = {}
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            present = {}
            for w in words_of(text):
                if w not in found:
                    found[w] = tuple((f, self.weights[f]) for f in features_of(w) if f in self.weights)
                if found[w]:
                    present.update(found[w])
            out[k] = self.bias + sum(present[f] for f in sorted(present))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def minimise(bits: np.ndarray, labels: np.ndarray, used: np.ndarray, square: np.ndarray, pairs: int, bias: float,
             penalty: float = PENALTY, ridge: float = RIDGE, steps: int = STEPS, rate: float = RATE) -> tuple[np.ndarray, float]:
    """Full-batch adaptive gradient steps."""
    row, col = np.nonzero(bits)
    size, n = bits.shape[1], max(1, len(labels))
    w, b = np.zeros(size), bias
    seen_w, seen_b = np.full(size, 1e-8), 1e-8
    square = square / max(1, pairs)
    for _ in range(steps if len(labels) else 0):
        z = np.bincount(row, w[col], len(labels)) + b
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        grad = np.bincount(col, error[row], size) / n + ridge * w
        grad[used] += 2 * penalty * (square @ w[used])
        slope = float(error.mean())
        seen_w += grad * grad
        seen_b += slope * slope
        w -= rate * grad / np.sqrt(seen_w)
        b -= rate * slope / np.sqrt(seen_b)
    return w, b


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          sample: int = SAMPLE, identity=IDENTITY, penalty: float = PENALTY, least_ratio: float = LEAST_RATIO) -> Model:
    """The classifier of the labels outside the held-out fold."""
    rows = labelled(docs, labels, id_col, text_col, label_col, sample)
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    rate = (size["toxic"] + 0.5) / (size["n"] + 2)
    bias = float(np.log(rate / (1 - rate)))
    if not 0 < size["toxic"] < size["n"]:
        return Model({}, bias)
    names = chosen_features(feature_counts(rows), size["n"], size["toxic"], least_ratio=least_ratio)
    index = {f: k for k, f in enumerate(names)}
    used, square, pairs = counterfactual_sums(rows, index, identity)
    bits, known = bit_sets(rows, index, sample)
    weights, bias = minimise(bits, known, used, square, pairs, bias, penalty)
    return Model(dict(zip(names, weights.tolist())), float(bias), pairs)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every document."""
    return X.per_text(docs, id_col, text_col, [X.field("score", "double")], lambda texts: [model.scores(decoded(texts))])
