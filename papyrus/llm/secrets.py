"""Secret scans by grammar inference.

Patterns find the plain cases.  Their values are labelled credentials: per
kind, a bounded sample of them (``SAMPLE`` distinct values, the smallest by
hash, out of all documents) builds a prefix tree, whose states are merged
where their symbol and end frequencies are statistically compatible (Hoeffding
bound), which gives a probabilistic automaton of the kind's format.  Every
other run of ``MIN_CANDIDATE`` symbols or more over the labelled alphabet, cut
where it meets a plain case, is a candidate.  All automata score it, and it becomes a
span of the likeliest kind if its likelihood per symbol, the end counted as one,
reaches that of the kind's own values; its length is judged by the end's
likelihood alone.  A sum of each symbol's highest likelihood in any state, taken for
all candidates of a slice at once, leaves out those that cannot reach it.

Defined results: a null or empty text has no spans; without any labelled
value nothing is added; null and repeated document ids pass through row by
row; an empty table gives an empty result; other columns are not read.  A text
longer than a slice is a slice of its own.
"""

from __future__ import annotations

import heapq
import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrus.llm import texts as X

KINDS = ("assign", "access", "hex")
#: Labelled values per kind that an automaton is fitted on.
SAMPLE = 400
#: Confidence of the Hoeffding test.
ALPHA = 0.05
#: Share of a kind's own values that may lie below its threshold.
MISS = 0.02
#: Symbols of the shortest value that the patterns label.
MIN_CANDIDATE = 6
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
                    re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _class(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_DIGITS = b"0123456789"
_LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B))
_HEX, _TOKEN = _class(_DIGITS + b"abcdef"), _class(_DIGITS + _LETTERS + b"+/_.=-")

Span = tuple[int, int, int]  # start, kind, end: in order of the contract


def _runs(buf: np.ndarray, table: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(table[buf], prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    long = end - start >= least
    return list(zip(start[long].tolist(), end[long].tolist(), strict=True))


def base_spans(text: bytes) -> list[tuple[Span, bytes]]:
    """(span in bytes, value) of the assignments and access keys of a text."""
    found: list[tuple[Span, bytes]] = []
    low = text.translate(X.LOWER_AZ)
    if any(n in low for n in NAMES):
        found += [((m.start(), 0, m.end()), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if b"AKIA" in text:
        found += [((m.start(), 1, m.end()), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found


class Slice:
    """The texts of a slice as one buffer."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.starts = np.cumsum(lengths) - lengths

    def row(self, place: int) -> int:
        return int(np.searchsorted(self.starts, place, side="right")) - 1

    def base(self) -> dict[int, list[tuple[Span, bytes]]]:
        """Base spans (in bytes of their text) with their values, by row."""
        found = {d: spans for d, text in enumerate(self.texts) if (spans := base_spans(text))}
        for s, e in _runs(self.buf, _HEX, 24):
            d = self.row(s)
            at = int(self.starts[d])
            found.setdefault(d, []).append(((s - at, 2, e - at), self.buf[s:e].tobytes()))
        return found

    def candidates(self, base: dict[int, list[tuple[Span, bytes]]]) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, in the buffer, of the runs outside base spans."""
        free = _TOKEN[self.buf]
        for d, spans in base.items():
            at = int(self.starts[d])
            for (s, _, e), _ in spans:
                free[at + s:at + e] = False
        edge = np.flatnonzero(np.diff(free, prepend=False, append=False))
        start, end = edge[0::2], edge[1::2]
        long = end - start >= MIN_CANDIDATE
        return start[long], end[long]


# ---------------------------------------------------------------- automata

@dataclass
class State:
    count: int = 0
    ends: int = 0
    seen: dict[int, int] = field(default_factory=dict)
    to: dict[int, int] = field(default_factory=dict)


class Automaton:
    """A probabilistic automaton over bytes.

    Symbols that a state has not seen share half a count; what follows one is
    read from the state that met it."""

    def __init__(self, states: list[State]):
        self.states = states
        self.threshold = -math.inf
        self.unseen = [math.log2(0.5 / 64 / (s.count + 1)) for s in states]
        self.symbol = [{c: math.log2((n + 0.5 / 64) / (s.count + 1)) for c, n in s.seen.items()} for s in states]
        self.end = [math.log2((s.ends + 0.5) / (s.count + 1)) for s in states]
        highest = np.full(256, max(self.unseen))
        for table in self.symbol:
            for c, v in table.items():
                highest[c] = max(highest[c], v)
        self.highest = highest

    def score(self, value: bytes) -> float:
        """Mean log2 likelihood per symbol, the end among them."""
        total, at = 0.0, 0
        for symbol in value:
            total += self.symbol[at].get(symbol, self.unseen[at])
            at = self.states[at].to.get(symbol, at)
        return (total + self.end[at]) / (len(value) + 1)

    def may_reach(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the ranges could score the threshold: no sequence of states
        gives a symbol more than its highest likelihood."""
        sums = np.concatenate([[0.0], np.cumsum(self.highest[buf])])
        return (sums[end] - sums[start] + max(self.end)) / (end - start + 1) >= self.threshold - 1e-6


def _compatible(states: list[State], a: int, b: int) -> bool:
    """Hoeffding test on the end and every symbol, down the common branches."""
    width = math.sqrt(0.5 * math.log(2 / ALPHA))
    stack = [(a, b)]
    while stack:
        p, q = stack.pop()
        x, y = states[p], states[q]
        bound = width * (1 / math.sqrt(x.count) + 1 / math.sqrt(y.count))
        if bound < 1:
            if abs(x.ends / x.count - y.ends / y.count) > bound:
                return False
            for symbol in x.seen.keys() | y.seen.keys():
                if abs(x.seen.get(symbol, 0) / x.count - y.seen.get(symbol, 0) / y.count) > bound:
                    return False
        stack += [(x.to[s], y.to[s]) for s in x.to.keys() & y.to.keys()]
    return True


def _fold(states: list[State], into: int, tree: int) -> None:
    stack = [(into, tree)]
    while stack:
        p, q = stack.pop()
        x, y = states[p], states[q]
        x.count += y.count
        x.ends += y.ends
        for symbol, n in y.seen.items():
            x.seen[symbol] = x.seen.get(symbol, 0) + n
        for symbol, child in y.to.items():
            if symbol in x.to:
                stack.append((x.to[symbol], child))
            else:
                x.to[symbol] = child


def infer(values: list[bytes]) -> Automaton:
    """Merge the states of the values' prefix tree, by breadth from the root:
    a state joins the first accepted state that it is compatible with, or is
    accepted itself."""
    states = [State()]
    for value in sorted(values):
        at = 0
        for symbol in value:
            state = states[at]
            state.count += 1
            state.seen[symbol] = state.seen.get(symbol, 0) + 1
            if symbol not in state.to:
                state.to[symbol] = len(states)
                states.append(State())
            at = state.to[symbol]
        states[at].count += 1
        states[at].ends += 1
    accepted = [0]
    taken = {0}
    while True:
        fringe = [(-states[q].count, p, s, q) for p in accepted for s, q in states[p].to.items() if q not in taken]
        if not fringe:
            break
        _, p, symbol, q = min(fringe)
        for r in accepted:
            if _compatible(states, r, q):
                states[p].to[symbol] = r
                _fold(states, r, q)
                break
        else:
            accepted.append(q)
            taken.add(q)
    number = {q: k for k, q in enumerate(accepted)}
    kept = [State(states[q].count, states[q].ends, states[q].seen, {s: number[t] for s, t in states[q].to.items()})
            for q in accepted]
    made = Automaton(kept)
    scores = sorted(map(made.score, values))
    made.threshold = scores[int(MISS * len(scores))]
    return made


Model = dict[int, Automaton]


def judge(model: Model, value: bytes) -> int | None:
    """The likeliest kind whose threshold the value meets."""
    best = None
    for kind, automaton in sorted(model.items()):
        score = automaton.score(value)
        if score >= automaton.threshold and (best is None or score > best[0]):
            best = (score, kind)
    return None if best is None else best[1]


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Automata from a sample of the labelled values of all documents."""
    def run(batches):
        least: list[list[tuple[int, bytes]]] = [[] for _ in KINDS]  # of each kind, heaps of (-hash, value)
        inside: list[set[bytes]] = [set() for _ in KINDS]
        for part in X.slices(batches, 0):
            for base in Slice(X.as_bytes(part.column(0))).base().values():
                for (_, kind, _), value in base:
                    order = -(xxhash.xxh64_intdigest(value) >> 1)
                    heap = least[kind]
                    if value in inside[kind] or len(heap) >= SAMPLE and order <= heap[0][0]:
                        continue
                    inside[kind].add(value)
                    heapq.heappush(heap, (order, value))
                    if len(heap) > SAMPLE:
                        inside[kind].discard(heapq.heappop(heap)[1])
        rows = [(k, -order, value) for k, heap in enumerate(least) for order, value in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))],
            names=["kind", "place", "value"])

    values = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "kind int, place long, value binary")
    order = Window.partitionBy("kind").orderBy("place", "value")
    sample = values.distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE)
    by_kind: dict[int, list[bytes]] = {}
    for row in sample.collect():  # len(KINDS) * SAMPLE values at most
        by_kind.setdefault(row["kind"], []).append(bytes(row["value"]))
    return {kind: infer(found) for kind, found in by_kind.items()}


# ------------------------------------------------------------------- spans

def spans_of(texts: list[bytes], model: Model) -> dict[int, tuple[list[Span], list[Span]]]:
    """Per row with any: base spans and all spans, in bytes, in order."""
    part = Slice(texts)
    base = part.base()
    first = {d: sorted(span for span, _ in found) for d, found in base.items()}
    more: dict[int, list[Span]] = {}
    if model:
        start, end = part.candidates(base)
        likely = np.zeros(len(start), dtype=bool)
        for automaton in model.values():
            likely |= automaton.may_reach(part.buf, start, end)
        for s, e in zip(start[likely].tolist(), end[likely].tolist(), strict=True):
            kind = judge(model, part.buf[s:e].tobytes())
            if kind is not None:
                d = part.row(s)
                at = int(part.starts[d])
                more.setdefault(d, []).append((s - at, kind, e - at))
    return {d: (first.get(d, []), sorted(first.get(d, []) + more.get(d, []))) for d in sorted(first.keys() | more.keys())}


def _named(text: bytes, spans: list[Span]) -> list[str]:
    """kind:start:end in code points."""
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)])
    return [f"{KINDS[kind]}:{lead[s]}:{lead[e]}" for s, kind, e in spans]


_LIST = T.ArrayType(T.StringType())
FIELDS = [T.StructField("base", _LIST, True), T.StructField("spans", _LIST, True)]


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: base and spans, lists of kind:start:end in code points."""
    def work(texts):
        base, spans = [[] for _ in texts], [[] for _ in texts]
        for d, (first, every) in spans_of(texts, model).items():
            base[d], spans[d] = _named(texts[d], first), _named(texts[d], every)
        return [base, spans]

    return X.per_text(docs, id_col, text_col, FIELDS, work)


MASK = b"[SECRET]"


def mask(text: bytes, spans: list[Span]) -> bytes:
    """The text with each maximal run of spans replaced by a mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return b"".join(out) + text[at:]


def redact(docs: DataFrame, model: Model, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """All rows and columns, secrets masked; ``length_col`` gets the new
    number of code points of the texts that changed."""
    at = docs.columns.index(text_col)
    sized = None if length_col is None else docs.columns.index(length_col)

    def run(batches):
        for part in X.slices(batches, at):
            texts = X.as_bytes(part.column(at))
            found = spans_of(texts, model)
            if found:
                values = part.column(at).to_pylist()
                for d, (_, spans) in found.items():
                    values[d] = mask(texts[d], spans).decode()
                columns = list(part.columns)
                columns[at] = pa.array(values, part.schema.field(at).type)
                if sized is not None:
                    sizes = part.column(sized).to_pylist()
                    for d in found:
                        sizes[d] = len(values[d])
                    columns[sized] = pa.array(sizes, part.schema.field(sized).type)
                part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
            yield part

    return docs.mapInArrow(run, docs.schema)
