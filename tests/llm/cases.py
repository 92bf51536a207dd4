"""Small fixtures and brute-force versions for the operators' tests."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import xxhash

from pyspark.sql import types as T

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Names that the operators use inside, as further columns of the input.
CLASHES = ("id", "rank", "hash", "bits", "low", "lines", "owner", "key", "row_key", "n_words", "spans", "ids", "host")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     *(T.StructField(c, T.StringType()) for c in CLASHES)])


def frame(spark, rows, parts=3):
    wide = [(i, t, *("x" for _ in CLASHES)) for i, t in rows]
    return spark.createDataFrame(wide, DOCS).repartition(parts) if wide else spark.createDataFrame([], DOCS)


def prose(rng, n, vocab=400):
    return " ".join(f"{rng.choice('abcdefgh')}{'aeiou'[k % 5]}{'lmnrst'[k % 6]}{k % 37}" for k in (rng.randrange(vocab) for _ in range(n)))


def corpus(seed=7):
    """Copies, near copies, shared passages, repeated lines, odd texts."""
    rng = random.Random(seed)
    passage = prose(rng, 60, 4000)
    rows = []
    for i in range(40):
        rows.append((i, prose(rng, rng.randint(15, 200), 3000)))
    rows += [(100 + i, rows[3][1]) for i in range(6)]
    rows += [(200 + i, rows[5][1].replace(" ", "  ", i)) for i in range(4)]
    rows += [(300 + i, prose(rng, 20, 3000) + "\n" + passage + "\n" + prose(rng, 25, 3000)) for i in range(5)]
    rows += [(400, "Same line of six words here\n" * 5), (401, "é ü 中文 " * 40), (402, "a" * 1500), (403, "ab" * 700)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "One"), (504, "one two"), (505, "\x00null byte\x00 in text"),
             (506, prose(rng, 6000, 3000))]
    rows += [(None, "a text without an id, of some words"), (600, rows[7][1]), (600, rows[7][1]), (600, "another text of id 600")]
    return rows


def data(text):
    return (text or "").encode()


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def lower(raw):
    return raw.translate(LOWER)


# ------------------------------------------------------------------- op 1

def removed(rows, length=100):
    """(bytes, removed, runs, digest) per row, in order of id, nulls last."""
    seen, out = set(), {}
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    for i, text in order:
        raw = data(text)
        cover = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p:p + length] in seen:
                cover[p:p + length] = b"\1" * length
            seen.add(raw[p:p + length])
        runs = sum(1 for k, c in enumerate(cover) if c and not (k and cover[k - 1]))
        out[i, text] = len(raw), sum(cover), runs, sha(bytes(x for x, c in zip(raw, cover) if not c))
    return out


# ------------------------------------------------------------------- op 4

def fingerprint(text, shingle=3):
    words = WORD.findall(lower(data(text)))
    parts = [b" ".join(words[k:k + shingle]) for k in range(len(words) - shingle + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(rows, prints, bits=3):
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    ids = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)].append(i)
    return [min(ids[find(k)], default=None) for k in range(len(rows))]


# ------------------------------------------------------------------- op 5

def kneser_ney(rows):
    tokens = [[*WORD.findall(lower(data(t))), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    count, pairs = Counter(), Counter()
    for t, h in zip(tokens, held):
        if not h:
            count.update(t)
            pairs.update(zip([b"", *t[:-1]], t))
    n, v, types = sum(count.values()), len(count), len(pairs)

    def cuts(often):
        y = often[1] / (often[1] + 2 * often[2]) if often[1] and often[2] else 0
        out = [0]
        for k in (1, 2, 3):
            d = k - (k + 1) * y * often[k + 1] / often[k] if y and often[k] else k / 2
            out.append(d if 0 < d <= k else k / 2)
        return out

    kinds, total, groups = Counter(w for _, w in pairs), Counter(), defaultdict(Counter)
    for (u, _), c in pairs.items():
        total[u] += c
        groups[u][min(c, 3)] += 1
    d2, d1 = cuts(Counter(pairs.values())), cuts(Counter(kinds.values()))
    free = sum(d1[min(k, 3)] for k in kinds.values()) / types if types else 1

    def q(w):
        return max(kinds[w] - d1[min(kinds[w], 3)], 0) / max(types, 1) + free / (v + 1)

    def p(u, w):
        if not total[u]:
            return q(w)
        c = pairs[u, w]
        return max(c - d2[min(c, 3)], 0) / total[u] + sum(groups[u][k] * d2[k] for k in (1, 2, 3)) / total[u] * q(w)

    out = [(h, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t),
            sum(math.log10(p(u, w)) for u, w in zip([b"", *t[:-1]], t))) for t, h in zip(tokens, held)]
    return out, p, count


# ------------------------------------------------------------------- op 7

PIECE = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(rows, items, size=13):
    windows = defaultdict(set)
    for i, text in items:
        w = PIECE.findall(lower(data(text)))
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[k:k + size])].add("" if i is None else str(i))
    lengths = {len(w) for w in windows}
    out = []
    for _, text in rows:
        w = PIECE.findall(lower(data(text)))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit) and 20 * len(hit) >= len(w)))
    return out


# ------------------------------------------------------------------ op 10

def repetition(text):
    raw = data(text)
    words = WORD.findall(raw)
    windows = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    inside = {j for k in range(len(words) - 4) if windows[tuple(words[k:k + 5])] > 1 for j in range(k, k + 5)}
    lines, seen = 0, set()
    for line in raw.split(b"\n"):
        lines += line in seen and bool(WORD.search(line))
        seen.add(line)
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return (len(words), sum(len(w.decode()) for w in words), sum(c in b"#*$%&|<>" for c in raw), lines, len(inside), failed)


def verdict(text):
    """Base rules and repetition coverage, word by word."""
    words = [w.decode() for w in WORD.findall(data(text))]
    total = max(1, sum(map(len, words)))
    if repetition(text)[-1]:
        return False
    for n, limit in {5: 150, 6: 145, 7: 140, 8: 135, 9: 130, 10: 125}.items():
        seen, inside = set(), set()
        for k in range(len(words) - n + 1):
            gram = tuple(words[k:k + n])
            if gram in seen:
                inside.update(range(k, k + n))
            seen.add(gram)
        if 1000 * sum(len(words[k]) for k in inside) // total > limit:
            return False
    seen, again = set(), 0
    for line in data(text).split(b"\n"):
        if line in seen:
            again += sum(len(w.decode()) for w in WORD.findall(line))
        seen.add(line)
    return 1000 * again // total <= 200


ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def masked(text):
    spans = [m.span() for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    out, at = "", 0
    for a, b in sorted(spans):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]
