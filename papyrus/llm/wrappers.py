"""HTML extraction with inferred wrappers.

Pages of one host come from few templates.  The token stream of a page (tags
and texts) is read as a union-free regular expression: a sequence of tags,
each with the expression of its content, of texts and of repeated groups.  Two
expressions are aligned; equal items stay, items of one side only become
optional, repeats in a row become repeated groups, and texts that differ
become slots.  Aligning all pages of a host one after the other gives its
wrapper: tasks align the pages they read, partial wrappers of a host are
aligned in two further steps.

The wrapper tells where the article is: of the text outside links and page
furniture, what differs between the host's pages (its slots) weighs, and what all of
them repeat does not; where nothing differs, as on a host of one page, all of it
weighs.  Elements marked as the article are taken if they hold half of that weight,
or else the innermost element that holds most of it.  A page's main text is the text of these elements
without furniture inside them, block by block; a page that none of its host's
elements matches is read by the wrapper of that page alone.

Furniture is told by element, role, or a whole name of class or id.  A word
inside a longer name (``site-footer``) only tells it for an element with a
minor share of the text and without a main heading or article.  Where all text
is furniture, an article inside it or else the whole body is read.

Defined results: a null or empty page has an empty text; pages whose url is
null or has no host form one group; repeated rows and null ids pass through;
an empty table gives an empty result; other columns are not read.  Elements nested
deeper than ``DEPTH`` count as content of the one at that depth, as in browsers; no
text is lost.  Tags that never end are text.  Siblings are aligned by a longest common
subsequence where they are few; long lists are cut at items that are unique in both
first, and what is still long is matched from left to right.
"""

from __future__ import annotations

import bisect
import html
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrus.llm import texts as X
from papyrus.session import cut_lineage

# Fixed values of HTML: elements without content, raw-text elements, blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp".split())
BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section
summary table tbody td tfoot th thead tr ul""".split())
#: An open element of these names ends where one of the others begins.
CLOSED_BY = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
             "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
             "option": {"option", "optgroup"}, "head": {"body"}}
SCOPE = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}

# Names of page furniture: elements, ARIA roles, words of class and id.
FURNITURE = set("""nav footer aside form script style noscript template iframe button select option textarea input svg
canvas menu dialog head title object embed audio video""".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
WORDS = set("""ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion
sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice
notices popup modal overlay newsletter subscribe subscription share sharing social related recommended comments comment
reply replies respond disqus widget widgets toolbar pagination pager login signin signup search skip""".split())
#: Names that mark the article itself.
MAIN_ROLES = {"main", "article"}
MAIN_WORDS = {"articlebody"}
#: Never furniture, whatever their names.
KEPT = {"html", "body", "main", "article"}
#: A word inside a longer name tells furniture below one part in so many of the text; the article
#: is all in one element if no other has one part in so many of its text.
HINT = 4

#: A tag ends before the next ``<`` outside quotes, or is none.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:"[^"]*"|'[^']*'|[^'"<>])*+)>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in RAW}


@dataclass
class Node:
    name: str
    sign: str  # name, and the names of class, id and role without digits
    kids: list = field(default_factory=list)  # Node or str


def _sign(name: str, raw: str) -> str:
    if "=" not in raw:
        return name
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(raw)}
    words = [f"{key[0]}:{w}" for key in ("class", "id", "role", "itemprop")
             for w in sorted({re.sub(r"[^a-z_-]+", "", w) for w in found.get(key, "").lower().split()} - {""})]
    return " ".join([name, *words])


#: Levels of the tree, as browsers limit them too.
DEPTH = 150


class Path:
    """The open elements, and how many of each name."""

    def __init__(self, root: Node):
        self.nodes = [root]
        self.names = [""]
        self.open: Counter = Counter()

    def push(self, name: str, node: Node) -> None:
        """Beyond the depth, the deepest element takes the content."""
        self.nodes.append(node if len(self.nodes) < DEPTH else self.nodes[-1])
        self.names.append(name)
        self.open[name] += 1

    def cut(self, at: int) -> None:
        for name in self.names[at:]:
            self.open[name] -= 1
        del self.nodes[at:], self.names[at:]

    def close(self, name: str) -> None:
        """The end of ``name``: up to the innermost open one; the end of an
        inline element goes over no block."""
        if not self.open[name]:
            return
        for k in range(len(self.names) - 1, 0, -1):
            if self.names[k] == name:
                return self.cut(k)
            if name not in BLOCK and self.names[k] in BLOCK:
                return None

    def close_for(self, name: str) -> None:
        """Close the elements that the start of ``name`` ends."""
        while any(self.open[held] for held in _CLOSES.get(name, ())):
            for k in range(len(self.names) - 1, 0, -1):
                held = self.names[k]
                if name in CLOSED_BY.get(held, ()):
                    self.cut(k)
                    break
                if held in SCOPE.get(name, ()) or held in BLOCK and held not in CLOSED_BY:
                    return
            else:
                return


_CLOSES: dict[str, list[str]] = {}
for _held, _names in CLOSED_BY.items():
    for _name in _names:
        _CLOSES.setdefault(_name, []).append(_held)


def parse(page: str) -> Node:
    """The tree of a page; open ends are closed as HTML does."""
    root = Node("", "")
    path = Path(root)
    endless: set[str] = set()
    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            text = page[at:m.start() if m else len(page)]
            path.nodes[-1].kids.append(html.unescape(text))
            if m is None:
                break
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            path.close(name)
            continue
        path.close_for(name)
        node = Node(name, _sign(name, m.group(3)))
        if len(path.nodes) <= DEPTH:
            path.nodes[-1].kids.append(node)
        if name in RAW:
            end = None if name in endless else _RAW_END[name].search(page, at)
            if end is None:
                endless.add(name)
                if name not in ("script", "style"):
                    continue
            if name == "title":
                node.kids.append(html.unescape(page[at:end.start() if end else len(page)]))
            at = end.end() if end else len(page)
        elif name not in VOID and not m.group(3).endswith("/"):
            path.push(name, node)
    return root


def is_furniture(sign: str) -> bool:
    name, *words = sign.split(" ")
    return name not in KEPT and (name in FURNITURE or any(
        (w[2:] in ROLES) if w[0] == "r" else (w[0] in "ci" and w[2:] in WORDS) for w in words))


def is_hinted(sign: str) -> bool:
    """Whether a longer name has a word of furniture in it."""
    name, *words = sign.split(" ")
    return name not in KEPT and any(w[0] in "ci" and not WORDS.isdisjoint(re.split("[_-]+", w[2:])) for w in words)


def is_main(sign: str) -> bool:
    name, *words = sign.split(" ")
    return name in ("article", "main") or any(
        (w[0] == "r" and w[2:] in MAIN_ROLES) or (w[0] == "i" and not MAIN_WORDS.isdisjoint(re.split("[_-]+", w[2:])))
        for w in words)


def is_kept(sign: str) -> bool:
    """Whether what holds it is no furniture by a word inside a name."""
    return is_main(sign) or sign.split(" ")[0] == "h1"


# -------------------------------------------------------------- expressions
#
# An item is a list [kind, key, many, maybe, weight, content]: kind "t" (tag,
# key its sign), "x" (text, key its digest, or None for a slot) or "g"
# (repeated group).  ``many`` and ``maybe`` are 0 or 1 for + and ?, ``weight``
# the characters of the text in it, ``content`` a list of items.

def _key(item: list) -> tuple:
    """Items of one key may stand for one another."""
    if item[0] == "x":
        return ("x",)
    return ("t", item[1]) if item[0] == "t" else ("g", *map(_key, item[5]))


def _merge(a: list, b: list) -> list:
    """One item for both; texts that differ become a slot."""
    key = a[1] if a[1] == b[1] else None
    return [a[0], key, a[2] | b[2], a[3] | b[3], a[4] + b[4], align(a[5], b[5])]


#: Cells of the table of a longest common subsequence.
TABLE = 1 << 18
#: Items that the left-to-right match of long lists goes over at most.
AHEAD = 64


def _table(p: list, q: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence."""
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(q) - 1, -1, -1):
            row[j] = 1 + below[j + 1] if p[i] == q[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(p) and j < len(q):
        if p[i] == q[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, in order of the first, whose seconds rise."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect.bisect_left(tops, j)
        before[k] = ends[at - 1] if at else -1
        tops[at:at + 1], ends[at:at + 1] = [j], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def _common(p: list, q: list) -> list[tuple[int, int]]:
    """Places of a common subsequence of two lists of keys."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(p), 0, len(q))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and p[a] == q[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and p[b - 1] == q[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if (b - a) * (d - c) <= TABLE:
            found += [(a + i, c + j) for i, j in _table(p[a:b], q[c:d])]
            continue
        left, right = Counter(p[a:b]), Counter(q[c:d])
        place = {q[j]: j for j in range(c, d) if right[q[j]] == 1}
        fixed = _rising([(i, place[p[i]]) for i in range(a, b) if left[p[i]] == 1 and p[i] in place])
        if fixed:
            found += fixed
            edges = [(a - 1, c - 1), *fixed, (b, d)]
            todo += [(i + 1, k, j + 1, n) for (i, j), (k, n) in zip(edges, edges[1:])]
            continue
        places: dict[tuple, list[int]] = {}
        for j in range(c, d):
            places.setdefault(q[j], []).append(j)
        at = c
        for i in range(a, b):
            where = places.get(p[i], ())
            k = bisect.bisect_left(where, at)
            if k < len(where) and where[k] - at <= AHEAD:
                found.append((i, where[k]))
                at = where[k] + 1
    return sorted(found)


def align(a: list, b: list) -> list:
    """One expression for both: a common subsequence stays, the rest becomes
    optional."""
    if not a or not b or a is b:
        return [[*i[:3], 1, *i[4:]] for i in a or b] if a is not b else a
    out: list = []
    i = j = 0
    for m, n in [*_common(list(map(_key, a)), list(map(_key, b))), (len(a), len(b))]:
        out += [[*x[:3], 1, *x[4:]] for x in (*a[i:m], *b[j:n])]
        if m < len(a):
            out.append(_merge(a[m], b[n]))
        i, j = m + 1, n + 1
    return fold(out)


def fold(items: list) -> list:
    """Repeats in a row become one repeated item or group, however long: the
    last items are held against those up to the last item of the same key, and
    against the content of the last group."""
    out: list = []
    keys: list = []
    last: dict[tuple, int] = {}

    def put(item: list, key: tuple) -> None:
        last[key] = len(out)
        out.append(item)
        keys.append(key)

    def drop(n: int) -> list:
        gone = out[len(out) - n:]
        del out[len(out) - n:], keys[len(keys) - n:]
        return gone

    group = -1
    for item in items:
        key = _key(item)
        before = last.get(key, -1)
        before = before if before < len(out) and before >= 0 and keys[before] == key else -1
        put(item, key)
        if item[0] == "g":
            group = len(out) - 1
        n = len(out) - 1 - before if before >= 0 else 0
        if n and not (n == 1 and item[0] == "x") and 2 * n <= len(out) and keys[-n:] == keys[-2 * n:-n]:
            second, first = drop(n), drop(n)
            both = [_merge(x, y) for x, y in zip(first, second, strict=True)]
            if n == 1:
                both[0][2] = 1
                put(both[0], key)
            else:
                made = ["g", None, 1, 0, sum(i[4] for i in both), both]
                put(made, _key(made))
                group = len(out) - 1
            continue
        if 0 <= group < len(out) - 1 and out[group][0] == "g":
            n = len(out) - 1 - group
            if len(out[group][5]) == n and keys[group][1:] == tuple(keys[-n:]):
                tail = drop(n)
                held = drop(1)[0]
                made = ["g", None, 1, held[3], held[4] + sum(i[4] for i in tail), [_merge(x, y) for x, y in zip(held[5], tail, strict=True)]]
                put(made, _key(made))
                group = len(out) - 1
    return out


def expression(node: Node) -> list:
    """The expression of a node's content."""
    items = []
    for kid in node.kids:
        if isinstance(kid, str):
            text = " ".join(kid.split())
            if text:
                items.append(["x", hash_text(text), 0, 0, len(text), []])
        else:
            content = expression(kid)
            items.append(["t", kid.sign, 0, 0, sum(i[4] for i in content), content])
    return fold(items)


def hash_text(text: str) -> str:
    return X.sha256(text.encode("utf-8", "replace"))[:16]


# ------------------------------------------------------------------ regions

def regions(wrapper: list) -> list[list[str]]:
    """Paths (signs from the root) of the elements that hold the article."""
    whole = sum(map(_plain, wrapper))
    slots = any(_plain(i, whole, True) for i in wrapper)

    def weigh(items: list) -> int:
        return sum(_plain(i, whole, slots) for i in items)

    def look(items: list, path: list[str], through: bool) -> list[tuple[list[str], list]]:
        """The marked elements, inside furniture too if ``through``."""
        out = []
        for item in items:
            if item[0] == "g":
                out += look(item[5], path, through)
            elif item[0] == "t" and (through or not _is_cut(item, whole)):
                here = [*path, item[1]]
                inner = look(item[5], here, through)  # an article inside main goes first
                out += inner or ([(here, item)] if is_main(item[1]) else [])
        return out

    marked = look(wrapper, [], False)
    if marked and 2 * sum(weigh(item[5]) for _, item in marked) >= weigh(wrapper):
        return [path for path, _ in marked]
    # a cell that holds most of what differs is one of a table for layout
    leaves = _LEAVES - {"table", "td"} if slots else _LEAVES
    path: list[str] = []
    items = wrapper
    while True:
        flat = list(_tags(items))
        weights = [(weigh([i]), i) for i in flat if i[0] == "t" and i[1].split(" ")[0] not in _INLINE]
        here = weigh(flat)
        best = max(weights, key=lambda w: w[0], default=(0, None))
        if best[1] is None or not best[0] or 10 * best[0] < 6 * here or best[1][1].split(" ")[0] in leaves:
            break
        if any(HINT * w >= best[0] for w, i in weights if i is not best[1]):  # the article may stand in several
            break
        path = [*path, best[1][1]]
        items = best[1][5]
    hidden = look(wrapper, [], True)
    if not marked and sum(_plain(i) for _, item in hidden for i in item[5]) > sum(_plain(i, whole) for i in _tags(items)):
        return [path for path, _ in hidden]
    return [path]


_INLINE = set("a abbr b bdi bdo cite code em font i kbd mark q s small span strong sub sup tt u".split())
_LEAVES = set("p h1 h2 h3 h4 h5 h6 li pre blockquote td th dt dd table ul ol dl".split())


def _tags(items: list) -> Iterator[list]:
    for item in items:
        if item[0] == "g":
            yield from _tags(item[5])
        else:
            yield item


def _plain(item: list, whole: int = 0, slots: bool = False) -> int:
    """Characters outside links and furniture, or only those of ``slots``;
    ``whole`` are those of the page, where hints count."""
    if item[0] == "x":
        return item[4] if not slots or item[1] is None else 0
    if item[0] == "t" and (item[1].split(" ")[0] in ("a", "header") or _is_cut(item, whole)):
        return 0
    return sum(_plain(i, whole, slots) for i in item[5])


def _is_cut(item: list, whole: int) -> bool:
    return is_furniture(item[1]) or (is_hinted(item[1]) and HINT * sum(map(_plain, item[5])) < whole
                                     and not any(map(_keeps, item[5])))


def _keeps(item: list) -> bool:
    return item[0] == "t" and is_kept(item[1]) or any(map(_keeps, item[5]))


def _size(node: Node) -> int:
    """Characters of a node outside furniture."""
    return sum(len(" ".join(k.split())) if isinstance(k, str) else 0 if is_furniture(k.sign) else _size(k) for k in node.kids)


def _node_keeps(node: Node) -> bool:
    return any(not isinstance(k, str) and (is_kept(k.sign) or _node_keeps(k)) for k in node.kids)


def blocks(node: Node, names: bool = True) -> Iterator[str]:
    """The texts of a node's blocks in page order, furniture left out; without
    ``names`` only what is furniture by its element, forms not among it."""
    held: list[str] = []
    whole = -1

    def is_cut(kid: Node) -> bool:
        nonlocal whole
        if not names:
            return kid.name in FURNITURE and kid.name != "form"
        if is_furniture(kid.sign) or not is_hinted(kid.sign):
            return is_furniture(kid.sign)
        if whole < 0:
            whole = _size(node)
        return HINT * _size(kid) < whole and not _node_keeps(kid)

    def done() -> Iterator[str]:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            yield text

    def walk(node: Node) -> Iterator[str]:
        for kid in node.kids:
            if isinstance(kid, str):
                held.append(kid)
            elif kid.name == "br":
                held.append(" ")
            elif is_cut(kid):
                if kid.name in BLOCK:
                    yield from done()
            elif kid.name in BLOCK:
                yield from done()
                yield from walk(kid)
                yield from done()
            else:
                yield from walk(kid)

    yield from walk(node)
    yield from done()


def main_text(page: str, where: list[list[str]] | None) -> str:
    """The article of a page by the paths of its host's wrapper, or by its
    own where none of them occurs; the whole body where neither has text
    outside furniture."""
    root = parse(page)
    own = None
    for paths in (where, None):
        if paths is None:
            own = expression(root)
            paths = regions(own)
        found: list[Node] = []

        def look(node: Node, path: list[str]) -> None:
            if path in paths:
                found.append(node)
            else:
                for kid in node.kids:
                    if not isinstance(kid, str) and any(p[:len(path) + 1] == [*path, kid.sign] for p in paths):
                        look(kid, [*path, kid.sign])

        look(root, [])
        if found or own is not None:
            text = "\n".join(b for node in found for b in blocks(node))
            if text or paths != [[]]:
                return text
    return "\n".join(blocks(root, names=False))


# -------------------------------------------------------------------- spark

#: Hosts whose wrappers a task holds before it sends them on.
HOSTS = 1 << 11
SPREAD = 32
_PARTIAL = "host string, slot int, wrapper string"


def host_of(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper): the wrapper of each host as JSON, over all its pages."""
    def part(batches):
        held: dict[str, list] = {}

        def out():
            made = [(h, json.dumps(w)) for h, w in held.items()]
            rows = [(h, zlib.crc32(w.encode()) % SPREAD, w) for h, w in made]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))],
                names=["host", "slot", "wrapper"])

        for piece in X.slices(batches, 1):
            for host, page in zip(piece.column(0).to_pylist(), X.as_bytes(piece.column(1)), strict=True):
                made = expression(parse(page.decode("utf-8", "replace")))
                held[host] = align(held[host], made) if host in held else made
                if len(held) >= HOSTS:
                    yield out()
        if held:
            yield out()

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        made = None
        for text in sorted(frame["wrapper"]):
            made = json.loads(text) if made is None else align(made, json.loads(text))
        return pd.DataFrame({"host": frame["host"][:1], "slot": frame["slot"][:1], "wrapper": [json.dumps(made)]})

    read = pages.select(host_of(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))
    partial = read.mapInArrow(part, _PARTIAL)
    half = partial.groupBy("host", "slot").applyInPandas(whole, _PARTIAL)
    return half.groupBy("host").applyInPandas(whole, _PARTIAL).select("host", "wrapper")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text): the main text of every page."""
    def places(frames):
        for frame in frames:
            frame["paths"] = [json.dumps(regions(json.loads(w))) for w in frame.pop("wrapper")]
            yield frame

    # written, so that the planner knows its size: pages are shuffled only where there are very many hosts
    places_of = cut_lineage(infer(pages, url_col, html_col).mapInPandas(places, "host string, paths string"))
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                         F.col(html_col).cast("string").alias("html"), host_of(url_col).alias("host"))
    both = named.join(places_of, "host", "left").select("id", "url", "html", "paths")
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType, True),
                           T.StructField(url_col, pages.schema[url_col].dataType, True), X.field("text", "string")])

    def run(batches):
        known: dict[str, list] = {}
        for piece in X.slices(batches, 2):
            made = []
            for page, paths in zip(X.as_bytes(piece.column(2)), piece.column(3).to_pylist(), strict=True):
                if paths not in known:
                    if len(known) >= HOSTS:
                        known.clear()
                    known[paths] = None if paths is None else json.loads(paths)
                made.append(main_text(page.decode("utf-8", "replace"), known[paths]))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(made, pa.string())], names=schema.names)

    return both.mapInArrow(run, schema)
