"""HTML extraction by minimum cut: block labels from a classifier's costs, smoothed along the page and the DOM.

The page is cut into blocks of text at block-level tags. A logistic classifier gives
each block its log odds of being content, from its text (length, link density,
punctuation, place), its element and what its element's parents hold, and the kind of
landmark that it lies in (article, nav, class names and so on; their weights are
learnt like all others). These log odds are the capacities to source and sink. Edges
join following blocks, weaker with their distance in the DOM, and the next block of the
same parent; an edge across a landmark's border has a BORDER of its weight. The minimum
cut is unique up to zero costs: blocks whose own cost outweighs their edges are settled
first, which is exact, and the rest goes through Dinic's max-flow.

The classifier is trained on a bounded sample of pages, their own <article> and
<main> being the labels. Every page is learnt from twice, once without its landmarks,
so that the text has to carry what it can and landmarks weigh the rest only; pages
without landmarks are then told by text, elements and the cut.

Cases: null and empty pages, and pages without text, give an empty text. Broken
markup is read as far as it goes: unclosed tags end with their parent (skipped ones,
such as button, too), an unclosed comment or script with the page, a lone '<' is text.
Very long pages are read whole. Equal pages, whether rows repeat or not, give equal
rows; blocks whose costs are zero are no content. An empty table gives an empty one.
Without a page that has an article the weights are fixed ones. Other columns, whatever
their names, don't matter.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

SAMPLE_PAGES = 1_000
NEAR, SIBLING, BORDER = 1.5, 0.75, 0.2
FEATURES = 24
#: Weights before anything is learnt, and where no page has an article to learn from: length, links and a sentence's end, and a landmark's kinds.
FIXED = [-2.0, 0.6, -3.0, 1.0, *[0.0] * 6, *[0.0] * 11, -6.0, 5.0, 2.5]
#: How much learning holds on to them: landmarks that the sample's pages lack keep their weight.
RIDGE = [*[1e-3] * (FEATURES - 3), *[0.1] * 3]

_TOKEN = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z))", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_words = lambda s: frozenset(s.split())
VOID = _words("area base br col embed hr img input link meta param source track wbr")
SKIP = _words("script style noscript template svg iframe object canvas head title audio video map datalist select textarea button")
RAW = _words("script style textarea title noscript iframe template svg")
INLINE = _words("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img")
CLOSES = {"li": _words("li"), "p": _words("p"), "dt": _words("dt dd"), "dd": _words("dt dd"), "tr": _words("tr td th"), "td": _words("td th"), "th": _words("td th"), "option": _words("option")}
BOUND = _words("ul ol table tbody thead div section article main body dl nav aside header footer form tr")
ENDS_P = _words("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul")
#: Landmarks: +1 content, -1 boilerplate.
TAGS = {"article": 1, "main": 1, "nav": -1, "aside": -1, "footer": -1, "header": -1, "form": -1, "menu": -1, "dialog": -1}
BOILER = _words(
    "ad ads adv advert advertisement adverts banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments reply replies disqus respond share sharing social related recommended "
    "recommendations pagination pager widget toolbar copyright legal search skip toc tags complementary contentinfo dialog"
)
GOOD = _words("article content post entry story main body articlebody text")
_HEADS = _words("h1 h2 h3 h4 h5 h6")


class Element:
    __slots__ = ("depth", "holds", "parent", "tag", "words")

    def __init__(self, tag: str, parent: Element | None, attributes: str):
        self.tag, self.parent, self.depth, self.holds = tag, parent, parent.depth + 1 if parent else 0, False
        self.words: frozenset = frozenset()
        if attributes and tag not in ("html", "body"):
            found = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes))
            if found:
                self.words = frozenset(_SPLIT.split(found.lower()))


class Block:
    __slots__ = ("element", "heading", "linked", "text")

    def __init__(self, element: Element, text: str, linked: int, heading: bool):
        self.element, self.text, self.linked, self.heading = element, text, linked, heading


def blocks(page: str | None) -> list[Block]:
    """The blocks of text of a page, in its order; what lies in SKIP elements isn't text."""
    root = Element("html", None, "")
    stack, out, parts, linked, links, skip = [root], [], [], 0, 0, None
    page, at = page or "", 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and skip is None:
            piece = html.unescape(piece)
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    def flush() -> None:
        nonlocal parts, linked
        whole = " ".join("".join(parts).split())
        if whole:
            own = next(e for e in reversed(stack) if e.tag not in INLINE)
            out.append(Block(own, whole, min(linked, len(whole)), any(e.tag in _HEADS for e in stack[-4:])))
        parts, linked = [], 0

    def pop_to(n: int) -> None:
        nonlocal links
        for e in stack[n:]:
            links -= e.tag == "a"
        del stack[n:]

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = _TOKEN.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(m.group(1)), m.group(3)
        if tag in ("html", "body") and closing:
            flush()
            continue
        if skip is not None:
            if closing and tag == skip:
                skip = None
                continue
            if skip in RAW or not (closing and any(e.tag == tag for e in stack) or not closing and (tag in TAGS or tag in _HEADS)):
                continue
            skip = None  # it was never closed: its parent ends, or a landmark or heading begins
        if closing:
            if tag not in INLINE:
                flush()
            for n in range(len(stack) - 1, 0, -1):
                if stack[n].tag == tag:
                    pop_to(n)
                    break
                if tag in INLINE and stack[n].tag not in INLINE:
                    break  # an inline tag doesn't close a block
            continue
        if tag in SKIP and tag != "head":
            if tag not in INLINE and tag != "button":
                flush()
            if attributes.rstrip().endswith("/"):
                continue
            skip = tag
            if tag in RAW:  # its content is no markup
                end = re.compile(rf"</{re.escape(tag)}\b", re.I).search(page, at)
                at = end.start() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            if tag in ENDS_P:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag == "p":
                        pop_to(n)
                        break
                    if stack[n].tag not in INLINE:
                        break
            ends = CLOSES.get(tag)
            if ends:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n].tag in ends:
                        pop_to(n)
                        break
                    if stack[n].tag in BOUND and not (tag in ("td", "th", "tr") and stack[n].tag == "tr"):
                        break
        if attributes.rstrip().endswith("/") and tag not in INLINE:
            continue
        e = Element(tag, stack[-1], attributes)
        stack.append(e)
        links += tag == "a"
        if tag in ("h1", "main"):
            up = e.parent
            while up is not None and not up.holds:
                up.holds = True
                up = up.parent
    flush()
    return out


def landmark(e: Element) -> tuple[int, Element | None]:
    """What a block in e lies in, and the element that decides: -1 a landmark of boilerplate, 2 an article, 1 an element named like content, 0 none."""
    good, article = (0, None), False
    chain = []
    while e is not None:
        chain.append(e)
        e = e.parent
    for e in chain:  # from inside out
        kind = TAGS.get(e.tag, 0)
        if e.words & BOILER and not e.holds and e.tag not in ("p", *_HEADS):
            return -1, e
        inside = e.tag == "header" and any(TAGS.get(x.tag) == 1 for x in chain)  # an article's own header
        wraps = e.tag == "form" and (article or e.holds)  # a form around the whole page
        if kind < 0 and not inside and not wraps:
            return -1, e
        if kind > 0 and not article:
            article, good = True, (2, e)
        elif not article and not good[1] and e.words & GOOD:
            good = (1, e)
    return good


def features(own: list[Block], kinds: list[int]) -> np.ndarray:
    """blocks x FEATURES: of the text, its neighbours, its element and the elements around it; the last three say what kind of landmark it lies in."""
    length, linked, held = [len(b.text) for b in own], [b.linked for b in own], {}
    for b, n, k in zip(own, length, linked, strict=True):
        e, seen = b.element, 0
        while e is not None and seen < 3:
            x = held.setdefault(id(e), [0, 0, 0])
            x[0], x[1], x[2] = x[0] + n, x[1] + k, x[2] + 1
            e, seen = e.parent, seen + 1
    total, rows = sum(length), []
    for i, b in enumerate(own):
        n, tag, around = length[i], b.element.tag, [j for j in (i - 1, i + 1) if 0 <= j < len(own)]
        up = b.element.parent or b.element
        parent, grand = held[id(up)], held.get(id(up.parent), held[id(up)])
        rows.append(
            (
                1.0, np.log1p(n), linked[i] / n, float(b.text[-1] in ".!?\"\u201d\u00bb\u2026"), np.log1p(sum(length[j] for j in around)), sum(map(b.text.count, ",.;:")) / n * 10, abs(i / max(1, len(own) - 1) - 0.5),
                max((linked[j] / length[j] for j in around), default=0.0), sum(length[j] > 80 for j in around) / 2, float(b.heading), float(tag == "p"), float(tag in ("li", "dd", "dt")), float(tag in ("td", "th")), float(tag in ("div", "section")),
                np.log1p(parent[0]), parent[1] / max(1, parent[0]), parent[0] / total, np.log1p(parent[2]), parent[1] / max(1, parent[0]) * (tag == "li"), grand[1] / max(1, grand[0]), grand[0] / total,
                float(kinds[i] < 0), float(kinds[i] == 2), float(kinds[i] == 1),
            )
        )
    return np.array(rows).reshape(-1, FEATURES)


def train(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method on pages with and without their landmarks, with both labels weighing the same; FIXED if one is missing."""
    if not len(y) or y.min() == y.max():
        return np.array(FIXED)
    bare = x.copy()
    bare[:, -3:] = 0
    x, y = np.concatenate([x, bare]), np.concatenate([y, y])
    side, w, prior = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y), np.zeros(FEATURES), np.array(FIXED)
    prior[:-3] = 0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (side * p * (1 - p))[:, None]).T @ x + np.diag(RIDGE), x.T @ (side * (p - y)) + RIDGE * (w - prior))
    return w


def cut(net: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side: minimises the sum of -net over it plus the edges cut."""
    n = len(net)
    net, beside, label = list(net), [{} for _ in range(n)], [None] * n
    for a, b, w in edges:
        beside[a][b] = beside[a].get(b, 0.0) + w
        beside[b][a] = beside[b].get(a, 0.0) + w
    queue = deque(range(n))
    while queue:  # a node that outweighs all its edges is settled, and pulls its neighbours
        a = queue.popleft()
        if label[a] is None and abs(net[a]) >= sum(beside[a].values()):
            label[a] = net[a] > 0
            for b, w in beside[a].items():
                del beside[b][a]
                if label[b] is None:
                    net[b] += w if label[a] else -w
                    queue.append(b)
            beside[a] = {}
    left = [a for a in range(n) if label[a] is None]
    if left:
        for a, side in zip(left, _dinic(left, net, beside), strict=True):
            label[a] = side
    return label


def _dinic(left: list[int], net: list[float], beside: list[dict]) -> list[bool]:
    at = {a: i for i, a in enumerate(left)}
    s, t = len(left), len(left) + 1
    graph: list[list[int]] = [[] for _ in range(t + 1)]
    to, cap = [], []

    def edge(a: int, b: int, w: float, back: float) -> None:
        graph[a].append(len(to))
        graph[b].append(len(to) + 1)
        to.extend((b, a))
        cap.extend((w, back))

    for a in left:
        if net[a] > 0:
            edge(s, at[a], net[a], 0.0)
        elif net[a] < 0:
            edge(at[a], t, -net[a], 0.0)
        for b, w in beside[a].items():
            if a < b:
                edge(at[a], at[b], w, w)
    while True:
        level = [-1] * (t + 1)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(len(left))]
        nexts, path, u = [0] * (t + 1), [], s
        while True:  # blocking flow by an explicit stack
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while nexts[u] < len(graph[u]):
                e = graph[u][nexts[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                nexts[u] += 1
            if nexts[u] < len(graph[u]):
                path.append(graph[u][nexts[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                e = path.pop()
                u = to[e ^ 1]
                nexts[u] += 1


def _distance(a: Element, b: Element) -> int:
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def graph(own: list[Block], w: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Net costs and edges of a page's blocks."""
    marks = [landmark(b.element) for b in own]
    net = np.clip(features(own, [m[0] for m in marks]) @ w, -50, 50).tolist()
    edges, last = [], {}
    weight = lambda a, b, x: x if marks[a][1] is marks[b][1] else x * BORDER
    for i, b in enumerate(own):
        if i:
            edges.append((i - 1, i, weight(i - 1, i, NEAR / max(1, _distance(own[i - 1].element, b.element) - 1))))
        up = id(b.element.parent)
        if up in last and last[up] != i - 1:
            edges.append((last[up], i, weight(last[up], i, SIBLING)))
        last[up] = i
    return net, edges


def labels(own: list[Block], w: np.ndarray) -> list[bool]:
    return cut(*graph(own, w)) if own else []


def main_text(page: str | None, w: np.ndarray) -> str:
    own = blocks(page)
    return " ".join(b.text for b, keep in zip(own, labels(own, w), strict=True) if keep)


def fit(pages: DataFrame) -> np.ndarray:
    """Weights of the text classifier from at most SAMPLE_PAGES pages, those with the least hash."""
    ids = pages.select(F.col("page_id").cast("long").alias("page_id")).dropna().distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE_PAGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys, ids = [], [], []
            for page_id, page in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist(), strict=True):
                own = blocks(page)
                marks = [landmark(x.element) for x in own]
                if any(m[0] == 2 for m in marks):
                    ids.append(page_id)
                    xs.append(features(own, [m[0] for m in marks]).ravel().tolist())
                    ys.append([m[0] > 0 for m in marks])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(xs, pa.list_(pa.float64())), pa.array(ys, pa.list_(pa.bool_()))], names=["page_id", "x", "y"])

    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).join(F.broadcast(ids), "page_id")
    got = some.mapInArrow(run, "page_id long, x array<double>, y array<boolean>").groupBy("page_id").agg(F.min(F.struct("x", "y")).alias("r")).orderBy("page_id").select("r.*").toArrow()
    x = np.array([v for r in got.column("x").to_pylist() for v in r]).reshape(-1, FEATURES)
    return train(x, np.array([float(v) for r in got.column("y").to_pylist() for v in r]))


def extract(pages: DataFrame, w: np.ndarray) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(page, w) for page in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = C.table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
