"""Main text of web pages by a minimum cut between content and boilerplate.

A page is a row of text blocks. A logistic classifier over what surrounds and
fills a block gives its two costs, which are its capacities to the two terminals;
neighbouring blocks, and more so those of one parent or near it in the tree, are
tied by smoothness edges. The maximum flow separates the cheapest labelling. Blocks
whose own evidence outweighs all their edges keep their label in any minimum cut;
they are settled first and only the others go into the flow.

The classifier is fitted on a hash sample of about ``SAMPLE`` pages: blocks that
the markup itself places (``article`` or ``main``; ``nav``, ``footer`` and the
like) are its examples, and its weights stay close to prior ones, so cues that no
sampled page has keep their prior.

What is never text (scripts, styles, forms' controls, comments in the markup) is
left out before. A null or empty page, or one without content, gives an empty
text. Inside a content element a name that content bears too (``related``, ``discussion``)
tells nothing by itself. Pages are read whole, in time linear in their length; unclosed or misplaced tags close with what encloses
them. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, column_map

SAMPLE = 400
#: Strength of ties between neighbouring blocks: any, of one parent, and per step apart.
TIE, KIN, FADE = 0.3, 0.9, 0.5

# Names of the standard and of common practice (fixed values).
UNSEEN = frozenset("script style noscript template svg annotation annotation-xml iframe object canvas head select textarea button datalist audio video map".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "math semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
AWAY_TAGS = frozenset("nav footer aside header form menu dialog fieldset".split())
AWAY_WORDS = frozenset(
    "nav navbar navigation menu sidebar side footer header masthead banner ad ads advert adverts advertisement sponsor sponsored promo cookie cookies consent notice "
    "notices popup modal overlay newsletter subscribe signup login comment comments discussion respond replies reply disqus share sharing social related recommended "
    "breadcrumb breadcrumbs pagination pager widget toolbar skip legal copyright disclaimer tags toc search form".split()
)
# Of these, those that an article's own sections and paragraphs also bear.
MAYBE_WORDS = frozenset("discussion related search form legal notice notices side overlay menu share tags toc reply header footer banner".split())
AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HOME_TAGS = frozenset(("article", "main"))
HOME_WORDS = frozenset("article content main body post entry story text prose".split())

# A quoted value begins behind an equals sign; possessive repeats keep a page without
# closing brackets or quotes linear.
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/><]*+)((?:=\s*+"[^"]*"|=\s*+'[^']*'|[^>])*+)>""", re.S
)
MARK = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[a-z]+")


@dataclass
class Node:
    """An open element: what it and its ancestors say about their text."""

    tag: str
    parent: Node | None
    number: int
    depth: int
    unseen: bool = False
    away: int = 0
    home: int = 0
    sections: int = 0
    box: Node | None = None  # the nearest element that isn't inline


@dataclass
class Block:
    parent: Node
    tag: str
    parts: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join(unescape("".join(self.parts)).split())


def blocks(page: str) -> list[Block]:
    """Blocks of visible text in page order."""
    root = Node("", None, 0, 0)
    root.box = root
    opened: dict[str, list[Node]] = {}
    # Sections that never end are markup of no kind.
    ended = page.rfind("]]>") + 1
    page = page[:ended] + page[ended:].replace("<![CDATA[", "<!")
    at, out, current, links, number, place = root, [], None, 0, 0, 0
    end = len(page)
    closed = page.rfind(">")

    def say(text: str) -> None:
        nonlocal current
        if at.unseen or not text:
            return
        if current is None:
            if text.isspace():
                return
            current = Block(at.box, at.box.tag)
            out.append(current)
        current.parts.append(text)
        if links:
            current.linked += len(text)

    while place < end:
        m = TOKEN.search(page, place) if place <= closed or "<!--" in page[place:] else None
        say(page[place : m.start() if m else end])
        if m is None:
            break
        place = m.end()
        if m[1] is not None:
            say(m[1].replace("&", "&amp;"))
        if m[3] is None:
            continue
        tag = m[3].lower()
        if m[2]:
            if not opened.get(tag):
                if tag not in INLINE:
                    current = None
                continue
            node = opened[tag][-1]
            while at is not node.parent:
                links -= at.tag == "a"
                if at.tag not in INLINE:
                    current = None
                opened[at.tag].pop()
                at = at.parent
            continue
        if tag == "br":
            say(" ") if current is not None else None
            continue
        if tag not in INLINE:
            current = None
        if tag in VOID:
            continue
        # An open paragraph, list item or cell ends where the next one begins.
        if tag in CLOSES_P:
            at, links = _closed(at, ("p",), links, CLOSES_P, opened)
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            at, links = _closed(at, ("p", "li") if tag == "li" else ("p", "dt", "dd") if tag in ("dt", "dd") else ("p", "td", "th", "tr") if tag == "tr" else ("p", "td", "th"), links, frozenset(("ul", "ol", "menu", "dl", "table", "tr" if tag in ("td", "th") else "table")), opened)
        number += 1
        node = Node(tag, at, number, at.depth + 1, at.unseen or tag in UNSEEN, at.away, at.home, at.sections)
        _describe(node, tag, m[4])
        if m[4].endswith("/") and tag in ("svg", "math", "path"):
            continue
        node.box = at.box if tag in INLINE else node
        opened.setdefault(tag, []).append(node)
        at = node
        links += tag == "a"
        if tag in RAW:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, place)
            if not node.unseen:
                say(page[place : close.start() if close else end])
            place = close.start() if close else end
    return [b for b in out if b.text]


def _closed(at: Node, tags: tuple, links: int, stop: frozenset, opened: dict[str, list[Node]]) -> tuple[Node, int]:
    """Close open elements of ``tags`` that nothing in ``stop`` shields. The nearest of
    each kind is at hand, so what else is open costs nothing."""
    depth = lambda names: max((opened[t][-1].depth for t in names if opened.get(t)), default=-1)
    while (near := depth(tags)) > max(0, depth(t for t in stop if t not in tags)):
        while at.depth >= near:
            links -= at.tag == "a"
            opened[at.tag].pop()
            at = at.parent
    return at, links


def _describe(node: Node, tag: str, marks: str) -> None:
    if tag in AWAY_TAGS:
        # A header inside an article heads the article.
        node.away += tag != "header" or node.home == 0
    if tag in HOME_TAGS:
        node.home += 1
    node.sections += tag in ("section", "article")
    if not marks or marks.isspace():
        return
    for name, value in MARK.findall(marks):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            node.unseen = True
        elif name == "role":
            node.away += value in AWAY_ROLES
            node.home += value in ("main", "article")
        elif tag not in ("html", "body"):
            words = set(NAME.findall(value))
            if node.home or words & HOME_WORDS:
                words -= MAYBE_WORDS
            node.away += bool(words & AWAY_WORDS)
            node.home += bool(words & HOME_WORDS) and not words & AWAY_WORDS


# Features of a block, and prior weights in log odds for content.
PRIOR = np.array([-1.0, 3.5, -6.0, 1.0, -3.0, 0.8, 0.5, 0.3, -1.0, 0.3])


def describe(bs: list[Block]) -> np.ndarray:
    """Feature rows: constant, in a content element, in a boilerplate element,
    length, link share, closed sentences, paragraph, heading, list item, depth."""
    out = np.empty((len(bs), len(PRIOR)))
    for i, b in enumerate(bs):
        text = b.text
        n = len(text)
        out[i] = (
            1.0,
            min(b.parent.home, 2) / 2 + (b.parent.home > 0) / 2,
            min(b.parent.away, 2) / 2 + (b.parent.away > 0) / 2,
            min(n, 600) / 200,
            min(1.0, b.linked / n),
            text[-1] in ".!?\"'”»:;",
            b.tag in ("p", "blockquote", "pre", "td"),
            b.tag[:1] == "h" and b.tag[1:].isdigit(),
            b.tag in ("li", "dd", "dt"),
            min(b.parent.depth, 10) / 10,
        )
    return out


def placed(bs: list[Block]) -> np.ndarray:
    """1 and 0 where the markup says content and boilerplate, else -1."""
    return np.array([0 if b.parent.away else 1 if b.parent.home else -1 for b in bs], int)


def fit(x: np.ndarray, y: np.ndarray, hold: float = 0.05) -> np.ndarray:
    """Logistic weights, drawn to the prior ones."""
    w = PRIOR.copy()
    n = max(1, len(x))
    for _ in range(20 if len(x) else 0):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / n + hold * np.eye(len(w)), x.T @ (y - p) / n - hold * (w - PRIOR))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def ties(bs: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: from each block to the next, and to the next of its parent."""
    edges: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(bs):
        if i:
            a = bs[i - 1].parent
            edges.append((i - 1, i, TIE + KIN * FADE ** _apart(a, b.parent)))
        box = b.parent.parent if b.parent.parent is not None else b.parent
        j = last.get(box.number)
        if j is not None and j < i - 1:
            edges.append((j, i, KIN * FADE))
        last[box.number] = i
    return edges


def _apart(a: Node, b: Node) -> int:
    """Steps between two elements in the tree."""
    n = 0
    while a is not b and n < 12:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
        if a is None or b is None:
            return 12
    return n


def minimum_cut(gain: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Labels (True: content) of the least sum of costs. ``gain``: log odds."""
    n = len(gain)
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, c in edges:
        near[a].append((b, c))
        near[b].append((a, c))
    own = [float(g) for g in gain]
    slack = [sum(c for _, c in e) for e in near]
    label: list[bool | None] = [None] * n
    todo = deque(i for i in range(n) if abs(own[i]) >= slack[i])
    while todo:  # settled blocks pass their edge on to their neighbours' own evidence
        i = todo.popleft()
        if label[i] is not None or abs(own[i]) < slack[i]:
            continue
        label[i] = own[i] > 0
        for j, c in near[i]:
            if label[j] is None:
                own[j] += c if label[i] else -c
                slack[j] -= c
                if abs(own[j]) >= slack[j] - 1e-12:
                    todo.append(j)
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        _flow(rest, own, near, label)
    return np.array(label, bool)


def _flow(rest: list[int], own: list[float], near, label) -> None:
    """Maximum flow by shortest augmenting paths (level graphs) on what is open."""
    index = {v: k for k, v in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    to: list[int] = []
    room: list[float] = []
    arcs: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        arcs[a].append(len(to))
        to.append(b)
        room.append(there)
        arcs[b].append(len(to))
        to.append(a)
        room.append(back)

    for v in rest:
        if own[v] > 0:
            add(source, index[v], own[v], 0.0)
        elif own[v] < 0:
            add(index[v], sink, -own[v], 0.0)
        for u, c in near[v]:
            if u > v and u in index:
                add(index[v], index[u], c, c)
    tiny = 1e-12
    while True:
        level = {source: 0}
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in arcs[a]:
                if room[e] > tiny and to[e] not in level:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if sink not in level:
            break
        nxt = [0] * len(arcs)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= tiny)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[a] < len(arcs[a]):
                e = arcs[a][nxt[a]]
                if room[e] > tiny and level.get(to[e]) == level[a] + 1:
                    break
                nxt[a] += 1
            if nxt[a] < len(arcs[a]):
                path.append(arcs[a][nxt[a]])
                a = to[path[-1]]
            elif path:
                e = path.pop()
                a = to[e ^ 1]
                nxt[a] += 1
            else:
                break
    for v in rest:
        label[v] = index[v] in level


def main_text(page: str | None, weights: np.ndarray) -> str:
    """Content blocks of a page, joined by a blank."""
    bs = blocks(page) if page else []
    if not bs:
        return ""
    keep = minimum_cut(describe(bs) @ weights, ties(bs))
    return " ".join(b.text for b, k in zip(bs, keep) if k)


def train(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights from the blocks that the markup of a sample of pages places."""

    def rows(texts):
        out = []
        for t in texts:
            bs = blocks(t) if t else []
            y = placed(bs)
            out.append(np.hstack([y[:, None], describe(bs)])[y >= 0].ravel().tolist() if bs else [])
        return out

    some = bounded_sample(pages.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "_id", sample)
    got = some.select("_id", column_map(rows, T.ArrayType(T.DoubleType()))(F.col("_t")).alias("r")).toPandas().sort_values("_id", kind="stable")
    table = np.array([v for r in got["r"] for v in r]).reshape(-1, len(PRIOR) + 1)
    return fit(table[:, 1:], table[:, 0])


def text_column(weights: np.ndarray):
    return column_map(lambda ts: [main_text(t, weights) for t in ts], T.StringType())
