"""Main text of web pages by a minimum cut.

A page is cut into blocks: the text between two borders of block elements. A classifier gives each block log-odds of being
content, from the elements around it, the names in their class, id and role, its length, punctuation and links. It is a
logistic regression, fitted (fitted_weights) on labelled made-up pages of several layouts that are kept with the tests, and
drawn to prior weights where those pages say little; its weights are written below. The log-odds are capacities to one of two
terminals, neighbouring blocks and blocks with a common parent are joined by edges, and the minimum cut is the labelling
that minimises classifier cost plus the weight of edges between unlike labels. Blocks whose log-odds outweigh all their
edges are settled first, which leaves a small graph for the maximum flow.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html import unescape
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import prepare

#: Elements by what they mean here.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
                   "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style template noscript iframe object svg canvas audio video title textarea select button head noembed noframes datalist annotation annotation-xml".split())
FURNITURE = frozenset("nav footer aside form menu dialog fieldset".split())
ARTICLE = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES_ITSELF = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPES = frozenset("ul ol dl table article section div body main nav aside footer header form".split())
#: Elements that hold one piece of text. A name there describes that text more often than its use, so weak words say nothing
#: and others are a feature of their own, which leaves the block to its neighbours.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dt dd th td figcaption".split())
#: Parts of class, id and role names; whole words, words that say something of larger elements only, and
#: beginnings of words (those that begin no word of another meaning).
BAD_WORDS = frozenset(
    "ad ads adsbygoogle adv cta nav tos tags tagcloud related share sharing social promo promos login signup contentinfo complementary navigation search banner banners "
    "comment comments commentlist commentform commentbox commentsection footer footers footnav modal modals modalwindow respond skip skiplink skiplinks skipnav submenu menubar".split()
)
WEAK_WORDS = frozenset("menu menus discussion discussions".split())
BAD_STARTS = ("advert", "alert", "breadcrumb", "consent", "cookie", "copyright", "disclaim", "disqus", "gdpr", "masthead", "navbar", "newsletter", "notice", "notif", "overlay", "pagin", "popup", "promot", "recommend", "sidebar", "sponsor", "subscri", "toolbar", "widget")
GOOD_STARTS = ("article", "content", "entry", "main", "post", "story")
#: The classifier's features; the prior weights, and the weights that fitted_weights gives for the labelled pages.
FEATURES = ("bias", "in_article", "out_of_article", "in_furniture", "in_header", "bad_name", "text_name", "good_name", "hidden", "heading", "length", "marks", "links")
PRIOR = (-1.0, 5.0, -4.0, -14.0, -12.0, -13.0, -6.5, 1.5, -24.0, 0.5, 0.6, 0.5, -4.0)
WEIGHTS = (-0.57, 4.93, -4.00, -14.01, -12.00, -13.12, -6.20, 1.72, -24.00, 0.69, 1.31, 0.75, -4.13)
#: Weights of edges: next block, with the share of elements they have in common; next block of the same parent; and the share of
#: a weight that is left across a border of furniture. Chosen on the labelled pages: without edges 23 blocks of the 240 held-out pages are wrong, with half these weights 7, with these none.
NEXT, SIBLING, ACROSS = 1.6, 1.4, 0.4

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>""", re.S)
_SIMPLE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNSEEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none|visibility\s*:\s*hidden""", re.I)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Block:
    __slots__ = ("features", "links", "odds", "parent", "parts", "path", "text")

    def __init__(self, path: tuple, odds: float):
        self.path, self.parent, self.odds = path, path[-1] if path else 0, odds
        self.parts: list[str] = []
        self.links = 0
        self.text = ""
        self.features: tuple = ()


class _Element:
    __slots__ = ("article", "bad", "furniture", "good", "header", "heading", "hidden", "name", "number", "text_name")

    def __init__(self, name: str, attributes: str, number: int, up: _Element | None):
        bad = good = hidden = False
        if attributes:
            for _, a, b, c in _NAMES.findall(attributes):
                for word in _WORDS.findall(a or b or c):
                    word = word.lower()
                    bad = bad or word in BAD_WORDS or (word in WEAK_WORDS and name not in TEXTS) or word.startswith(BAD_STARTS)
                    good = good or word.startswith(GOOD_STARTS)
            hidden = bool(_UNSEEN.search(attributes))
        whole = name in ("html", "body")  # their names describe the page, not a part of it
        self.name, self.number = name, number
        self.article = name in ARTICLE or bool(up and up.article)
        self.furniture = name in FURNITURE or bool(up and up.furniture)
        self.header = (name == "header" and not (up and up.article)) or bool(up and up.header)
        self.heading = name in HEADINGS or bool(up and up.heading)
        self.bad = (bad and not whole and name not in TEXTS) or bool(up and up.bad)
        self.text_name = (bad and name in TEXTS) or bool(up and up.text_name)
        self.good = (good and not whole) or bool(up and up.good)
        self.hidden = hidden or bool(up and up.hidden)

    def features(self, article: bool, text: str, links: int) -> tuple:
        """In the order of FEATURES; article: whether the page has such an element."""
        n = len(text)
        marks = sum(text.count(c) for c in ".,;:!?")
        return (1, article and self.article, article and not self.article, self.furniture, self.header, self.bad, self.text_name and not self.bad, self.good and not self.bad, self.hidden, self.heading, math.log2(1 + n / 20), min(marks, 4), min(1.0, links / n))


def blocks(html: str) -> list[Block]:
    """The page's blocks in page order, with their log-odds."""
    stack: list[_Element] = []
    found: list[tuple[Block, _Element]] = []
    root = _Element("", "", 0, None)
    current: Block | None = None
    number = at = 0
    link: int | None = None  # how many elements were open where a link began; it ends with the innermost of them

    def add(text: str) -> None:
        nonlocal current
        if not text or (current is None and text.isspace()):
            return
        if current is None:
            current = Block(tuple(e.number for e in stack), 0.0)
            found.append((current, stack[-1] if stack else root))
        current.parts.append(text)
        if link is not None:
            current.links += len(text)

    while (m := _TAG.search(html, at)) is not None:
        add(html[at : m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            simple = _SIMPLE.match(m[0])
            if simple is None:
                continue
            closing, name, attributes = simple.groups()
        else:
            closing, attributes = m[1], m[3]
        name = name.lower()
        if name in UNREAD:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if end is not None:
                    at = end.end()
                elif name in ("script", "style", "textarea", "title"):
                    at = len(html)
            continue
        if name in INLINE:
            if name == "a":
                link = None if closing else len(stack)
            elif name == "br":
                add(" ")
            continue
        current = None
        if name in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
            if link is not None and len(stack) < link:
                link = None
            continue
        if stack and stack[-1].name == "p":
            stack.pop()
        ends = CLOSES_ITSELF.get(name)
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in ends:
                    del stack[i:]
                    break
                if stack[i].name in SCOPES:
                    break
        if link is not None and len(stack) < link:
            link = None
        if not attributes.endswith("/"):
            number += 1
            stack.append(_Element(name, attributes, number, stack[-1] if stack else root))
    add(html[at:])
    article = any(e.article for _, e in found)
    out = []
    for b, e in found:
        raw = "".join(b.parts)
        b.text = " ".join((unescape(raw) if "&" in raw else raw).split())
        if b.text:
            b.features = e.features(article, b.text, b.links)
            b.odds = sum(map(mul, WEIGHTS, b.features))
            out.append(b)
    return out


def fitted_weights(pages: list[tuple[str, set[str]]], strength: float = 100.0) -> np.ndarray:
    """Weights of FEATURES from pages and the texts of their content blocks: logistic regression by Newton steps, with a
    normal prior of precision `strength` around PRIOR. The features do not depend on the present weights."""
    rows = [(b.features, b.text in content) for html, content in pages for b in blocks(html)]
    x, y, prior = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float), np.array(PRIOR)
    w = prior.copy()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + strength * np.eye(len(w)), x.T @ (y - p) - strength * (w - prior))
        w = w + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours and between blocks of one parent; less across the border of a part that is marked as
    furniture, as unlike labels are expected there."""
    inside = [b.features[3:6] + b.features[8:9] for b in found]  # in_furniture, in_header, bad_name, hidden

    def edge(i: int, j: int, weight: float) -> tuple[int, int, float]:
        return i, j, weight if inside[i] == inside[j] else weight * ACROSS

    out = []
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i:
            a = found[i - 1]
            common = 0
            for x, y in zip(a.path, b.path, strict=False):
                if x != y:
                    break
                common += 1
            out.append(edge(i - 1, i, NEXT * (1 + common) / (1 + max(len(a.path), len(b.path)))))
        up = b.path[-2] if len(b.path) > 1 else 0
        if up in last:
            out.append(edge(last[up], i, SIBLING))
        last[up] = i
    return out


def minimum_cut(odds: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: max(0, -odds) for True, max(0, odds) for False, and the weights of edges between unlike ones."""
    n, odds = len(odds), list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in links:
        if i != j:
            near[i][j] = near[i].get(j, 0.0) + c
            near[j][i] = near[j].get(i, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) > sum(near[i].values()):
            label[i] = odds[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                odds[j] += c if label[i] else -c
                todo.append(j)
            near[i] = {}
    for i in range(n):
        if label[i] is None:  # what is left falls into parts without an edge between them, each a graph of its own
            part, seen = [i], {i}
            for a in part:
                fresh = [j for j in near[a] if j not in seen]
                seen.update(fresh)
                part += fresh
            side = _source_side({a: near[a] for a in part}, {a: odds[a] for a in part})
            for a in part:
                label[a] = a in side
    return [bool(x) for x in label]


def _source_side(near: dict[int, dict[int, float]], odds: dict[int, float]) -> set[int]:
    """Dinic's maximum flow; the nodes that the source still reaches.

    In a phase every node keeps its place in its list of arcs, and after an augmentation the path is only taken back to
    its first full arc.
    """
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in near} | {source: {}, sink: {}}
    for i, s in odds.items():
        if s > 0:
            room[source][i], room[i][source] = s, 0.0
        elif s < 0:
            room[i][sink], room[sink][i] = -s, 0.0
    tiny = 1e-12
    while True:
        level, todo = {source: 0}, deque([source])
        while todo:
            i = todo.popleft()
            for j, c in room[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    todo.append(j)
        if sink not in level:
            return {i for i in level if i >= 0}
        arcs = {i: list(room[i]) for i in level}
        at = dict.fromkeys(level, 0)
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                pairs = list(zip(path, path[1:], strict=False))
                least = min(room[a][b] for a, b in pairs)
                for a, b in pairs:
                    room[a][b] -= least
                    room[b][a] = room[b].get(a, 0.0) + least
                full = next(n for n, (a, b) in enumerate(pairs) if room[a][b] <= tiny)
                del path[full + 1 :]
                continue
            while at[i] < len(arcs[i]):
                j = arcs[i][at[i]]
                if room[i][j] > tiny and level.get(j, -9) == level[i] + 1:
                    path.append(j)
                    break
                at[i] += 1
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1


def main_text(html: str | None) -> tuple[str, int, int, int]:
    """The content blocks joined by newlines, the number of blocks, of content blocks, and of blocks whose label is not the
    classifier's own but the cut's."""
    found = blocks(html or "")
    label = minimum_cut([b.odds for b in found], edges(found))
    kept = [b.text for b, content in zip(found, label, strict=True) if content]
    return "\n".join(kept), len(found), len(kept), sum((b.odds > 0) != content for b, content in zip(found, label, strict=True))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [main_text(h.as_py()) for h in b.column("html")]
        keep = b.schema.names[:-1]
        made = [pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())]
        yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + made, names=[*keep, "text", "n_chars", "n_blocks", "n_content", "n_mended"])


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points of text), n_blocks, n_content, n_mended (blocks that
    the cut labels against the classifier's sign).

    A null or empty page gives an empty text. Rows are independent, so repeated rows and null ids or urls give rows alike; an
    empty table gives an empty result, and other columns are ignored.
    """
    prepare(pages.sparkSession)
    lean = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in lean.schema}
    return lean.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, n_blocks int, n_content int, n_mended int")
