"""Main text of web pages by minimum-cut labelling.

A page is read into blocks, the runs of text between block-level tags, and the
elements that contain them. A logistic classifier, trained in numpy on generated
pages (``page_samples``), gives each block the cost of calling it content or
boilerplate from its text, its links and the marks on the elements around it;
these costs are the capacities of its edges to the two terminals. Blocks next
to each other in the page are tied by edges, and every block and element to the
element around it (proximity in the document tree), so that a short block goes
with its surroundings. The minimum cut between the terminals, found by maximum
flow, splits content from boilerplate.

A name of a class, id or role tells on its own only if all of it names page
furniture (``ad-slot``, ``comments``); a name that holds such a word among others
(``social-policy``) is weak evidence, which a sentence outweighs.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import log1p
from random import Random
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import page_samples
from .common import bounded_batches

# Names of HTML elements, and words that class, id and role values are made of.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style template noscript iframe svg math object textarea title select".split())
_IN_HEAD = frozenset("base basefont bgsound link meta".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
_CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_NOT_MAIN = frozenset("nav footer aside form menu dialog button fieldset search".split())
_ROLES = frozenset("navigation complementary contentinfo banner search dialog alertdialog alert form menu menubar toolbar".split())
#: Furniture also beside words of ``_GOOD``; furniture beside its like and ``_PLAIN``; weak wherever they stand.
_HARD = frozenset("ad ads adv advert adverts advertisement advertising advertisements cookie cookies consent gdpr newsletter breadcrumb breadcrumbs footer nav navbar navigation menu sidebar sidenav comment comments commentlist disqus sponsor sponsored sponsors".split())
_SOFT = frozenset("banner promo promotion notice notices alert subscribe subscription share sharing social related recommended reply replies respond popup modal overlay widget widgets pagination pager login signin signup toolbar topbar complementary contentinfo dialog skip hidden byline".split())
_AMBIGUOUS = frozenset("discussion search tags header banner".split())
_HEAD = frozenset("header masthead topbar".split())
_PLAIN = frozenset("list item items box bar wrap wrapper container section block area link links button buttons btn form panel inner outer top bottom left right primary secondary site page post posts widget unit slot zone row col column module component group global sticky user reader main thread".split())
_GOOD = frozenset("article content main post entry story body text".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.S)
_MARK = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_STOP = re.compile(r"[.!?,;:]")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)

#: Ties between neighbours, of a block to its element, and of an element to the one around it, in log-odds; capacities are ``SCALE`` times these.
NEXT, SAME_PARENT, AROUND, SCALE = 0.4, 0.6, 0.2, 100
#: Generated pages that the classifier is trained on.
SAMPLES = 700
#: Features of a block, in the order of its weights.
FEATURES = ("always", "furniture", "name", "length", "short", "stops", "linked", "short_links", "heading", "paragraph", "item", "cell", "article", "good", "weak", "weak_long", "outside", "no_article")


@lru_cache(maxsize=50_000)
def _named(value: str) -> tuple[bool, bool, bool, bool]:
    """Whether names of a class or id are furniture, may be, name a page's head, or name content."""
    strong = weak = head = good = False
    for token in value.split():
        parts = {x.lower() for x in _PART.findall(token) if not x.isdigit()}
        hard, soft = parts & _HARD, parts & _SOFT
        if hard and parts <= _HARD | _SOFT | _PLAIN | _GOOD or soft and parts <= _HARD | _SOFT | _PLAIN:
            strong = True
        elif parts & _HEAD and parts <= _HEAD | _PLAIN:
            head = True
        elif hard or soft or parts & _AMBIGUOUS:
            weak = True
        good = good or bool(parts & _GOOD)
    return strong, weak, head, good


class Element:
    """An open or closed element: its tag, its number, the one around it and what marks on both say."""

    __slots__ = ("article", "furniture", "good", "name", "number", "parent", "tag", "weak")

    def __init__(self, tag: str, number: int, parent: Element | None, marks: str):
        self.tag, self.number, self.parent = tag, number, parent
        above = parent is not None
        main = tag in ("article", "main")
        self.article = main or above and parent.article
        self.furniture = above and parent.furniture or tag in _NOT_MAIN or tag == "header" and not self.article
        self.name = self.weak = self.good = False
        if marks and not marks.isspace() and tag not in ("html", "body"):
            for m in _MARK.finditer(marks):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                    self.furniture = True
                elif key == "role":
                    roles = set(value.lower().split())
                    self.furniture = self.furniture or bool(roles & _ROLES)
                    self.article = self.article or bool(roles & {"main", "article"})
                elif key in ("class", "id"):
                    strong, weak, head, good = _named(value)
                    strong = strong or head and not self.article
                    self.name, self.weak, self.good = self.name or strong and not main, self.weak or weak or strong and main, self.good or good
        if above:
            self.name, self.weak, self.good = self.name or parent.name, self.weak or parent.weak, self.good or parent.good


class Block(NamedTuple):
    """A run of text: decoded and trimmed, with its characters in links, its links and the element around it."""

    text: str
    linked: int
    links: int
    element: Element


@lru_cache(maxsize=64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>|\\Z", re.I)


def _after_head(html: str, at: int) -> int:
    """Where a head that begins before ``at`` ends: at its own end, or at what can't stand in a head."""
    while True:
        m = _TAG.search(html, at)
        if html[at : m.start() if m else len(html)].strip():
            return at
        if m is None:
            return len(html)
        tag = m[2].lower() if m[2] else ""
        if m[1]:
            if tag == "head":
                return m.end()
        elif tag in _RAW and not m[3].endswith("/"):
            at = _end_of(tag).search(html, m.end()).end()
            continue
        elif tag and tag not in _IN_HEAD and tag not in _RAW:
            return m.start()
        at = m.end()


def blocks(html: str) -> list[Block]:
    """The page's blocks in order."""
    found: list[Block] = []
    top = Element("", 0, None, "")
    stack, count = [top], 1
    text: list[str] = []
    linked = links = at = 0
    link_depth = 0  # elements open where the open link began; 0: none

    def flush() -> None:
        nonlocal text, linked, links
        if text:
            whole = " ".join(unescape("".join(text)).split())
            if whole:
                found.append(Block(whole, linked, links, stack[-1]))
        text, linked, links = [], 0, int(link_depth > 0)

    while True:
        m = _TAG.search(html, at)
        piece = html[at : m.start() if m else len(html)]
        if piece:
            text.append(piece)
            if link_depth:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        closing, tag = m[1], m[2].lower()
        if tag == "head":
            if not closing:
                at = _after_head(html, at)
        elif not closing and tag in _RAW:
            if not m[3].endswith("/"):
                at = _end_of(tag).search(html, at).end()
        elif tag == "a":
            link_depth = 0 if closing else len(stack)
            links += not closing
        elif tag == "br":
            text.append(" ")
        elif tag in _BLOCK:
            flush()
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        del stack[i:]
                        break
            else:
                if stack[-1].tag == "p":
                    stack.pop()
                shut = _CLOSES.get(tag)
                while shut and stack[-1].tag in shut:
                    stack.pop()
            if link_depth > len(stack):
                link_depth = links = 0
            if not closing and tag not in _VOID:
                stack.append(Element(tag, count, stack[-1], m[3]))
                count += 1
    flush()
    return found


_HEADINGS, _PARAGRAPHS, _ITEMS, _CELLS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("p blockquote pre dd figcaption".split()), frozenset("li dt option".split()), frozenset("td th caption".split())


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """``FEATURES`` of each block of a page; what is marked as furniture isn't judged by its text."""
    has_article = any(b.element.article and not b.element.furniture and not b.element.name for b in found)
    out = []
    rest = (0.0,) * (len(FEATURES) - 3)
    for text, linked, links, e in found:
        if e.furniture or e.name:
            out.append((1.0, float(e.furniture), float(e.name), *rest))
            continue
        n = len(text)
        stops = min(4, len(_STOP.findall(text))) / 4
        share = min(1.0, linked / n)
        inside = has_article and e.article
        out.append((
            1.0, 0.0, 0.0, min(2.0, log1p(n / 60)), float(n < 25), stops, share, share * (linked < 30 * links), float(e.tag in _HEADINGS), float(e.tag in _PARAGRAPHS), float(e.tag in _ITEMS), float(e.tag in _CELLS),
            float(inside), float(e.good), float(e.weak), float(e.weak and n >= 60 and stops > 0.25), float(has_article and not inside), float(not has_article),
        ))
    return out


@lru_cache(maxsize=1)
def trained() -> tuple[float, ...]:
    """Weights of ``FEATURES`` by ridge-logistic regression on ``SAMPLES`` generated pages; each page counts alike."""
    rng, rows, y, weight = Random(41), [], [], []
    for _ in range(SAMPLES):
        html, truth = page_samples.page(rng)
        found = blocks(html)
        if [b.text for b in found] != [t for t, _ in truth]:
            raise AssertionError("a generated page isn't read as it was made")
        rows += features(found)
        y += [float(good) for _, good in truth]
        weight += [1 / len(truth)] * len(truth)
    x, t = np.array(rows), np.array(y)
    own = np.array(weight) * len(t) / SAMPLES
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (own * p * (1 - p))[:, None]) + 0.5 * np.eye(len(w)), x.T @ (own * (t - p)) - 0.5 * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


class Flow:
    """Maximum flow by levels and blocking flows on a small graph; nodes 0 and 1 are the terminals."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.edges: list[list[int]] = [[] for _ in range(n)]

    def tie(self, a: int, b: int, there: int, back: int = 0) -> None:
        self.edges[a].append(len(self.to))
        self.to.append(b)
        self.room.append(there)
        self.edges[b].append(len(self.to))
        self.to.append(a)
        self.room.append(back)

    def reached(self) -> list[int]:
        """Levels from node 0 through edges with room left; -1 if not reached."""
        level = [-1] * len(self.edges)
        level[0] = 0
        queue = deque([0])
        while queue:
            a = queue.popleft()
            for e in self.edges[a]:
                b = self.to[e]
                if self.room[e] > 0 and level[b] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def run(self) -> list[int]:
        """Saturates the graph; the levels that remain tell the source's side of the minimum cut."""
        while (level := self.reached())[1] >= 0:
            following = [0] * len(self.edges)
            path: list[int] = []
            a = 0
            while True:
                if a == 1:
                    least = min(self.room[e] for e in path)
                    cut = 0
                    for i, e in enumerate(path):
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    cut = next(i for i, e in enumerate(path) if not self.room[e])
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                own = self.edges[a]
                while following[a] < len(own):
                    e = own[following[a]]
                    if self.room[e] > 0 and level[self.to[e]] == level[a] + 1:
                        break
                    following[a] += 1
                if following[a] < len(own):
                    path.append(own[following[a]])
                    a = self.to[path[-1]]
                elif path:
                    e = path.pop()
                    a = self.to[e ^ 1]
                    following[a] += 1
                else:
                    break
        return level


def labels(found: list[Block], weights: tuple[float, ...] | None = None) -> list[bool]:
    """Whether each block is content."""
    weights = weights or trained()
    scores = [round(SCALE * sum(map(float.__mul__, f, weights))) for f in features(found)]
    if not scores or max(scores) <= 0:
        return [False] * len(scores)
    if min(scores) > 0:
        return [True] * len(scores)
    nodes: dict[int, int] = {}
    ties: list[tuple[int, int, int]] = []
    n = len(found) + 2
    for i, b in enumerate(found):
        child, e, strength = i + 2, b.element, SAME_PARENT
        while e is not None and e.parent is not None:
            new = e.number not in nodes
            if new:
                nodes[e.number] = n
                n += 1
            ties.append((child, nodes[e.number], round(SCALE * strength)))
            if not new:
                break
            child, e, strength = nodes[e.number], e.parent, AROUND
    graph = Flow(n)
    for i, s in enumerate(scores):
        if s > 0:
            graph.tie(0, i + 2, s)
        elif s < 0:
            graph.tie(i + 2, 1, -s)
        if i:
            graph.tie(i + 1, i + 2, round(SCALE * NEXT), round(SCALE * NEXT))
    for a, b, c in ties:
        graph.tie(a, b, c, c)
    level = graph.run()
    return [level[i + 2] >= 0 for i in range(len(found))]


def main_text(html: str, weights: tuple[float, ...] | None = None) -> str:
    """Content blocks in page order, two line feeds between them."""
    found = blocks(html)
    return "\n\n".join(b.text for b, good in zip(found, labels(found, weights), strict=True) if good)


def _extract(batches: Iterator[pa.RecordBatch], weights: tuple[float, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h, weights) for h in batch.column("html").to_pylist()]
        kept = [n for n in batch.schema.names if n != "html"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, "text", "n_chars"])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep`` columns, ``text`` and ``n_chars`` (code points) of every page.

    One row per row of ``pages``, each on its own: repeated rows give equal
    results. A null page counts as empty and gives the empty text, as does a
    page without content. Pages of any form are read: tags that are never
    closed, stray ends and cut-off ends of a page don't raise. A block on which
    both labels cost the same is boilerplate.
    """
    bounded_batches(pages.sparkSession)
    weights = trained()
    rows = pages.select(*keep, F.coalesce("html", F.lit("")).alias("html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "html")
    return rows.mapInArrow(lambda it: _extract(it, weights), f"{fields}, text string, n_chars long")
