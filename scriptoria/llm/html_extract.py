"""Main text of web pages by minimum cut.

A page is cut into blocks of text. A logistic classifier scores each block from its length, links and punctuation, its share of the page's text and those of the elements
around it, and their names, classes, ids and roles. The score, log-odds of content, becomes a terminal capacity:
towards content where it is positive, towards boilerplate where it is negative. Neighbours on the page, and neighbours under
one parent, are joined by edges whose capacity grows with the share of the ancestors that they
have in common. The minimum cut, found by maximum flow, labels all blocks at once: a block that says little
by itself goes with those around it.

The tables have no labelled pages, so the classifier is fitted on LABELLED pages that ``html_samples`` writes with known labels, from a fixed seed, and the weight of the edges is chosen on TUNING more: the model is
the same in every run. Text in hidden elements, scripts, buttons and the like is no text of the page. A page is one task's row; work and memory grow with the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_samples
from .common import pick, table

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video title head select textarea button".split())
RAW_TEXT = frozenset("script style title textarea iframe noscript".split())
BLOCKS = frozenset("p div ul ol dl table section article aside nav header footer form h1 h2 h3 h4 h5 h6 pre blockquote hr figure main address fieldset details menu".split())
#: What may stand in a head; all else closes one that is left open.
HEAD = frozenset("base link meta title style script noscript template".split())
#: Marks buttons and selects without an end tag; blocks cannot stand in them and close them.
OPEN = "!"
CLOSED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": BLOCKS | {"option", "optgroup", "button", "select"}, "optgroup": BLOCKS | {"optgroup", "button", "select"}, OPEN + "button": BLOCKS | {"button", "select"}, OPEN + "select": BLOCKS | {"button", "select"}}
BOILER_TAGS = frozenset("nav footer aside menu dialog".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
#: Words of class and id values. What each group says, outside and inside of content, is learnt.
STRONG_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead topbar toolbar cookie cookies consent gdpr popup modal overlay comment comments disqus reply replies share sharing social related recommended trending subscribe subscription newsletter signup login search widget pagination pager".split())
WEAK_WORDS = frozenset("aside header head foot rail notice notices notification alert respond discussion feedback popular form tags copyright legal disclaimer skip".split())
CONTENT_WORDS = frozenset("article content post entry story body main text prose".split())
FEATURES = ("bias", "content", "boiler", "form", "named", "strong outside", "strong inside", "weak outside", "weak inside", "heading", "paragraph", "item", "links", "words", "stop", "share", "parent's share", "outer share")

#: Pages that the classifier is fitted on, and that the edges' weight is chosen on among SMOOTH.
LABELLED, TUNING = 500, 500
#: Power of the closeness of two blocks: edges between siblings count, those between parts of the page hardly do.
NEARNESS = 3
SMOOTH = (0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0)
RIDGE = 0.5

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ENDED = {tag: re.compile(rf"<(/?){tag}(?=[\s/>])", re.I) for tag in ("button", "select")}
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_ENDS = re.compile(r"[.!?:][\"')\]]*\Z")


class Context(NamedTuple):
    """What the elements around a block are; outside and inside: of the nearest content element."""

    content: bool = False
    boiler: bool = False
    form: bool = False
    named: bool = False
    strong_out: bool = False
    strong_in: bool = False
    weak_out: bool = False
    weak_in: bool = False
    dead: bool = False


class Element:
    __slots__ = ("tag", "parent", "depth", "context", "words")

    def __init__(self, tag: str, parent: Element | None, context: Context):
        self.tag, self.parent, self.depth, self.context, self.words = tag, parent, parent.depth + 1 if parent else 0, context, 0


_NOWHERE = Context()


def _context(tag: str, attrs: str, above: Context) -> Context:
    """The context inside an element. Raw and hidden elements are dead; a content element takes no account of forms and of a name of content around it."""
    if above.dead or tag in RAW:
        return above if above.dead else above._replace(dead=True)
    c = above
    if tag in CONTENT_TAGS and not c.boiler:
        c = c._replace(content=True, form=False, named=False)
    elif tag in BOILER_TAGS or tag == "header" and not (c.content or c.named):
        c = c._replace(boiler=True)
    elif tag == "form":
        c = c._replace(form=True)
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return c
    for m in _NAMES.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return c._replace(dead=True)
        if name == "role":
            if value.lower() in BOILER_ROLES:
                c = c._replace(boiler=True)
            elif value.lower() in ("main", "article") and not c.boiler:
                c = c._replace(content=True, form=False, named=False)
        elif name in ("class", "id") and tag not in ("html", "body"):
            words = {w.lower() for w in _WORDS.findall(value)}
            inside = above.content or above.named
            if words & STRONG_WORDS:
                c = c._replace(strong_in=True) if inside else c._replace(strong_out=True)
            elif words & WEAK_WORDS:
                c = c._replace(weak_in=True) if inside else c._replace(weak_out=True)
            elif words & CONTENT_WORDS and not c.content:
                c = c._replace(named=True, form=False)
    return c


class Block(NamedTuple):
    text: str
    element: Element
    words: int
    linked: int
    low: int  # the least depth of an element between the block before and this one


def blocks_of(page: str) -> list[Block]:
    """The blocks of text of a page in page order, white space made single."""
    out: list[Block] = []
    root = Element("", None, _NOWHERE)
    top, stack, text, links, in_link = root, [root], [], 0, 0
    open_: Counter[str] = Counter()
    skip_to, at, home, low, home_low = "", 0, root, 0, 0

    def flush():
        nonlocal text, links
        if text:
            words = [] if home.context.dead else html.unescape("".join(text)).split()
            if words:
                out.append(Block(" ".join(words), home, len(words), min(links, len(words)), home_low))
            text, links = [], 0

    def start():
        nonlocal home, low, home_low
        home, home_low, low = top, min(low, top.depth) if out else 0, top.depth

    def left(n):
        """Leaves the elements from the n-th of the stack on."""
        nonlocal top, low
        for e in stack[n:]:
            open_[e.tag] -= 1
        del stack[n:]
        top = stack[-1]
        low = min(low, top.depth)

    def entered(tag, context):
        nonlocal top
        top = Element(tag, stack[-1], context)
        stack.append(top)
        open_[tag] += 1

    def leave_head():
        flush()
        left(len(stack) - 1)

    for m in _TAG.finditer(page):
        if skip_to:
            if not (m[1] and m[2] and m[2].lower() == skip_to):
                continue
            at, skip_to = m.end(), ""
            continue
        if m.start() > at:
            piece = page[at : m.start()]
            if top.tag == "head" and not piece.isspace():
                leave_head()
            if not text:
                start()
            text.append(piece)
            if in_link:
                links += len(piece.split())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if top.tag == "head" and not m[1] and tag not in HEAD:
            leave_head()
        if tag == "br":
            text.append(" ") if text else None
            continue
        if m[1]:
            if tag in INLINE:
                in_link = max(0, in_link - (tag == "a"))
                if tag in ("a", "b", "i", "em", "strong", "u", "s", "font") or len(stack) < 2 or stack[-1].tag != tag:
                    continue
            else:
                flush()
            if open_[tag]:
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                left(k)
            continue
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else len(page)
            if tag not in ("title",):
                flush() if tag not in ("script", "style") else None
            skip_to = tag if end else "\0"
            if not end:
                break
            continue
        if tag in INLINE:
            in_link += tag == "a"
            if tag == "span" and not m[3].endswith("/"):
                context = _context(tag, m[3], top.context) if m[3] else top.context
                if context != top.context:
                    flush()
                entered(tag, context)
            continue
        flush()
        in_link = 0
        if tag in VOID:
            continue
        n = len(stack)
        while n > 1 and stack[n - 1].tag == "span":
            n -= 1
        while n > 1 and tag in CLOSED_BY.get(stack[n - 1].tag, ()):
            n -= 1
        if n < len(stack):
            left(n)
        if tag in ("button", "select"):
            end = _ENDED[tag].search(page, at)
            left_open = OPEN if not end or not end[1] else ""
        else:
            left_open = ""
        entered(left_open + tag, _context(tag, m[3], stack[-1].context))
    if not skip_to and at < len(page):
        if top.tag == "head" and not page[at:].isspace():
            leave_head()
        if not text:
            start()
        text.append(page[at:])
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block."""
    total = sum(b.words for b in blocks) or 1
    for b in blocks:
        for e in (b.element.parent, b.element.parent and b.element.parent.parent):
            if e is not None:
                e.words = 0
    for b in blocks:
        for e in (b.element.parent, b.element.parent and b.element.parent.parent):
            if e is not None:
                e.words += b.words - b.linked
    out = np.empty((len(blocks), len(FEATURES)))
    for k, b in enumerate(blocks):
        e, c, up = b.element, b.element.context, b.element.parent
        heading, paragraph, item = e.tag[:1] == "h" and e.tag[1:].isdigit(), e.tag in ("p", "pre", "blockquote"), e.tag in ("li", "dt", "dd")
        share, outer = (up.words / total, up.parent.words / total if up.parent else 1.0) if up else (1.0, 1.0)
        out[k] = (1, c.content, c.boiler, c.form, c.named, c.strong_out, c.strong_in, c.weak_out, c.weak_in, heading, paragraph, item, b.linked / b.words, math.log1p(min(b.words, 100)), bool(_ENDS.search(b.text)), b.words / total, share, outer)
    return out


def neighbours(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """(i, j, closeness) of blocks that follow each other, and of those that follow each other under one parent; closeness is the share of the deeper one's ancestors, itself included, that both have."""
    edges, last = [], {}
    for k, b in enumerate(blocks):
        e = b.element
        if k:
            edges.append((k - 1, k, (b.low + 1) / (max(blocks[k - 1].element.depth, e.depth) + 1)))
        if (j := last.get(id(e.parent))) is not None and j < k - 1:
            edges.append((j, k, e.depth / (e.depth + 1)))
        last[id(e.parent)] = k
    return edges


def cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the content side of the minimum cut; ties go to boilerplate."""
    n = len(scores)
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(a, b, c, back):
        out[a].append(len(to))
        to.append(b)
        cap.append(c)
        out[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, x in enumerate(scores):
        edge(s, i, x, 0.0) if x > 0 else edge(i, t, -x, 0.0)
    for a, b, c in edges:
        edge(a, b, c, c)
    eps = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        todo = deque([s])
        while todo:
            a = todo.popleft()
            for e in out[a]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nxt, path = [0] * (n + 2), []
        a = s
        while True:
            if a == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                keep = next(i for i, e in enumerate(path) if cap[e] <= eps)
                a = to[path[keep] ^ 1]
                del path[keep:]
                continue
            while nxt[a] < len(out[a]):
                e = out[a][nxt[a]]
                if cap[e] > eps and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]


class Model(NamedTuple):
    weights: tuple[float, ...]
    smooth: float


@cache
def model() -> Model:
    """Weights by logistic regression on the blocks of LABELLED pages that html_samples writes; the edges' weight is the one that labels TUNING others best."""
    pages = [html_samples.page(k) for k in range(LABELLED)]
    blocks = [blocks_of(p) for p in pages]
    x = np.concatenate([features(b) for b in blocks])
    y = np.array([html_samples.is_content(b.text) for p in blocks for b in p], float)
    w = np.zeros(len(FEATURES))
    for _ in range(12):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * w)
    weights = tuple(np.round(w, 4).tolist())
    tuning = [blocks_of(html_samples.page(LABELLED + k)) for k in range(TUNING)]
    wrong = {s: sum(c != html_samples.is_content(b.text) for p in tuning for b, c in zip(p, labels(p, Model(weights, s)), strict=True)) for s in SMOOTH}
    return Model(weights, min(SMOOTH, key=wrong.__getitem__))


def labels(blocks: list[Block], m: Model) -> list[bool]:
    """Which blocks are content."""
    if not blocks:
        return []
    scores = (features(blocks) @ np.array(m.weights)).tolist()
    return cut(scores, [(i, j, m.smooth * near**NEARNESS) for i, j, near in neighbours(blocks)])


def main_text(page: str | None, m: Model | None = None) -> str:
    """The main text of a page; empty for a page without any."""
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, c in zip(blocks, labels(blocks, m or model()), strict=True) if c)


def _runs(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                some = b.slice(i, 500)
                texts = [main_text(x, m) for x in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page. Null and empty pages have an empty text; rows that repeat give a row each."""
    rows = pick(pages, "page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(_runs(model()), f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
