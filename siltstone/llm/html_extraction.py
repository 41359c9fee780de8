"""Main text of HTML pages by minimum-cut labelling of their text blocks.

A page is cut into blocks of text. A logistic classifier gives each block the log-odds of being content; its
costs are the capacities to the two terminals. Smoothness edges join neighbouring blocks and blocks that follow
each other under one parent, with a capacity that halves with each step of distance in the tree. The maximum
flow leaves a cut of least cost, and the blocks on the source's side are the main text.

Features are a block's length, links, kind, end and hints in names, a mark as article or main, and whether it stands
in the container that holds most of the page's running text. A page's text depends on the page alone: the weights are
fixed ones. They were learnt with fit() from pages that mark one article or main element: the blocks in it are
content, the others are not, the mark itself being hidden. fit() starts from prior weights and scales the evidence to
a fixed number of blocks, so that pages of one make move them only so far; what it learns from other pages can be
given to extract().
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, stage

#: A comment, a tag or a declaration. A quote counts only after an equals sign, so that an apostrophe in a bare value does not.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>|<[!?][^>]*(?:>|\Z)", re.S)
HINT = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
UNSEEN = re.compile(r"""(?<![\w-])hidden(?![\w-])(?!\s*=\s*["']?until-found)|(?<![\w-])style\s*=\s*(?:"[^"]*|'[^']*)(?<![\w-])(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
WORD = re.compile(r"[a-z]+|[0-9]+")

#: Elements of HTML by the part that they play here.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MATH = frozenset("math semantics annotation annotation-xml mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | MATH
HIDDEN = frozenset("script style head title noscript template iframe svg annotation annotation-xml canvas audio video select button textarea option datalist input".split())
RAW = frozenset("script style textarea title".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTENT_TAGS = frozenset(["article", "main"])
ANCHORED = frozenset("section p h1 h2 h3 h4 h5 h6".split())
FRAME_TAGS = frozenset("nav footer aside form menu dialog".split())
FRAME_HINTS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer discussion disqus dropdown footer gdpr login masthead menu modal nav navbar navigation newsletter notice"
    " notification overlay pagination popup privacy promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that only say which part of a page or of a frame a name is for; others in a name tell of a topic.
PARTS = frozenset("area bar block body bottom box button buttons card col column container content feed form group header icon icons inner item items label left line link links list main module outer panel pane rail region right row section slot tab tabs text thread title tools top wrap wrapper zone".split())
CONTEXT = frozenset("article articles blog desktop entry fixed global js media mobile page post posts side site sticky stories story web wp".split())
NEGATIONS = frozenset("has no with without".split())
STATES = frozenset("enabled disabled open closed on off active inactive visible true false count none".split())
SURE_IDS = frozenset("comments disqus newsletter replies respond sidebar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

#: Prior weights of the classifier (log-odds of content): bias, the log of the number of words (up to 5), the share of
#: linked text, headings, blocks that end like a sentence, frame. Then those of the mark, which are not learnt.
PRIOR = (-1.5, 0.7, -4.0, 1.2, 0.6, -7.0)
IN_CONTENT, LINKED_IN_CONTENT = 4.0, -2.0

#: Weights that fit() learnt from 2,000 pages of a table of sf0.1, to two digits.
WEIGHTS = (-0.53, 1.4, -4.0, 1.32, 1.44, -7.76)

#: Weights of standing in the container of most running text and out of it, where one has a paragraph at least.
INSIDE, OUTSIDE, PARAGRAPH = 2.0, -1.5, 12

#: What pages that mark their content are counted by.
KINDS = ("words", "linked", "heading", "ends", "frame")

#: Pages that the classifier learns from at most; blocks that their evidence counts as; variance of a prior weight.
SAMPLE, EVIDENCE, VARIANCE = 2_000, 200.0, 1.0

#: Capacity of a smoothness edge between blocks of one element.
SMOOTH = 1.6


@dataclass(slots=True)
class Node:
    """An open element: its parent, depth, the nearest element at or above it that is not inline, and what it says of
    the text below it. A frame is fixed if an element for frames made it, and not a hint or a form, which may wrap
    the whole page."""

    tag: str
    parent: Node | None
    depth: int
    base: Node | None
    content: bool
    frame: bool
    fixed: bool
    hidden: bool
    linked: bool
    by: str = ""


@dataclass(slots=True)
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


@lru_cache(maxsize=1 << 16)
def _frame_word(word: str) -> bool:
    """Whether a word names a frame: it is one of the hints, or one joined with a part, as in commentlist."""
    if word in FRAME_HINTS or word in ROLES:
        return True
    cuts = range(2, min(len(word), 30) - 1)
    return any((word[:i] in FRAME_HINTS or word[:i] == "side") and word[i:] in PARTS or word[:i] in PARTS and word[i:] in FRAME_HINTS for i in cuts)


def _plain(word: str) -> bool:
    """Whether a word of a name says nothing of a topic."""
    return len(word) < 3 or word.isdigit() or word in PARTS or word in CONTEXT or word in NEGATIONS or word in STATES or _frame_word(word)


def _hinted(tag: str, attributes: str, content: bool) -> bool:
    """Whether an attribute calls the element frame. What follows has, no or with in a token tells of
    something elsewhere, and a token that ends in a state (comments-open) of how the page is. Of article and main only
    the first word of a token counts, as the others are topics (tag-privacy); below them a token with a word that names
    no part is a topic too (market-share), and an id is there to link to, unless it is sure."""
    for m in HINT.finditer(attributes):
        tokens = (m[2] or m[3] or m[4] or "").lower().split()
        if content and tag in ANCHORED and m[1].lower() == "id":
            if tag == "section" and not SURE_IDS.isdisjoint(tokens):
                return True
            continue
        for token in tokens:
            words = WORD.findall(token)
            if len(words) > 1 and (words[-1] in STATES or (content and not all(map(_plain, words)))):
                continue
            for w, after in zip(words[:1] if tag in CONTENT_TAGS else words, [*words[1:], ""], strict=False):
                if w in NEGATIONS:
                    break
                if _frame_word(w) or (w == "side" and after in PARTS):
                    return True
    return False


def _opened(tag: str, attributes: str, parent: Node) -> Node:
    holds = tag in CONTENT_TAGS and not parent.content
    # No article is part of a navigation: that one was not closed.
    fixed = (parent.fixed and not (holds and parent.by in ("nav", "menu", "header"))) or (tag in FRAME_TAGS and tag != "form") or (tag == "header" and not parent.content)
    frame = fixed or tag == "form" or (parent.frame and not holds)
    if attributes and not frame and tag not in ("html", "body"):
        frame = _hinted(tag, attributes, parent.content)
    hidden = parent.hidden or tag in HIDDEN or bool(attributes and _unseen(attributes))
    by = (parent.by or tag) if fixed else ""
    node = Node(tag, parent, parent.depth + 1, parent.base, parent.content or tag in CONTENT_TAGS, frame, fixed, hidden, parent.linked or tag == "a", by)
    if tag not in INLINE:
        node.base = node
    return node


def _unseen(attributes: str) -> bool:
    """Whether the element is hidden by its attribute or its style."""
    low = attributes.lower()
    if "hidden" not in low and "none" not in low:
        return False
    return any(m[0].lower().startswith("style") or not any(q.start() < m.start() < q.end() for q in QUOTED.finditer(attributes)) for m in UNSEEN.finditer(attributes))


def blocks(page: str) -> list[Block]:
    """The blocks of visible text in page order: runs of text that no block element interrupts."""
    root = Node("", None, 0, None, False, False, False, False, False)
    root.base = root
    node, done, here = root, [], None
    at, end = 0, len(page)
    opened: dict[str, int] = {}

    def say(text: str) -> None:
        nonlocal here
        if not node.hidden:
            if here is None:
                here = Block(node.base)
            here.parts.append(text)
            if node.linked:
                here.linked += len(text)

    def leave(found: Node) -> None:
        """Close the open elements up to and with found."""
        nonlocal node
        while node is not found.parent:
            opened[node.tag] -= 1
            node = node.parent

    def stop() -> None:
        nonlocal here
        if here is not None:
            done.append(here)
            here = None

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            stop()
        elif tag == "br":
            say(" ")
        if m[1]:
            if opened.get(tag):
                found = node
                while found.tag != tag:
                    found = found.parent
                leave(found)
            continue
        if tag not in INLINE:
            shut = SIBLINGS.get(tag, CLOSED_BY_BLOCK)
            while node.base.tag in shut:
                leave(node.base)
        if tag in VOID or (m[3].endswith("/") and (tag in MATH or tag == "svg" or node.tag in MATH)):
            continue
        if tag in RAW:
            close = re.compile(f"</{tag}", re.I).search(page, at)
            at = close.start() if close else end
        node = _opened(tag, m[3], node)
        opened[tag] = opened.get(tag, 0) + 1
    stop()
    for b in done:
        text = "".join(b.parts)
        b.text = " ".join((html.unescape(text) if "&" in text else text).split())
    return [b for b in done if b.text]


def features(block: Block, hints: bool = True) -> tuple[float, ...]:
    """What PRIOR weighs. Without hints only elements for frames make a frame."""
    words, tag = block.text.count(" ") + 1, block.node.tag
    heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
    frame = block.node.frame if hints else block.node.fixed
    return 1.0, min(math.log1p(words), 5.0), min(1.0, block.linked / max(len(block.text), 1)), float(heading), float(block.text[-1] in ".!?:;\"'”»…"), float(frame)


def log_odds(block: Block, weights: Sequence[float] = WEIGHTS, hints: bool = True) -> float:
    x = features(block, hints)
    score = sum(w * v for w, v in zip(weights, x, strict=True))
    return score + IN_CONTENT + (LINKED_IN_CONTENT - weights[2]) * x[2] if block.node.content and not x[-1] else score


def placed(found: list[Block], hints: bool = True) -> list[float]:
    """What the place of each block weighs. Running text, outside of frames and links, counts for the element around
    its paragraph, and half for the one around that; the container is the element for which most counts."""
    counts: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for b in found:
        words = (b.text.count(" ") + 1) * (1 - min(1.0, b.linked / max(len(b.text), 1)))
        if words < PARAGRAPH or (b.node.frame if hints else b.node.fixed):
            continue
        node = b.node.parent if b.node.tag not in ("div", "article", "main", "section", "body", "html", "") else b.node
        for share in (1.0, 0.5):
            if node is not None:
                nodes[id(node)] = node
                counts[id(node)] = counts.get(id(node), 0.0) + words * share
                node = node.parent
    if not counts:
        return [0.0] * len(found)
    best = nodes[max(counts, key=counts.__getitem__)]
    inside: dict[int, bool] = {id(best): True}

    def within(node: Node) -> bool:
        path = []
        while node is not None and id(node) not in inside and node.depth > best.depth:
            path.append(node)
            node = node.parent
        known = node is not None and inside.get(id(node), False)
        inside.update((id(n), known) for n in path)
        return known

    return [INSIDE if within(b.node) and not (b.node.frame if hints else b.node.fixed) else OUTSIDE for b in found]


def distance(a: Node, b: Node) -> int:
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def min_cut(odds: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for the nodes on the source's side of a least cut. A node's terminal capacities are the costs of the two
    labels; the smaller of the two flows at once, so their difference, the log-odds, is left. The rest flows along
    shortest paths, all of one length at a time: as flow stays near where it enters, few lengths occur."""
    n, least = len(odds), 1e-12
    excess = list(odds)
    to: list[list[int]] = [[] for _ in range(n)]
    head: list[int] = []
    room: list[float] = []
    for a, b, c in edges:
        to[a].append(len(head))
        to[b].append(len(head) + 1)
        head += (b, a)
        room += (c, c)
    while True:
        sources = [i for i in range(n) if excess[i] > least]
        level = [-1] * n
        for i in sources:
            level[i] = 0
        layer, far, met = sources, 0, False
        while layer and not met:
            far += 1
            after = []
            for i in layer:
                for e in to[i]:
                    j = head[e]
                    if level[j] < 0 and room[e] > least:
                        level[j] = far
                        met |= excess[j] < -least
                        after.append(j)
            layer = after
        if not met:
            return [x >= 0 for x in level]
        turn = [0] * n
        for s in sources:
            path, i = [], s
            while excess[s] > least:
                if i != s and excess[i] < -least:
                    flow = min(excess[s], -excess[i], min(room[e] for e in path))
                    excess[s] -= flow
                    excess[i] += flow
                    for e in path:
                        room[e] -= flow
                        room[e ^ 1] += flow
                    path, i = [], s
                    continue
                way, k = to[i], turn[i]
                while k < len(way) and not (room[way[k]] > least and level[head[way[k]]] == level[i] + 1):
                    k += 1
                turn[i] = k
                if k < len(way):
                    path.append(way[k])
                    i = head[way[k]]
                elif path:
                    i = head[path.pop() ^ 1]
                    turn[i] += 1
                else:
                    break


def main_text(page: str, weights: Sequence[float] = WEIGHTS) -> str:
    """The main text of a page. Where hints alone leave nothing of it, they are wrong, and it is judged without; where
    that leaves nothing either, as of a page of a few words, what is neither frame nor linked stays."""
    found = blocks(page)
    edges, last = [], {}
    for i, b in enumerate(found):
        if i:
            edges.append((i - 1, i, SMOOTH * 0.5 ** distance(found[i - 1].node, b.node)))
        before = last.get(id(b.node.parent))
        if before is not None and before < i - 1:
            edges.append((before, i, SMOOTH * 0.5 ** distance(found[before].node, b.node)))
        last[id(b.node.parent)] = i
    for hints in (True, False):
        kept = min_cut([log_odds(b, weights, hints) + at for b, at in zip(found, placed(found, hints), strict=True)], edges)
        if any(kept):
            break
    else:
        kept = [not b.node.frame and b.linked * 2 < len(b.text) for b in found]
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


MARK = re.compile(r"<(?:article|main)[\s>]", re.I)


def evidence(page: str) -> list[tuple[float, ...]]:
    """The features of the blocks of a page that marks its content once, rounded so that few kinds occur, and
    whether they are content; nothing of other pages."""
    if len(MARK.findall(page)) != 1:
        return []
    rows = []
    for b in blocks(page):
        _, words, linked, heading, ends, frame = features(b)
        rows.append((round(words * 2) / 2, round(linked * 4) / 4, heading, ends, frame, float(b.node.content and not b.node.frame)))
    return rows


def fitted(x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[float, ...]:
    """The most likely weights under a normal prior around PRIOR, by Newton's method. Both labels weigh the same."""
    prior = np.array(PRIOR)
    if not len(x) or not (counts[y == 1].sum() and counts[y == 0].sum()):
        return PRIOR
    share = np.where(y == 1, counts / counts[y == 1].sum(), counts / counts[y == 0].sum()) * min(EVIDENCE, counts.sum()) / 2
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / VARIANCE, x.T @ (share * (y - p)) - (w - prior) / VARIANCE)
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(pages: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", html_col: str = "html") -> tuple[float, ...]:
    """Weights learnt from up to `sample` pages, those with the smallest seeded hashes of their address or
    identifier and text; PRIOR if none of them marks its content. The tasks send counts of kinds of blocks, some
    thousand rows whatever the pages hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KINDS, "content"]
        for batch in batches:
            rows = [r for page in batch.column(0).to_pylist() for r in evidence(page)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.float64()) for c in zip(*rows, strict=True)] or [pa.array([], type=pa.float64())] * len(names), names=names)

    html_ = F.coalesce(pages[html_col], F.lit(""))
    keyed = pages.select(F.xxhash64(pages[id_col], html_, F.lit(37)).alias("h"), html_.alias("html"))
    least = stage(keyed.select("h").distinct().orderBy("h").limit(sample), "html-sample")  # at most `sample` numbers
    chosen = keyed.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"]).select("html")
    with small_batches(pages.sparkSession):
        kinds = chosen.mapInArrow(run, ", ".join(f"{k} double" for k in (*KINDS, "content"))).groupBy(*KINDS, "content").count().collect()
    kinds = sorted(kinds, key=tuple)
    x = np.array([[1.0, *(r[k] for k in KINDS)] for r in kinds]).reshape(len(kinds), len(PRIOR))
    return fitted(x, np.array([r["content"] for r in kinds]), np.array([r["count"] for r in kinds], dtype=float))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """id, url and main text of every row of pages, by the fixed weights unless others are given. A null page is an empty one; a page without content has an empty text; pages of any length are read whole. Null
    identifiers and URLs pass through; repeated rows come out alike; other columns are not read. Run it in
    shared.small_batches() where pages are long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(h, weights) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, type=pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string")
