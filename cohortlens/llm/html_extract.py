"""Main text of web pages by minimum-cut labelling (operator 6).

A page is read into blocks of text between block-level tags. A classifier over a block's place in the DOM and its text gives
two costs, that of calling it boilerplate and that of calling it content; they are the capacities to the two terminals.
Neighbours in page order, and blocks whose parents are close in the DOM, are tied by smoothness edges. The minimum cut is the
labelling of least total cost. Blocks whose own costs outweigh all their edges are settled first (every minimum cut agrees),
which leaves little or nothing for the augmenting paths; the result is the exact minimum cut.

The weights of the text's properties are fitted to the pages themselves (``fit``): blocks that stand in an article or main
element, or in a navigation, footer, aside or form, say what text in and out of articles looks like, and the weights serve for
blocks whose place says nothing. All pages count; they are added up by their properties, of which there are 64 sets.

What a place means is weighed in two grades. Elements that never hold the article (navigation, footers, comments, hidden parts)
stay boilerplate whatever is in them, but for a ``main`` (not if hidden). A form around the page and a wrapper that only mentions such a part in
its name (``layout-sidebar-right``) are boilerplate until an ``article`` or ``main`` begins in them.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortlens.llm import textgrid as tg

# Tags of the HTML standard by what they mean here, and words that name parts of a page.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
                       "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BAD_TAGS = frozenset("nav footer aside menu dialog head title button select option label".split())
SOFT_TAGS = frozenset("form fieldset".split())
GOOD_TAGS = frozenset("article main".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
          "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPES = frozenset("table ul ol dl div section article aside body td th li blockquote".split())
BAD_NAMES = re.compile(r"(?<![a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumbs?|head(?:er|line-bar)|footer|masthead|side-?bar|aside|"
                       r"cookies?|consent|notices?|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share\w*|social\w*|related\w*|"
                       r"recommend\w*|comments?|comment-\w+|disqus|replies|respond|pagination|pager|toolbar|widgets?|form|contentinfo|complementary|navigation|hidden)(?![a-z])", re.I)
GOOD_NAMES = re.compile(r"(?<![a-z])(?:article|story|entry|main|content|post(?:-body|-content)?)(?![a-z])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)"
                    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|object|canvas)\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)"
                    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+'|['\"])*+)>"
                    r"|<[/!?][^>]*+>?+|<[a-zA-Z][^>]*+\Z", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

FOREIGN_TAGS = frozenset("svg math".split())
_FORM_END = re.compile("</form", re.I)
ABOUT = re.compile(r"(?:with|without|has|no|show|hide|is)[-_]", re.I)
REPLIES = re.compile(r"comment|related|advert", re.I)

# The classifier: weight of a block's place, and of each property of its text before fitting. Above 0 speaks for content.
GOOD, BAD = 3.0, -6.0
PROPERTIES = ("bias", "paragraph", "heading", "long", "sentence", "links", "item")
WEIGHTS = (-0.6, 0.8, 0.4, 1.0, 0.4, -2.5, -0.3)
PRIOR, LIMIT = 0.05, 3.5
ADJACENT, SIBLING, NEAR = 0.5, 0.4, 0.2
SOFT, HARD, HIDDEN = 1, 2, 3


class Block(NamedTuple):
    """``path``: numbers of the innermost three open block elements. ``good``: in an article; ``bad``: in boilerplate (2: for
    sure, 3: hidden). ``kind``: the text's properties, a bit each."""

    text: str
    path: tuple[int, ...]
    good: bool
    bad: int
    kind: int


class Open(NamedTuple):
    tag: str
    block: str
    path: tuple[int, ...]
    good: bool
    bad: int


def _kind(tag: str, text: str, linked: int) -> int:
    return sum(x << i for i, x in enumerate((tag in ("p", "pre", "blockquote", "td"), tag in ("h1", "h2", "h3", "h4"), text.count(" ") >= 9,
                                             text[-1] in ".!?:\"'”»)", 2 * linked > len(text), tag == "li")))


def costs(weights: tuple[float, ...]) -> list[float]:
    """What the text says, for each set of properties. A place outweighs it."""
    return [max(-LIMIT - 0.6, min(LIMIT, weights[0] + sum(w for i, w in enumerate(weights[1:]) if k >> i & 1))) for k in range(1 << len(weights) - 1)]


def _place(tag: str, attrs: str | None, good: bool, bad: int, wrapper: bool) -> tuple[bool, int]:
    """Whether an element that opens inside (good, bad) is in an article, and how surely in boilerplate."""
    tokens = [t for x in _NAMES.findall(attrs) for t in x.strip("\"'").split()] if attrs and tag not in ("html", "body") else []
    if tag == "main" and bad < HIDDEN or tag in GOOD_TAGS and bad < HARD:
        good, bad = True, 0
    if tag in BAD_TAGS or tag == "header" and not good:
        bad = max(bad, HARD)
    elif tag in SOFT_TAGS and not wrapper:
        bad = max(bad, SOFT)
    if attrs and tag not in ("html", "body") and _HIDDEN.search(attrs):
        bad = HIDDEN
    if tag in GOOD_TAGS:
        return good, max(bad, HARD) if any(map(REPLIES.search, tokens)) else bad
    for token in tokens:
        found = None if ABOUT.match(token) else BAD_NAMES.search(token)
        if not found:
            good = good or not bad and bool(GOOD_NAMES.search(token))
        elif found[0].lower() in ("form", "widget", "widgets"):
            bad = bad if good or wrapper else max(bad, SOFT)
        elif found[0].lower() == "header" and (good or GOOD_NAMES.search(token)):
            good = good or not bad
        else:
            bad = max(bad, HARD) if good or found.end() - found.start() == len(token) or REPLIES.search(token) else max(bad, SOFT)
    return good, bad


def blocks(html: str) -> list[Block]:
    """Blocks with text in page order. The time grows with the page's length, however deep its elements are nested."""
    out: list[Block] = []
    stack = [Open("", "", (0,), False, 0)]
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked, count, at, seen = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked, seen
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                top = stack[-1]
                out.append(Block(text, top.path, top.good, top.bad, _kind(top.block, text, linked)))
                seen += top.bad < HARD
            parts.clear()
        linked = 0

    def pop() -> None:
        open_[stack.pop().tag] -= 1

    def foreign() -> bool:
        return open_["svg"] > 0 or open_["math"] > 0

    def wraps(begin: int) -> bool:
        """Whether the form that begins there holds most of what follows."""
        end = _FORM_END.search(html, begin)
        return end is None or 2 * (end.start() - begin) > len(html) - begin

    def text(end: int) -> None:
        nonlocal linked
        if end > at and not foreign():
            parts.append(html[at:end])
            linked += (end - at) * (open_["a"] > 0)

    for m in _TOKEN.finditer(html):
        text(m.start())
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and parts:
                parts.append(" ")
            continue
        tag = tag.lower()
        drawn = tag == "title" and foreign()
        if tag in BLOCK_TAGS and not drawn:
            flush()
        elif tag == "br" or tag in FOREIGN_TAGS:
            parts.append(" ")
        if m["end"]:
            while open_[tag]:
                ended = stack[-1].tag == tag
                pop()
                if ended:
                    break
            continue
        if tag in VOID_TAGS or tag in FOREIGN_TAGS and m["attrs"].endswith("/"):
            continue
        if tag in BLOCK_TAGS and not drawn:  # a paragraph ends at the next block; a list item, row or cell at the next of its kind; drawings at any
            while foreign():
                pop()
            ends = CLOSES.get(tag, frozenset()) | {"p"}
            if any(open_[t] for t in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i].tag in SCOPES:
                        break
        top = stack[-1]
        good, bad = _place(tag, m["attrs"], top.good, top.bad, tag == "form" and not seen and wraps(at))
        count += 1
        stack.append(Open(tag, tag if tag in BLOCK_TAGS else top.block, (*top.path[-2:], count) if tag in BLOCK_TAGS else top.path, good, bad))
        open_[tag] += 1
    text(len(html))
    flush()
    return out


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours in page order, stronger among siblings, and the next block under the same grandparent."""
    out = []
    last: dict[int, int] = {}
    for j, b in enumerate(found):
        if j:
            out.append((j - 1, j, ADJACENT + SIBLING * (found[j - 1].path[-2:-1] == b.path[-2:-1])))
        if len(b.path) > 2:
            near = b.path[-3]
            if near in last and last[near] < j - 1:
                out.append((last[near], j, NEAR))
            last[near] = j
    return out


def min_cut(scores: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least cost: -score for content where it is negative, score for boilerplate where it is
    positive, and every tie between unlike labels. Equal cuts give the one with the least content."""
    n = len(scores)
    unary = list(scores)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in ties:
        around[i][j] = around[i].get(j, 0.0) + c
        around[j][i] = around[j].get(i, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # settle what its own costs decide; a settled neighbour's tie becomes a cost
        i = todo.popleft()
        if label[i] is not None or abs(unary[i]) <= sum(around[i].values()):
            continue
        label[i] = unary[i] > 0
        for j, c in around[i].items():
            unary[j] += c if label[i] else -c
            del around[j][i]
            if label[j] is None:
                todo.append(j)
        around[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        reached = _max_flow(left, unary, around)
        for i in left:
            label[i] = i in reached
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], unary: list[float], around: list[dict[int, float]]) -> set[int]:
    """Nodes on the source's side of the minimum cut, by shortest augmenting paths."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(around[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        if unary[i] > 0:
            room[source][i], room[i][source] = unary[i], 0.0
        elif unary[i] < 0:
            room[i][sink], room[sink][i] = -unary[i], 0.0
    while True:
        back = {source: source}
        queue = deque([source])
        while queue and sink not in back:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > 1e-9 and v not in back:
                    back[v] = u
                    queue.append(v)
        if sink not in back:
            return set(back)
        path, v = [], sink
        while v != source:
            path.append((back[v], v))
            v = back[v]
        flow = min(room[u][v] for u, v in path)
        for u, v in path:
            room[u][v] -= flow
            room[v][u] = room[v].get(u, 0.0) + flow


def main_text(html: str | None, says: list[float] | None = None) -> str:
    """The article's blocks, joined by line breaks. ``says``: the ``costs`` of texts (none: before fitting)."""
    found = blocks(html or "")
    if not found:
        return ""
    says = says or costs(WEIGHTS)
    keep = min_cut([says[b.kind] + GOOD * b.good + BAD * (b.bad > 0) for b in found], edges(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many blocks of a batch have which properties in an article (1) and in sure boilerplate (0)."""
    for batch in batches:
        n: Counter[tuple[int, int]] = Counter()
        for block in tg.blocks(batch.column(0)):
            for html in batch.column(0).slice(block.lo, block.hi - block.lo).to_pylist():
                n.update((b.kind, int(not b.bad)) for b in blocks(html or "") if b.bad == HARD or b.good and not b.bad)
        if n:
            yield pa.record_batch([pa.array([k for k, _ in n], pa.int32()), pa.array([y for _, y in n], pa.int32()), pa.array(list(n.values()), pa.int64())],
                                  names=["kind", "content", "n"])


def fit(pages: DataFrame) -> tuple[float, ...]:
    """Weights of the properties: logistic regression of all blocks whose place tells what they are, either side weighing the
    same, drawn towards ``WEIGHTS``. Pages without such blocks give WEIGHTS. At most 128 rows come to the driver."""
    rows = (pages.select("html").mapInArrow(_kinds, "kind int, content int, n long").groupBy("kind", "content").agg(F.sum("n").alias("n"))
            .orderBy("kind", "content").collect())
    sides = [sum(r["n"] for r in rows if r["content"] == y) for y in (0, 1)]
    w0 = np.array(WEIGHTS)
    if not all(sides):
        return WEIGHTS
    x = np.array([[1, *(r["kind"] >> i & 1 for i in range(len(w0) - 1))] for r in rows], dtype=float)
    y = np.array([r["content"] for r in rows], dtype=float)
    share = np.array([r["n"] / (2 * sides[r["content"]]) for r in rows])
    w = w0.copy()
    for _ in range(50):  # Newton steps; the penalty makes the problem strictly convex
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + PRIOR * np.eye(len(w)), x.T @ (share * (p - y)) + PRIOR * (w - w0))
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return tuple(w.tolist())


def _extract(batches: Iterator[pa.RecordBatch], says: list[float]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tg.blocks(batch.column(2)):
            part = batch.slice(block.lo, block.hi - block.lo)
            texts = [main_text(h, says) for h in part.column(2).to_pylist()]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                  names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``: the article's blocks joined by line breaks.

    ``weights``: of the text's properties, as of ``fit``; none: fitted to ``pages``. Null or empty html, and a page without
    content, give an empty text; a null page_id or url stays null. A page cut off anywhere is read up to the cut; very long and
    deeply nested pages are read whole. Other columns of ``pages`` are not looked at. Repeated rows stay repeated; an empty
    table gives an empty result.
    """
    says = costs(fit(pages) if weights is None else weights)
    kind = dict(pages.dtypes)
    return (pages.select("page_id", "url", F.col("html"))
            .mapInArrow(lambda it: _extract(it, says), f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long"))
