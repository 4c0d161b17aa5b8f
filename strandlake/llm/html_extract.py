"""Main text of web pages by a minimum cut.

A page is read into blocks (text between block-level tags).  A logistic classifier over
the block's features (elements around it, names of classes and ids, lengths, link
density, punctuation, place) gives a cost for calling it content and one for calling it
boilerplate: capacities from the source and to the sink.  Blocks that follow one
another or are siblings in the document tree are joined by smoothness edges, weaker
with distance in the tree.  The maximum flow's cut is the labelling of least total
cost.  Pages are independent: one pass, nothing shuffled.

The classifier is fitted on the blocks of at most ``fit_pages`` pages of least hash, at most
``fit_blocks`` evenly spaced ones of each.  Pages label themselves there: what stands in
``article`` or ``main`` is content, what stands in navigation, footers, forms and the like
is not, all else is left out.  Every labelled block is learned with its names and again
without them, so that text, links and place count on pages that name nothing.  Weights
are drawn to ``PRIOR``, which is the model where no page labels itself.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import least_hashed

NAME = re.compile(r"[^\s/>]*")
BEFORE = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
VALUE = re.compile(r"[^\s>]*")
SPACES = re.compile(r"\s+")
#: Element names of HTML by their meaning here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style noscript template svg math iframe object canvas audio video".split())
RAW = frozenset("script style noscript iframe template textarea title".split())
RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
BOILERPLATE = frozenset("nav footer aside form button select textarea dialog menu fieldset label option input".split())
CONTENT = frozenset("article main".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt rtc s samp small span strike strong sub sup time tt u var wbr label img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
HINT_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|header|masthead|topbar|foot(?:er)?|side(?:bar)?|aside|widget|related|recommend\w*|share|sharing|social|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|comments?|replies|reply|respond|discussion|disqus|copyright|legal|tags?|pagination|pager)(?=$|[\s_-])", re.I)
HINT_GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|main|story|post|entry|body|text)(?=$|[\s_-])", re.I)
ROLE_BAD = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


class Node:
    __slots__ = ("tag", "parent", "depth", "bad", "good", "named_bad", "named_good", "unseen", "link")

    def __init__(self, tag, parent, bad=False, good=False, named_bad=False, named_good=False, unseen=False, link=False):
        self.tag, self.parent, self.bad, self.good, self.unseen, self.link = tag, parent, bad, good, unseen, link
        self.named_bad, self.named_good = named_bad, named_good
        self.depth = parent.depth + 1 if parent else 0


class Block:
    __slots__ = ("parts", "node", "linked")

    def __init__(self):
        self.parts, self.node, self.linked = [], None, 0


def opened(tag: str, attributes: list[tuple[str, str]], parent: Node) -> Node:
    """The element in its parent: what the elements and the names around its text say."""
    bad, good, named_bad, named_good = parent.bad, parent.good, parent.named_bad, parent.named_good
    if tag in CONTENT:
        good = True
    elif tag in BOILERPLATE or (tag == "header" and not parent.good):
        bad = True
    if tag not in ("html", "body", *CONTENT):
        for name, value in attributes:
            if name == "role":
                bad |= value.lower() in ROLE_BAD
                good |= value.lower() in ("main", "article")
            elif name in ("class", "id"):
                if HINT_BAD.search(value):
                    named_bad |= not (tag == "header" and parent.good)
                elif HINT_GOOD.search(value):
                    named_good = True
    return Node(tag, parent, bad, good, named_bad, named_good, parent.unseen or tag in UNSEEN, parent.link or tag == "a")


def tag_end(page: str, at: int) -> tuple[list[tuple[str, str]], int, bool]:
    """Attributes of the tag whose name ends at ``at``, where the tag ends (-1: the page
    ends in it), and whether it closes itself, by the rules of HTML tokenisation."""
    out: list[tuple[str, str]] = []
    while True:
        begin, at = at, BEFORE.match(page, at).end()
        if at >= len(page):
            return out, -1, False
        if page[at] == ">":
            return out, at + 1, page[at - 1] == "/" and at > begin
        m = ATTRIBUTE.match(page, at)
        name, value, at = m[0].lower(), "", m.end()
        m = EQUALS.match(page, at)
        if m:
            at = m.end()
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote:
                end = page.find(quote, at + 1)
                if end < 0:
                    return out, -1, False
                value, at = page[at + 1 : end], end + 1
            else:
                m = VALUE.match(page, at)
                value, at = m[0], m.end()
        out.append((name, value))


def after_comment(page: str, at: int) -> int:
    """Where the markup declaration from ``<!``, ``<?`` or ``</`` at ``at`` ends."""
    if not page.startswith("<!--", at):
        end = page.find(">", at)
        return end + 1 if end >= 0 else len(page)
    if page.startswith(("<!-->", "<!--->"), at):
        return page.index(">", at) + 1
    ends = [(page.find(x, at + 4), len(x)) for x in ("-->", "--!>")] if "--!>" in page else [(page.find("-->", at + 4), 3)]
    ends = [e + n for e, n in ends if e >= 0]
    return min(ends) if ends else len(page)


def blocks_of(page: str) -> list[tuple[str, Node, int]]:
    """(text, element, characters in links) of each non-empty block in page order.

    Each character is read a bounded number of times, whatever the markup."""
    root = Node("", None)
    stack, out, block, at = [root], [], Block(), 0
    places: dict[str, list[int]] = {}  # of the open elements of each name in the stack
    solid = [0]  # of the open elements that are not inline

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        if node.tag not in INLINE:
            solid.append(len(stack))
        stack.append(node)

    def pop() -> None:
        node = stack.pop()
        places[node.tag].pop()
        if solid[-1] == len(stack):
            solid.pop()

    def flush() -> None:
        nonlocal block
        if block.parts:
            text = SPACES.sub(" ", html.unescape("".join(block.parts))).strip()
            if text:
                out.append((text, block.node, block.linked))
            block = Block()

    def add(text: str) -> None:
        node = stack[-1]
        if text and not node.unseen:
            block.parts.append(text)
            if not text.isspace():
                if block.node is None:
                    block.node = node
                    while block.node.parent and block.node.tag in INLINE:
                        block.node = block.node.parent
                if node.link:
                    block.linked += len(text)

    while at < len(page):
        here = page.find("<", at)
        if here < 0:
            add(page[at:])
            break
        add(page[at:here])
        closing = page.startswith("/", here + 1)
        letter = page[here + 1 + closing : here + 2 + closing]
        if not (letter.isascii() and letter.isalpha()):
            if closing or letter in ("!", "?") and letter:
                at = after_comment(page, here)
            else:
                add("<")
                at = here + 1
            continue
        m = NAME.match(page, here + 1 + closing)
        tag = m[0].lower()
        attributes, at, empty = tag_end(page, m.end())
        if at < 0:
            break
        if tag == "br":
            add(" ")
        elif closing:
            if tag not in INLINE:
                flush()
            open_ = places.get(tag)
            if open_ and (tag not in INLINE or open_[-1] > solid[-1]):
                while len(stack) > open_[-1] + 1:
                    pop()
                pop()
        else:
            if tag not in INLINE:
                flush()
                while len(stack) > 1 and stack[-1].tag in INLINE:  # inline elements left open end here
                    pop()
                if stack[-1].tag == "p" or stack[-1].tag in HEADINGS and tag in HEADINGS:
                    pop()
                ends = CLOSES.get(tag)
                if ends and stack[-1].tag in ends:
                    pop()
                    if tag == "tr" and stack[-1].tag == "tr":
                        pop()
            if tag in VOID:
                continue
            if tag in RAW:
                end = RAW_ENDS[tag].search(page, at)
                end = tag_end(page, end.end())[1] if end else -1
                at = end if end >= 0 else len(page)
            elif not empty:
                push(opened(tag, attributes, stack[-1]))
    flush()
    return out


#: What is measured of a block, and the weights to which a fit is drawn.
FEATURES = {
    "one": -1.5, "in_content": 3.0, "in_boilerplate": -9.0, "named_content": 2.0, "named_boilerplate": -9.0, "words": 1.0, "links": -4.0,
    "ends_sentence": 1.0, "paragraph": 0.6, "heading": 0.4, "rights": -4.0, "first": -0.3, "last": -0.3,
}
PRIOR = np.array(list(FEATURES.values()))
NAMES = [k for k, n in enumerate(FEATURES) if n.startswith(("in_", "named_"))]


def features(blocks: list[tuple[str, Node, int]]) -> np.ndarray:
    out = np.empty((len(blocks), len(FEATURES)))
    for k, (text, node, linked) in enumerate(blocks):
        place = k / max(1, len(blocks) - 1)
        out[k] = (
            1, node.good, node.bad, node.named_good, node.named_bad, math.log1p(text.count(" ")), min(1.0, linked / len(text)),
            text[-1] in ".!?:;”\"。", node.tag in ("p", "blockquote", "pre"), node.tag in HEADINGS, text[0] in "©®" or text[:9].lower() == "copyright", place < 0.05, place > 0.95,
        )
    return out


def own_labels(blocks: list[tuple[str, Node, int]]) -> np.ndarray:
    """1 for content, 0 for boilerplate, -1 where the page does not say."""
    return np.array([0 if n.bad or n.named_bad else 1 if n.good else -1 for _, n, _ in blocks])


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 3.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to PRIOR as by ``strength`` blocks of
    each kind; each block counts with its names and without, both kinds alike."""
    if not len(x):
        return PRIOR.copy()
    bare = x.copy()
    bare[:, NAMES] = 0
    x, y = np.concatenate((x, bare)), np.concatenate((y, y))
    weight = np.where(y == 1, 1 / max(1, y.sum()), 1 / max(1, (1 - y).sum())) * min(len(y) / 2, 500)
    w = PRIOR.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (y - p)) - strength * (w - PRIOR)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), grad)
        w += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def nearness(a: Node, b: Node) -> float:
    """1 for blocks of one element, less with the steps between them in the tree (64 steps
    and more count alike)."""
    steps = 0
    while a is not b and steps < 64:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return 1.0 / (1.0 + 0.5 * steps)


def min_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut (Dinic's algorithm)."""
    n = len(source)
    s, t = n, n + 1
    to, cap, adj = [], [], [[] for _ in range(n + 2)]

    def join(a: int, b: int, forth: float, back: float) -> None:
        adj[a].append(len(to))
        to.append(b)
        cap.append(forth)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for k in range(n):
        if source[k] > 0:
            join(s, k, source[k], 0.0)
        if sink[k] > 0:
            join(k, t, sink[k], 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s], queue = 0, deque([s])
        while queue:
            u = queue.popleft()
            for e in adj[u]:
                if cap[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:  # blocking flow by depth-first walks, without recursion
            if u == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= 1e-9)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while nxt[u] < len(adj[u]):
                e = adj[u][nxt[u]]
                if cap[e] > 1e-9 and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if not path:
                    break
                u = to[path.pop() ^ 1]
                nxt[u] += 1
                continue
            path.append(e)
            u = to[e]


def labelled(page: str | None, weights: np.ndarray, adjacency: float, siblings: float) -> tuple[list[str], np.ndarray, list[bool]]:
    """Texts of the page's blocks, their evidence for content, and the minimum cut's labels."""
    blocks = blocks_of(page or "")
    if not blocks:
        return [], np.zeros(0), []
    z = np.clip(features(blocks) @ weights, -12, 12).tolist()
    edges, last = [], {}
    for k, (_, node, _) in enumerate(blocks):
        if k:
            edges.append((k - 1, k, adjacency * nearness(blocks[k - 1][1], node)))
        up = id(node.parent or node)
        if up in last and last[up] < k - 1:
            edges.append((last[up], k, siblings * nearness(blocks[last[up]][1], node)))
        last[up] = k
    return [b[0] for b in blocks], np.array(z), min_cut([max(0.0, x) for x in z], [max(0.0, -x) for x in z], edges)


def content_blocks(page: str | None, weights: np.ndarray = PRIOR, adjacency: float = 3.0, siblings: float = 1.5) -> list[str]:
    texts, _, keep = labelled(page, weights, adjacency, siblings)
    return [t for t, k in zip(texts, keep) if k]


def learn_weights(df: DataFrame, html_col: str = "html", fit_pages: int = 500, fit_blocks: int = 200) -> np.ndarray:
    """Weights from a bounded sample of pages that label their blocks themselves."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, u in zip(batch.column(0), batch.column(1).to_pylist()):
                blocks = blocks_of(page.as_py())
                y = own_labels(blocks)
                at = np.flatnonzero(y >= 0)
                at = at[np.unique(np.linspace(0, len(at) - 1, min(len(at), fit_blocks)).astype(int))] if len(at) else at
                x = features(blocks)[at]
                yield pa.RecordBatch.from_arrays([pa.array([u], pa.int64()), pa.array([x.ravel()], pa.list_(pa.float64())), pa.array([y[at]], pa.list_(pa.int64()))], ["u", "x", "y"])

    few = least_hashed(df.filter(F.col(html_col).isNotNull()).select(html_col), F.xxhash64(F.lit(13), html_col), fit_pages)
    got = sorted((r["u"], r["x"], r["y"]) for r in few.repartition(8).mapInArrow(task, "u long, x array<double>, y array<long>").collect())  # fit_pages rows
    x = np.concatenate([np.reshape(r[1], (-1, len(PRIOR))) for r in got]) if got else np.zeros((0, len(PRIOR)))
    return fit_weights(x, np.array([y for r in got for y in r[2]], float))


def extract_main_text(df: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ("page_id", "url"), with_blocks: bool = False, weights: np.ndarray | None = None) -> DataFrame:
    """One row for each row: the columns in ``carry``, ``text`` and ``n_chars``.

    A null or empty page, or one without content, has an empty text; an empty table gives
    no rows.  Broken markup is read as far as it goes: unclosed elements end with their
    parent, an unclosed comment, tag or script reaches to the end.  Repeated rows are rows
    like any other.  Columns that are not carried cannot clash; a carried one named like a
    column of the result is an error.  ``weights``: of a classifier fitted before
    (``learn_weights``).  ``with_blocks`` adds the blocks as ``blocks``."""
    clash = {"text", "n_chars", "blocks"} & set(carry)
    if clash:
        raise ValueError(f"columns of the input have names of the result: {sorted(clash)}")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    w = learn_weights(df, html_col) if weights is None else weights  # a few numbers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                kept = [content_blocks(x.as_py(), w) for x in part.column(len(carry))]
                texts = [" ".join(x) for x in kept]
                data = [*part.columns[: len(carry)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(data + [pa.array(kept, pa.list_(pa.string()))] * with_blocks, [*carry, "text", "n_chars"] + ["blocks"] * with_blocks)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + ", text string, n_chars long" + ", blocks array<string>" * with_blocks
    return df.select(*carry, html_col).mapInArrow(task, schema)
