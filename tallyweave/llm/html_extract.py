"""HTML extraction by minimum-cut labelling of a page's text blocks.

A page is cut into blocks at block-level tags. A logistic classifier, trained here on made-up pages,
gives each block a cost for either label; the costs are the capacities to two terminals. Neighbouring
blocks, and blocks whose containers are close in the DOM, are tied by smoothness edges. The minimum cut
(by maximum flow) labels all blocks of the page at once, and the content side is the text.

Pages are read by the rules of HTML where they bear on text: end tags that may be left out, void elements,
self-closed foreign ones, and raw text, which only script, style, title and textarea hold to the end of the
page if unclosed. An element that is not shown (noscript, svg, button, ...) and has no end tag after it ends
before the next block. Words of class, id and role are features among others: whole tokens that do not state a mere
condition ("has-comments", "no-sidebar"), of the nearest container that has any and of those above it, and
none of a container that holds the page's heading.

Defined cases: null, empty or tagless html gives its own text or the empty string; cut-off pages are read
to their end; a tag that is never closed ends with its container; very deep pages need no recursion;
repeated rows each get their row; a null page_id stays null; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import null_ids, whole_id

# Names of HTML elements by their role, and words of class, id and role attributes.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("noscript template select button svg math iframe object canvas audio video datalist noembed noframes".split())
_FOREIGN, _OPEN = frozenset(("svg", "math")), "?"
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = frozenset("ul ol dl table div section article main aside nav header footer form body blockquote td".split())
_BAD_WORDS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup "
    "modal overlay newsletter subscribe subscription signup signin login register sidebar widget widgets related recommended "
    "recommendations more share sharing social breadcrumb breadcrumbs crumbs menu nav navbar navigation toolbar pagination pager footer "
    "masthead topbar header search comment comments reply replies respond disqus discussion feedback review reviews form contact tags "
    "copyright legal disclaimer skip hidden complementary contentinfo dialog".split()
)
_GOOD_WORDS = frozenset("article main content post entry story text body page blog news chapter prose markdown".split())
_COMMENT_WORDS = frozenset("comment comments reply replies respond disqus discussion feedback review reviews".split())
_CONDITIONS = frozenset("has have no not with without is can allow hide show enable disable supports".split())

_ATTRIBUTES = r"((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|title|textarea)\b(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*){_ATTRIBUTES}>|<[!?/][^>]*>|<[a-zA-Z][^>]*>|<[a-zA-Z/!?][^>]*\Z",
    re.S | re.I,
)
_HINTS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_UNSHOWN = re.compile(r"(?:^|\s)hidden(?=\s|=|/|\Z)|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

FEATURES = (
    "bias nav header footer aside form near_bad near_good above_bad above_good inside comments link_share short medium long heading list_item paragraph "
    "sentence body_only"
).split()


class Block:
    """A block of text: its element's tag, the number of its container, how much of it is links, and what its
    containers say: `above` all of them, `near` the nearest one whose names say anything."""

    __slots__ = ("above", "links", "near", "parent", "tag", "text")

    def __init__(self, text: str, tag: str, node: int, parent: int, links: int):
        self.text, self.tag, self.near, self.parent, self.links, self.above = text, tag, node, parent, links, frozenset()

    @property
    def flags(self) -> frozenset:
        return self.above


_NONE: frozenset = frozenset()


@lru_cache(maxsize=4096)
def _named(attributes: str) -> frozenset:
    """What the names of a container say: bad, good, comments."""
    out = set()
    if _UNSHOWN.search(attributes):
        out.add("bad")
    for m in _HINTS.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").lower().split():
            parts = _PART.findall(token)
            if not parts or parts[0] in _CONDITIONS:
                continue
            if _COMMENT_WORDS.intersection(parts):
                out.add("comments")
            if _BAD_WORDS.intersection(parts):
                out.add("bad")
            elif _GOOD_WORDS.intersection(parts):
                out.add("good")
    return frozenset(out)


class _Nodes:
    """The page's containers in order: parent, tag, names, and whether they hold a heading or an article."""

    def __init__(self):
        self.parent, self.tag, self.named, self.holds = [0], [""], [_NONE], [set()]

    def add(self, parent: int, tag: str, attributes: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        # Classes of the whole page are conditions of its theme.
        self.named.append(_named(attributes) if attributes and tag not in ("html", "body") else _NONE)
        self.holds.append(set())
        return len(self.parent) - 1

    def mark(self, node: int, what: str) -> None:
        while what not in self.holds[node]:
            self.holds[node].add(what)
            node = self.parent[node]

    def said(self) -> tuple[list[frozenset], list[frozenset]]:
        """For each node what all containers from it up say, and the nearest one that says anything."""
        above, near = [_NONE], [_NONE]
        for n in range(1, len(self.parent)):
            up, tag, own, holds = self.parent[n], self.tag[n], self.named[n], self.holds[n]
            if own and "h1" in holds:
                own = own - {"bad", "comments"}
            elif "bad" in own and "comments" not in own and "article" in holds:
                own = own - {"bad"}
            said = own | {tag} if tag in ("nav", "header", "footer", "aside", "form", "article", "main") else own
            above.append(above[up] | said if said else above[up])
            near.append(own or near[up])
        return above, near


def blocks(page: str | None) -> list[Block]:
    """The page's blocks of text that are not empty, in order."""
    page = page or ""
    nodes, out, held = _Nodes(), [], []
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, node, whether it or one above is not shown
    closing: dict[str, int] = {}  # where the last end tag of a hidden element begins
    links, in_link, at, low = 0, 0, 0, None

    def flush() -> None:
        nonlocal links
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                tag, node, _ = stack[-1]
                inner = tag in ("p", "li") or tag[:1] == "h" and tag[1:].isdigit()
                out.append(Block(text, tag, node, nodes.parent[node] if inner else node, min(links, len(text))))
            held.clear()
        links = 0

    def text(part: str) -> None:
        nonlocal links
        if not stack[-1][2]:
            held.append(part)
            if in_link:
                links += len(part)

    def pop(tag: str) -> None:
        for n in range(len(stack) - 1, 0, -1):
            if stack[n][0] == tag:
                del stack[n:]
                return

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        end, tag, attributes = m[3], (m[4] or "").lower(), m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>")))
            elif not m[0].startswith("<!--"):
                text(" ")
            continue
        hidden = stack[-1][2]
        if tag in _HIDDEN:
            if end:
                pop(tag)
                continue
            if tag not in _FOREIGN and tag != "object" and any(x[0] == tag for x in stack):
                pop(tag)  # these do not nest
                hidden = stack[-1][2]
            if tag not in closing:
                low = page.lower() if low is None else low
                closing[tag] = low.rfind(f"</{tag}")
            text(" ")
            if not attributes.rstrip().endswith("/"):
                # without an end tag it is taken to end before the next block
                stack.append((tag if closing[tag] >= at else _OPEN, stack[-1][1], True))
        elif tag == "br":
            text(" ")
        elif tag == "a":
            in_link = 0 if end else 1
        elif tag in _BLOCKS:
            while stack[-1][0] == _OPEN or not end and stack[-1][0] in _FOREIGN:  # a block breaks out of foreign content
                stack.pop()
            hidden = stack[-1][2]
            if not hidden:
                flush()
                in_link = 0
            if end:
                if hidden:  # an end tag of something outside ends what is hidden inside
                    inner = next((n for n in range(len(stack) - 1, 0, -1) if stack[n][0] == tag), 0)
                    if inner and not stack[inner][2]:
                        del stack[inner + 1 :]
                        flush()
                pop(tag)
            elif tag not in _VOID:
                if tag != "p" or stack[-1][0] == "p":
                    while len(stack) > 1 and stack[-1][0] == "p":
                        stack.pop()
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n][0] in _CLOSES.get(tag, ()):
                        del stack[n:]
                        break
                    if stack[n][0] in _STOPS:
                        break
                up = stack[-1][1]
                node = nodes.add(up, tag, attributes)
                if tag == "h1" or tag == "main":
                    nodes.mark(up, "h1")
                elif tag == "article":
                    nodes.mark(up, "article")
                stack.append((tag, node, hidden))
    if at < len(page):
        text(page[at:])
    flush()
    above, near = nodes.said()
    for b in out:
        b.above, b.near = above[b.near], near[b.near]
    return out


def features(found: list[Block]) -> np.ndarray:
    out = np.zeros((len(found), len(FEATURES)))
    for row, b in zip(out, found):
        size, flags = len(b.text), b.above
        inside = "article" in flags or "main" in flags
        row[:] = (
            1,
            "nav" in flags,
            "header" in flags and not inside,
            "footer" in flags,
            "aside" in flags,
            "form" in flags,
            "bad" in b.near,
            "good" in b.near,
            "bad" in flags,
            "good" in flags,
            inside,
            "comments" in flags,
            b.links / size,
            size < 25,
            25 <= size < 120,
            size >= 120,
            b.tag[0:1] == "h" and b.tag[1:].isdigit(),
            b.tag in ("li", "dd", "dt", "td", "th"),
            b.tag in ("p", "blockquote", "pre"),
            b.text[-1] in ".!?…。\"'”»",
            not flags,
        )
    return out


def _made_page(rng: random.Random) -> tuple[str, list[str]]:
    """A made-up page and the texts of its content blocks."""
    word = lambda: "".join(rng.choice("aeioubcdfglmnprst") for _ in range(rng.randrange(2, 9)))
    line = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b))).capitalize() + rng.choice([".", ".", "!", ""])
    link = lambda: f'<a href="/{word()}">{line(1, 4)}</a>'
    listed = lambda n: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
    semantic, named = rng.random() < 0.7, rng.random() < 0.8
    wrap = lambda tag, names, inner: f"<{tag if semantic else 'div'}{f' class={chr(34)}{rng.choice(names)}{chr(34)}' if named else ''}>{inner}</{tag if semantic else 'div'}>"
    content = [line(3, 9)]
    body = f"<h1>{content[0]}</h1>"
    for _ in range(rng.randrange(2, 12)):
        kind = rng.random()
        text = line(1, 4) if kind < 0.15 else line(8, 60)
        content.append(text)
        body += f"<h2>{text}</h2>" if kind > 0.9 else f"<blockquote>{text}</blockquote>" if kind > 0.85 else f"<ul><li>{text}</li></ul>" if kind > 0.8 else f"<p>{text}</p>"
        if rng.random() < 0.1:
            body += wrap("aside", ["ad", "promo-box", "related"], f"<p>{line(2, 12)}</p>")
    if rng.random() < 0.3:
        body += f'<div class="{rng.choice(["comments", "comment-list", "replies"])}"><h3>{line(1, 3)}</h3>' + "".join(f"<p>{line(3, 30)}</p>" for _ in range(rng.randrange(1, 5))) + "</div>"
    parts = [wrap("nav", ["menu", "navbar", "nav"], listed(rng.randrange(3, 9)))]
    if rng.random() < 0.5:
        parts.append(wrap("header", ["site-header", "masthead"], f"<p>{line(1, 6)}</p>" + listed(2)))
    if rng.random() < 0.5:
        parts.append(f'<div class="{rng.choice(["ad", "banner", "cookie-notice", "sponsored", "newsletter"])}">{line(2, 20)}</div>')
    parts.append(wrap("article", ["post", "article", "content", "entry-content", "post has-comments", "story with-sidebar"], body) if rng.random() < 0.9 else body)
    if rng.random() < 0.5:
        parts.append(wrap("aside", ["sidebar", "widget", "related"], f"<h3>{line(1, 4)}</h3>" + listed(4) + f"<p>{line(2, 14)}</p>"))
    if rng.random() < 0.3:
        parts.append(f"<form><p>{line(2, 9)}</p><label>{line(1, 3)}</label><input></form>")
    if rng.random() < 0.3:
        parts.append(f'<section id="comments"><h3>{line(1, 3)}</h3>' + "".join(f"<div><p>{line(3, 40)}</p></div>" for _ in range(3)) + "</section>")
    parts.append(wrap("footer", ["footer", "site-footer"], f"<p>&copy; {line(2, 12)}</p>" + (listed(3) if rng.random() < 0.5 else "")))
    inner = "".join(parts)
    if rng.random() < 0.3:  # names of a theme around everything
        inner = f'<div class="{rng.choice(["layout", "wrapper sidebar-right", "site header-fixed", "page no-sidebar", "main-content no-menu"])}">{inner}</div>'
    return rng.choice(["<html><head><title>t</title></head><body>", "<html><head><title>t</title><body>", "<body class='comments-open'>"]) + inner + "</body></html>", content


@lru_cache(maxsize=4)
def train(pages: int = 400, seed: int = 7, rounds: int = 12, ridge: float = 0.3) -> tuple[float, ...]:
    """Weights of the block classifier: logistic regression on made-up pages, by Newton steps."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page, content = _made_page(rng)
        found, wanted = blocks(page), set(content)
        xs.append(features(found))
        ys += [b.text in wanted and "comments" not in b.flags for b in found]
    x, y, w = np.concatenate(xs), np.array(ys, float), np.zeros(len(FEATURES))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, x.T @ (y - p) - ridge * w)
    return tuple(w.tolist())


def minimum_cut(unary: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of the costs against unary (positive: content) and of cut edges.

    A node whose own cost outweighs all its edges keeps its side in any minimum; such nodes are settled
    first, and a maximum flow settles what is left."""
    n = len(unary)
    cost, near = list(unary), [dict() for _ in range(n)]
    for a, b, w in edges:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = list(range(n))
    while queue:
        a = queue.pop()
        if label[a] is None and abs(cost[a]) >= sum(near[a].values()):
            label[a] = cost[a] > 0
            for b, w in near[a].items():
                del near[b][a]
                cost[b] += w if label[a] else -w
                queue.append(b)
            near[a] = {}
    left = [a for a in range(n) if label[a] is None]
    if left:
        for a, inside in zip(left, _source_side(left, cost, near)):
            label[a] = inside
    return [bool(x) for x in label]


def _source_side(left: list[int], cost: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Which nodes a maximum flow (Dinic: shortest paths, blocking flows) leaves joined to the source."""
    place = {a: n for n, a in enumerate(left)}
    source, sink = len(left), len(left) + 1
    heads: list[list[int]] = [[] for _ in range(len(left) + 2)]
    to: list[int] = []
    room: list[float] = []

    def arc(a: int, b: int, there: float, back: float) -> None:
        heads[a].append(len(to))
        heads[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for n, a in enumerate(left):
        arc(*((source, n) if cost[a] > 0 else (n, sink)), abs(cost[a]), 0.0)
        for b, w in near[a].items():
            if a < b:
                arc(n, place[b], w, w)
    tiny = 1e-12
    while True:
        level = [-1] * len(heads)
        level[source], todo = 0, deque([source])
        while todo:
            a = todo.popleft()
            for e in heads[a]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[: len(left)]]
        tried, path, a = [0] * len(heads), [], source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(n for n, e in enumerate(path) if room[e] <= tiny)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[a] < len(heads[a]):
                e = heads[a][tried[a]]
                if room[e] > tiny and level[to[e]] == level[a] + 1:
                    break
                tried[a] += 1
            if tried[a] < len(heads[a]):
                path.append(heads[a][tried[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                tried[a] += 1
            else:
                break


def labels(found: list[Block], weights: np.ndarray, adjacency: float = 0.5, proximity: float = 0.5, bound: float = 8.0) -> list[bool]:
    if not found:
        return []
    unary = np.clip(features(found) @ weights, -bound, bound).tolist()
    edges, last = [], {}
    for n, b in enumerate(found):
        if n:
            edges.append((n - 1, n, adjacency))
        if b.parent in last:
            edges.append((last[b.parent], n, proximity))
        last[b.parent] = n
    return minimum_cut(unary, edges)


def main_text(page: str | None, weights: np.ndarray) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, labels(found, weights)) if keep)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""
    weights = np.array(train())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x, weights) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    source = pages.select(whole_id("page_id"), "url", F.col(html_col).alias("html"))
    return null_ids(source.mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint"), "page_id")
