"""Main text of web pages by a minimum cut.

A page becomes a row of text blocks (``blocks``): stretches of text between block
tags, with the tags around them. Each block has a cost for being called content and
one for being called boilerplate, from what its tags, class names, length, links and
punctuation say (``costs``); these are its capacities from the source and to the
sink. Blocks that follow each other, and blocks with the same parent or the same
grandparent, are tied by edges whose capacity is the price of calling them
differently. The minimum cut is the cheapest labelling; the blocks on the source's
side are the main text. The maximum flow is found by Dinic's algorithm after blocks
that no cut can move (their own preference exceeds all their ties) are put on their
side. What is never text (scripts, styles, forms, comments, hidden parts) is left out
before.

Cases: a null, empty or text-free page gives an empty text; unclosed, stray and
unended tags and unended comments are read as far as they go; repeated rows and ids
keep a row each; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import html as references
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements by what they mean for the text inside.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas head title select textarea button form input option audio video map datalist dialog".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOILERPLATE = frozenset("nav footer aside menu header".split())
CONTENT = frozenset("article main".split())
CLOSES_P = BLOCK - {"br"}
_BAD = re.compile(
    r"(?:^|[\s_-])(?:nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side-?bar|widgets?|foot(?:er)?|ads?|adverts?|advertisement|advertorial|"
    r"sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|notices?|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|share|sharing|related|"
    r"recommended|comments?|disqus|respond|replies|reply|pagination|pager|copyright|legal|disclaimer|toolbar|skip|hidden|alert|notification)(?:$|[\s_-])", re.I)
_HEAD = re.compile(r"(?:^|[\s_-])(?:head(?:er)?|masthead|banner)(?:$|[\s_-])", re.I)
_STICKY = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|respond|replies)(?:$|[\s_-])", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|post|story|entry|content|main|body|text|prose|page-?content)(?:$|[\s_-])", re.I)
_ROLES = {"navigation": False, "banner": False, "contentinfo": False, "complementary": False, "search": False, "dialog": False, "alert": False,
          "alertdialog": False, "form": False, "main": True, "article": True}
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    """One stretch of text with its place in the page: the two innermost containers."""

    text: str
    path: tuple[int, ...]
    bad: bool
    good: bool
    heading: bool
    linked: float


@dataclass
class _Element:
    """An open element, with what it and all around it say of the text inside."""

    name: str
    number: int
    any_good: bool
    skipped: bool
    sticky: bool  # nothing inside can be content
    verdict: tuple[bool, bool]  # good, bad: the innermost that says something decides
    linked: bool
    heading: bool
    containers: tuple[int, ...]  # the two innermost


_OUTSIDE = _Element("", 0, False, False, False, (False, False), False, False, ())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@dataclass
class _Reader:
    """Walks over the tags of one page and cuts its text into blocks. What a tag costs
    does not depend on how many elements are open."""

    stack: list[_Element] = field(default_factory=lambda: [_OUTSIDE])
    places: dict[str, list[int]] = field(default_factory=dict)  # of open elements, by name
    out: list[Block] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    count: int = 0

    def text(self, raw: str) -> None:
        if raw and not self.stack[-1].skipped:
            value = references.unescape(raw) if "&" in raw else raw
            self.pieces.append(value)
            if self.stack[-1].linked:
                self.linked += len(value)

    def cut(self) -> None:
        joined = "".join(self.pieces)
        text = " ".join(joined.split())
        if text:
            inside = self.stack[-1]
            good, bad = inside.verdict
            self.out.append(Block(text, inside.containers, bad, good, inside.heading, self.linked / max(1, len(joined))))
        self.pieces.clear()
        self.linked = 0

    def _push(self, name: str, good: bool, bad: bool, skipped: bool, sticky: bool) -> None:
        around, self.count = self.stack[-1], self.count + 1
        verdict = around.verdict
        if not around.sticky:
            verdict = (False, True) if sticky else (good, bad) if good or bad else verdict
        container = name in BLOCK and name not in ("p", "br")
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(_Element(
            name, self.count, around.any_good or good, around.skipped or skipped, around.sticky or sticky, verdict,
            around.linked or name == "a", around.heading or name in _HEADINGS,
            (*around.containers, self.count)[-2:] if container else around.containers))

    def _innermost(self, name: str) -> int:
        """Where the innermost open element of this name is, 0 if none is open."""
        return self.places[name][-1] if self.places.get(name) else 0

    def _drop(self, at: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()

    def open(self, name: str, attributes: str) -> None:
        if name in CLOSES_P:
            self.cut()
            self.close_until("p", ("table", "td", "th", "div", "section", "article", "body"))
            if name == "li":
                self.close_until("li", ("ul", "ol", "menu"))
        elif name == "br":
            self.pieces.append(" ")
        if name in VOID:
            return
        good, bad, skipped = name in CONTENT, name in BOILERPLATE, name in SKIPPED
        inside = self.stack[-1].any_good
        if name == "header" and inside:
            bad = False  # the head of an article holds its title
        sticky = bad
        if attributes:
            for key, value in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] else value
                if key in ("class", "id"):
                    bad = bad or _BAD.search(value) is not None or (not inside and _HEAD.search(value) is not None)
                    sticky = sticky or _STICKY.search(value) is not None
                    good = good or (not bad and _GOOD.search(value) is not None)
                elif key == "role":
                    bad, good = (not _ROLES[value], _ROLES[value]) if value in _ROLES else (bad, good)
                elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
                    skipped = True
        if name in ("body", "html"):
            bad = sticky = False
        self._push(name, good and not bad, bad, skipped, sticky)

    def close_until(self, name: str, stop: tuple[str, ...]) -> None:
        """Close the innermost ``name`` unless one of ``stop`` is open inside it."""
        at = self._innermost(name)
        if at and at > max(map(self._innermost, stop)):
            self._drop(at)

    def close(self, name: str) -> None:
        if name in BLOCK:
            self.cut()
        if at := self._innermost(name):
            self._drop(at)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in page order."""
    reader, at, size = _Reader(), 0, len(page)
    while at < size:
        match = _TAG.search(page, at)
        if match is None:
            reader.text(page[at:] if not page.startswith("<", at) or not page[at + 1:at + 2].isalpha() else "")
            break
        if match.start() > at:
            reader.text(page[at:match.start()])
        at = match.end()
        name = match[2]
        if name is None:
            continue  # a comment or a declaration
        name = name.lower()
        if match[1]:
            reader.close(name)
            continue
        if name in RAW and not match[3].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        reader.open(name, match[3])
    reader.cut()
    return reader.out


def costs(block: Block) -> tuple[float, float]:
    """What it costs to call the block boilerplate, and to call it content."""
    words = block.text.count(" ") + 1
    keep, drop = 1.0, 1.0
    if block.bad:
        drop += 12.0
    if block.good:
        keep += 9.0
    if block.heading:
        keep += 1.0
    keep += min(words, 40) / 10
    drop += 6.0 * block.linked if not block.good or words > 1 else 2.0 * block.linked
    if block.text[-1] in ".!?…\"'»”" and words > 3:
        keep += 1.0
    elif words < 4:
        drop += 0.8
    if "©" in block.text and words < 30:
        drop += 2.0 if block.good else 6.0
    return keep, drop


# Price of a change of label between neighbours, siblings, and cousins.
NEXT, SAME_PARENT, SAME_GRANDPARENT = 0.5, 1.0, 0.4


def edges(page: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness edges: each block to the next one, and to the last one before it in
    the same parent and in the same grandparent."""
    found: dict[tuple[int, int], float] = {}
    last: dict[tuple[int, ...], int] = {}

    def tie(a: int, b: int, price: float) -> None:
        found[a, b] = found.get((a, b), 0.0) + price

    for at, block in enumerate(page):
        if at:
            tie(at - 1, at, NEXT)
        for levels, price in ((0, SAME_PARENT), (1, SAME_GRANDPARENT)):
            if len(block.path) > levels:
                place = (levels, block.path[-1 - levels])
                if place in last:
                    tie(last[place], at, price)
                last[place] = at
    return found


def minimum_cut(keep: list[float], drop: list[float], ties: dict[tuple[int, int], float]) -> list[bool]:
    """For each node whether a minimum cut leaves it with the source: ``keep`` are the
    capacities from the source, ``drop`` to the sink, ``ties`` both ways between two."""
    n = len(keep)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), capacity in ties.items():
        around[a][b] = around[a].get(b, 0.0) + capacity
        around[b][a] = around[b].get(a, 0.0) + capacity
    lean = [k - d for k, d in zip(keep, drop)]
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:  # nodes that no cut can move take their side, and pull their neighbours
        at = queue.popleft()
        if label[at] is not None or abs(lean[at]) <= sum(around[at].values()):
            continue
        label[at] = lean[at] > 0
        for other, capacity in around[at].items():
            lean[other] += capacity if label[at] else -capacity
            del around[other][at]
            queue.append(other)
        around[at] = {}
    open_ = [at for at in range(n) if label[at] is None]
    if open_:
        for at, side in zip(open_, _flow(lean, around, open_)):
            label[at] = side
    return [bool(side) for side in label]


def _flow(lean: list[float], around: list[dict[int, float]], nodes: list[int]) -> list[bool]:
    """Dinic's algorithm on what is left; ``lean`` above 0 is capacity from the source."""
    place = {node: at + 2 for at, node in enumerate(nodes)}
    residual: list[dict[int, float]] = [{} for _ in range(len(nodes) + 2)]
    for node in nodes:
        at = place[node]
        if lean[node] > 0:
            residual[0][at], residual[at][0] = lean[node], 0.0
        elif lean[node] < 0:
            residual[at][1], residual[1][at] = -lean[node], 0.0
        for other, capacity in around[node].items():
            residual[at][place[other]] = capacity
    while True:
        level = {0: 0}
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for other, capacity in residual[at].items():
                if capacity > 1e-9 and other not in level:
                    level[other] = level[at] + 1
                    queue.append(other)
        if 1 not in level:
            return [place[node] in level for node in nodes]
        choices = [iter(list(out)) for out in residual]
        path = [0]
        while path:
            at = path[-1]
            if at == 1:
                amount = min(residual[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    residual[a][b] -= amount
                    residual[b][a] += amount
                path = [0]
                choices = [iter(list(out)) for out in residual] if len(residual) < 64 else choices
                continue
            for other in choices[at]:
                if residual[at][other] > 1e-9 and level.get(other) == level[at] + 1:
                    path.append(other)
                    break
            else:
                level[at] = -1
                path.pop()


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    keep, drop = zip(*map(costs, found))
    labels = minimum_cut(list(keep), list(drop), edges(found))
    return " ".join(block.text for block, content in zip(found, labels) if content)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
