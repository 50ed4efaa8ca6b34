"""Main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks of text at block-level tags. Each block is a node of a graph:
its classifier costs (ancestor elements, class and id words, link share, length,
punctuation) are the capacities of its terminal edges, and smoothness edges join it to
the next block and to the next block of the same parent, stronger the closer the two
stand in the document tree. The minimum cut between the content and the boilerplate
terminal is the labelling of least total cost.

Marks (``article``, ``nav``, words of class and id) shift the odds by as much as edges can
outweigh; only forms and what isn't shown are certain. Blocks whose terminal edges differ
by more than all their smoothness edges together are on the known side of every minimum
cut and are settled before the flow is computed over the rest.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import small_batches

# Elements and words of the classifier.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style noscript template iframe noembed noframes textarea title svg math object xmp".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOILERPLATE_TAGS = frozenset("aside footer header menu nav search".split())
NEVER_TAGS = frozenset("button datalist dialog form head optgroup option select".split())
CONTENT_TAGS = frozenset(["article", "main"])
#: Elements whose class or id can mark what they hold as content.
CONTAINERS = frozenset("article body center div main section table tbody td tr".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adbox advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header login masthead menu modal nav navbar navigation newsletter notice pagination paywall popup promo promotion reader-comments related respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
CONTENT_WORDS = frozenset("article articlebody body content entry main post story text".split())
#: Elements a tag of this name closes if they are open inside the same parent.
CLOSED_BY = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

_NAME = re.compile(r"[a-zA-Z][^\s/>\"']*")
_MARK = re.compile(r"[>\"']")
_HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SENTENCE = re.compile(r"[.!?…。](?:\s|$)")
_WORD = re.compile(r"[a-z]+(?:-[a-z]+)?|[a-z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)


class _Element:
    __slots__ = ("block", "depth", "kind", "link", "marked", "name", "parent")

    def __init__(self, name: str, parent: _Element | None, kind: int, link: bool):
        self.name, self.parent, self.kind, self.link = name, parent, kind, link
        self.depth = parent.depth + 1 if parent else 0
        self.block = self if parent is None or name in BLOCK_TAGS else parent.block  # the nearest block element
        self.marked = parent.marked if parent is not None and parent.kind == kind else self  # the outermost around it of its kind


def _kind(name: str, attributes: str, above: int) -> int:
    """What an element says of its text: 3 never content (forms, what isn't shown), 2 likely
    boilerplate, 1 likely content, 0 nothing."""
    if above == 3 or name in NEVER_TAGS or attributes and _HIDDEN.search(attributes):
        return 3
    if above == 2 or name in BOILERPLATE_TAGS and not (name == "header" and above == 1):
        return 2
    if attributes:
        words = {w for m in _HINTS.finditer(attributes) for v in m.groups() if v for w in _WORD.findall(v.lower()) + v.lower().split()}
        words |= {part for w in words for part in w.split("-")}
        if words & BOILERPLATE_WORDS:
            return 2
        if name in CONTAINERS and words & CONTENT_WORDS:
            return 1
    return 1 if name in CONTENT_TAGS else above


class Block:
    __slots__ = ("kind", "linked", "name", "parent", "text")

    def __init__(self, text: str, linked: int, parent: _Element):
        self.text, self.linked, self.parent = text, linked, parent
        self.kind, self.name = parent.kind, parent.name


class _Tokens:
    """Tags, comments and declarations of a page in time linear in its length, however malformed."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.failed: set[int] = set()  # marks from which on no tag ends outside quotes

    def _tag_end(self, at: int) -> int:
        """Where the tag ends whose name ends at ``at``: the next > outside quotes, or else the next one."""
        seen, here = [], at
        while True:
            m = _MARK.search(self.page, here)
            if m is None or m.start() in self.failed:
                break
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            here = self.page.find(m[0], m.end()) + 1
            if not here:
                break
        self.failed.update(seen)
        return self.page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """The first token from ``at`` on: start, end, name (lower case; empty for comments and
        declarations), whether it closes, attributes."""
        page = self.page
        while (start := page.find("<", at)) >= 0:
            after = page[start + 1 : start + 2]
            if after == "!" or after == "?":
                mark = "-->" if page.startswith("<!--", start) else ">"
                end = page.find(mark, start + (4 if mark == "-->" else 2))
                return start, len(page) if end < 0 else end + len(mark), "", False, ""
            closes = after == "/"
            name = _NAME.match(page, start + 1 + closes) if start < self.last else None
            if name is not None and name.end() <= self.last:
                end = self._tag_end(name.end())
                return start, end + 1, name[0].lower(), closes, page[name.end() : end]
            at = start + 1
        return None


def blocks_of(page: str) -> list[Block]:
    """The page's blocks that hold text, in page order."""
    at = _Element("", None, 0, False)
    open_elements: dict[str, list[_Element]] = {}  # by name, those around ``at``
    found: list[Block] = []
    parts: list[str] = []
    linked, n, end = 0, 0, len(page)
    tokens = _Tokens(page)
    raw_ends: dict[str, bool] = {}

    def close(owner: _Element) -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append(Block(text, min(linked, len(text)), owner))
            parts.clear()
        linked = 0

    def leave(to: _Element) -> None:
        """Go up to the parent of ``to``, which is open."""
        nonlocal at
        while True:
            open_elements[at.name].pop()
            at, done = at.parent, at is to
            if done:
                return

    while n < end:
        token = tokens.next(n)
        stop = token[0] if token else end
        if stop > n:
            text = html.unescape(page[n:stop])
            parts.append(text)
            if at.link:
                linked += len(text.strip())
        if not token:
            break
        _, n, name, closes, attributes = token
        if not name:
            continue
        if closes:
            if name in BLOCK_TAGS:
                close(at.block)
            if open_elements.get(name):
                leave(open_elements[name][-1])
            continue
        if name in RAW_TAGS:
            if name == "title":
                close(at.block)
            e = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, n) if raw_ends.get(name, True) else None
            raw_ends[name] = e is not None
            n = e.end() if e else end
            continue
        if name in VOID_TAGS:
            if name == "br":
                parts.append(" ")
            elif name in BLOCK_TAGS:
                close(at.block)
            continue
        if name in BLOCK_TAGS:
            close(at.block)
            if at.block.name in CLOSED_BY.get(name, {"p"}) and at.block.parent is not None:
                leave(at.block)
        at = _Element(name, at, _kind(name, attributes, at.kind), at.link or name == "a")
        open_elements.setdefault(name, []).append(at)
    close(at.block)
    return found


# Terminal capacities: what each feature of a block adds to the log odds of content.
BASE, LENGTH, LINKS, SENTENCE, UNMARKED, BOILERPLATE, CERTAIN = -1.1, 2.5, -5.0, 0.75, -3.0, -5.0, -100.0
BY_NAME = {"p": 0.5, "blockquote": 0.5, "pre": 0.5, "h1": 0.5, "h2": 0.5, "h3": 0.5, "li": -0.75, "td": -0.75, "th": -0.75}
#: A block is long from so many characters on, or from the page's median if that is less.
LONG = 80
#: Capacity of the edge between neighbours in one parent, how it falls with each further step
#: through the document tree, and its share between blocks of other marks.
SMOOTH, FALL, ACROSS = 3.0, 0.75, 0.05


def costs(blocks: list[Block]) -> list[float]:
    """Log odds of content of each block by the classifier. Only what is never shown as text of
    the page, or belongs to a form, is certain; all other odds are of the order of the edges."""
    shown = sorted(len(b.text) for b in blocks if b.kind < 2)
    long = min(LONG, max(1, shown[len(shown) // 2])) if shown else LONG
    marks = any(b.kind == 1 for b in blocks)
    found = []
    for b in blocks:
        if b.kind == 3:
            found.append(CERTAIN)
            continue
        odds = BASE + LENGTH * min(1.0, len(b.text) / long) + LINKS * b.linked / max(1, len(b.text)) + BY_NAME.get(b.name, 0.0)
        odds += SENTENCE if _SENTENCE.search(b.text) else 0.0
        odds += BOILERPLATE if b.kind == 2 else 0.0
        odds += UNMARKED if marks and b.kind != 1 else 0.0
        found.append(odds)
    return found


def smoothness(a: Block, b: Block) -> float:
    """Capacity of the edge between two blocks by their distance in the document tree."""
    x, y, steps = a.parent, b.parent, 0
    while x is not y and steps < 12:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
        steps += 1
    return SMOOTH / (1 + FALL * max(0, steps - 2)) * (1.0 if a.kind == b.kind else ACROSS)


def graph(blocks: list[Block]) -> dict[tuple[int, int], float]:
    """Smoothness edges: to the next block, to the next one under the same grandparent, and to the
    next one in the same marked element. Blocks that are certain have none."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[object, int] = {}
    for i, b in enumerate(blocks):
        if b.kind == 3:
            continue
        for near in (None, id(b.parent.parent), (id(b.parent.marked),)):
            if near in last:
                edges[last[near], i] = smoothness(blocks[last[near]], b)
            last[near] = i
    return edges


def minimum_cut(odds: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each node is on the source's side of a minimum cut. Node i has capacity
    odds[i] from the source (if positive) or to the sink; edges are in both directions."""
    n = len(odds)
    touching = [0.0] * n
    for (a, b), c in edges.items():
        touching[a] += c
        touching[b] += c
    settled: list[bool | None] = [odds[i] > 0 if abs(odds[i]) > touching[i] else None for i in range(n)]
    if None not in settled:
        return settled  # type: ignore[return-value]
    source, sink = n, n + 1
    capacity: list[dict[int, float]] = [{} for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        capacity[a][b] = capacity[a].get(b, 0.0) + there
        capacity[b][a] = capacity[b].get(a, 0.0) + back

    for i in range(n):
        if settled[i] is None:
            join(*((source, i) if odds[i] > 0 else (i, sink)), abs(odds[i]), 0.0)
    for (a, b), c in edges.items():
        fixed_a, fixed_b = settled[a], settled[b]
        if fixed_a is None and fixed_b is None:
            join(a, b, c, c)
        elif fixed_a is None:
            join(*((source, a) if fixed_b else (a, sink)), c, 0.0)
        elif fixed_b is None:
            join(*((source, b) if fixed_a else (b, sink)), c, 0.0)
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in capacity[u].items():
                if c > 1e-9 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return [s if s is not None else i in level for i, s in enumerate(settled)]
        # depth first along the levels; each node goes on with the neighbour that it came to last
        near = {u: [v for v in capacity[u] if level.get(v) == level[u] + 1] for u in level}
        place = dict.fromkeys(level, 0)
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(capacity[a][b] for a, b in pairwise(path))
                full = None
                for k, (a, b) in enumerate(pairwise(path)):
                    capacity[a][b] -= flow
                    capacity[b][a] += flow
                    if full is None and capacity[a][b] <= 1e-9:
                        full = k
                del path[full + 1 :]  # on from the first edge that is full now
                continue
            own, k = near[u], place[u]
            while k < len(own) and capacity[u][own[k]] <= 1e-9:
                k += 1
            place[u] = k
            if k < len(own):
                path.append(own[k])
            else:
                path.pop()
                if path:
                    place[path[-1]] += 1


def extract(page: str | None) -> str:
    """The main text of one page; empty if there is none."""
    if not page:
        return ""
    found = blocks_of(page)
    content = minimum_cut(costs(found), graph(found))
    return "\n".join(b.text for b, c in zip(found, content, strict=True) if c)


def main_text():
    """A column function: html to its main text."""

    @F.arrow_udf("string")
    def of(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pages:
            yield pa.array([extract(p) for p in batch.to_pylist()], pa.string())

    return of


def extract_pages(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points) in place of columns of those names.

    A null or empty page, and one without content, has the empty text. Malformed markup is read as
    browsers mostly do: a tag without end is text, unclosed elements end with what holds them, end tags of elements
    that aren't open only end a block; time is about linear in a page's length. Null ids and urls
    and repeated rows pass through. An empty table gives no rows."""
    small_batches(pages.sparkSession)
    rest = [F.col(c) for c in pages.columns if c not in ("text", "n_chars")]
    found = pages.select(*rest, main_text()(html_col).alias("text"))
    return found.select("*", F.length("text").cast("long").alias("n_chars"))
