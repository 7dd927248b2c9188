"""Main text of HTML pages by minimum-cut labelling.

A page becomes a list of blocks of text, each with its ancestors, link share and length.  A linear
classifier gives each block a score for content; its positive part is the capacity from the source,
its negative part that to the sink.  Neighbours on the page, and neighbours below one parent, are
joined by smoothness edges, stronger the more ancestors they share.  The source side of the minimum
cut is the article.  No page is labelled, so the classifier's weights are stated, not fitted.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import text_of

RESULT = "page_id long, url string, text string, n_chars long"

# Names of HTML elements, and words that pages use in class, id and role.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template iframe object svg canvas select button textarea audio video map datalist".split())
RAW = frozenset("script style textarea title iframe noscript xmp noembed noframes".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog search".split())
CONTENT_TAGS = frozenset("article main".split())
FRAME = frozenset("html body main".split())
CONTENT_ROLES = frozenset("main article".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer masthead topbar toolbar breadcrumb breadcrumbs "
    "pagination pager cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments commentlist reply replies respond disqus discussion widget widgets copyright disclaimer skip".split()
)
CONTENT_WORDS = frozenset("article content post entry story main body text".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}

# The classifier's weights, and the smoothness of neighbours: of any, and what a common parent and its parent add.
INSIDE_CONTENT, INSIDE_BOILERPLATE, OUTSIDE_CONTENT = 3.0, -5.0, -3.5
HEADER_OUTSIDE, CONTENT_NAME = -2.5, 1.0
PER_WORD, MOST_WORDS, LINKED, SENTENCE, BIAS, HEADING = 0.08, 40, -5.0, 1.0, -1.5, 1.5
LINKED_INSIDE = -1.0  # in a clear article links are part of it
NEAR, SAME_PARENT, SAME_ABOVE = 0.3, 0.6, 0.3

_OPENS = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--|!\[CDATA\[|[!?]))")
_IN_TAG = re.compile(r">|=\s*([\"'])")
_CLOSING = {"!--": "-->", "![CDATA[": "]]>", "!": ">", "?": ">"}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


@dataclass
class Element:
    tag: str
    number: int
    parent: int
    depth: int
    good: bool
    bad: bool
    header: bool
    named: bool
    grand: int = 0  # the parent's parent
    suspect: int = 0  # the nearest element, it or around it, whose name has a word of boilerplate
    block: "Element | None" = None  # the nearest element, it or around it, that makes a block


@dataclass
class Block:
    text: str
    parent: int
    above: int
    tag: str
    depth: int
    good: bool
    bad: bool
    header: bool
    named: bool
    linked: int
    suspect: int


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool, bool, bool]:
    """Whether an element says content, boilerplate, header, has a name that content has, or one with a word of boilerplate.

    Names say no boilerplate on the page's frame, and on an article only if one is a word of boilerplate as a whole.
    """
    good, bad, header, named, suspect = tag in CONTENT_TAGS, tag in BOILERPLATE_TAGS, tag == "header", False, False
    if attributes and not attributes.isspace():
        for key, *values in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next(filter(None, values), "")
            if key in ("class", "id"):
                words = {w.lower() for w in _NAME.findall(value)}
                if tag not in FRAME:
                    bad = bad or any(w in BOILERPLATE_WORDS for w in value.lower().split())
                    suspect = suspect or tag != "article" and bool(words & BOILERPLATE_WORDS)
                header = header or "header" in words
                named = named or bool(words & CONTENT_WORDS)
            elif key == "role":
                good, bad = good or value.lower() in CONTENT_ROLES, bad or value.lower() in BOILERPLATE_ROLES
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
                bad = True
    return good, bad, header, named, suspect


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, tag, attributes) of each tag, comment and declaration; the latter two without a tag.

    Values in quotes may hold a >.  A quote that is never closed is a character like another, an open comment goes to
    the end, and what follows a < that no > closes is text.  Every part of a page is looked at once or twice.
    """
    at, unclosed = 0, set()
    while (m := _OPENS.search(page, at)) is not None:
        end = m.end()
        if m[3]:
            found = page.find(_CLOSING[m[3]], end) if m[3] not in unclosed else -1
            if found < 0 and m[3] in ("!", "?"):
                unclosed.add(m[3])
                at = end
                continue
            at = found + len(_CLOSING[m[3]]) if found >= 0 else len(page)
            yield m.start(), at, "", "", ""
            continue
        while (x := _IN_TAG.search(page, end)) is not None and x[1]:
            closed = page.find(x[1], x.end()) if x[1] not in unclosed else -1
            if closed < 0:
                unclosed.add(x[1])
            end = closed + 1 if closed >= 0 else x.end()
        if x is None:
            return
        at = x.end()
        yield m.start(), at, m[1], m[2].lower(), page[m.end() : x.start()]


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that have text, in page order."""
    root = Element("", 0, 0, 0, False, False, False, False)
    root.block = root
    stack, out, number = [root], [], 0
    places: defaultdict[str, list[int]] = defaultdict(list)  # where on the stack the open elements of a tag are
    around: dict[int, int] = {}  # of each suspect the next one around it
    endless: set[str] = set()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            at = stack[-1].block
            out.append(Block(text, at.parent, at.grand, at.tag, at.depth, at.good, at.bad, at.header, at.named, linked, at.suspect))
        parts.clear()
        linked = 0

    def pop_to(k: int) -> None:
        for e in stack[k:]:
            places[e.tag].pop()
        del stack[k:]

    def innermost(tags: Iterable[str]) -> int:
        return max((places[x][-1] for x in tags if places[x]), default=0)

    at = 0
    for start, after, slash, tag, attributes in tokens(page):
        if start < at:
            continue
        if start > at:
            parts.append(page[at:start])
            linked += bool(places["a"]) * (start - at)
        at = after
        if not tag:
            continue
        if slash:
            if tag in BLOCKS:
                flush()
            if places[tag]:
                pop_to(places[tag][-1])
            continue
        if tag in RAW or tag in SILENT:
            if not attributes.rstrip().endswith("/") or tag in RAW:
                end = None if tag in endless else _raw_end(tag).search(page, at)
                endless.update(() if end else (tag,))
                at = end.end() if end else len(page) if tag in RAW else at
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            flush()
            if stack[-1].block.tag == "p":
                pop_to(places["p"][-1])
        k = innermost(CLOSES.get(tag, ()))
        if k > innermost(SCOPES.get(tag, ())):
            flush()
            pop_to(k)
        if tag in VOID:
            continue
        number += 1
        top = stack[-1]
        good, bad, header, named, suspect = _marks(tag, attributes)
        if suspect:
            around[number] = top.suspect
        own = Element(tag, number, top.number, top.depth + 1, good or top.good, bad or top.bad, header or top.header, named or top.named, top.parent, number if suspect else top.suspect)
        own.block = own if tag in BLOCKS else top.block
        places[tag].append(len(stack))
        stack.append(own)
    parts.append(page[at:])
    flush()
    inside = Counter()
    for b in out:
        inside[b.suspect] += len(b.text)
    whole = sum(inside.values())
    for e in sorted(around, reverse=True):
        inside[around[e]] += inside[e]
    bad = {0: False}
    for e in sorted(around):  # a name such as content-with-sidebar, around most of the page's text, is no boilerplate's
        bad[e] = bad[around[e]] or 2 * inside[e] <= whole
    for b in out:
        b.bad = b.bad or bad[b.suspect]
    return out


@cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}\s*>" if tag != "head" else r"</head\s*>|(?=<body[\s>])", re.I)


def scores(blocks: list[Block]) -> list[float]:
    """The classifier: positive for content.  Where nothing on a page is, as on a page of one short line, there is no bias against what is short."""
    framed = any(b.good and not b.bad for b in blocks)
    out = []
    for b in blocks:
        words = b.text.count(" ") + 1
        links = LINKED_INSIDE if b.good and not b.bad else LINKED
        score = BIAS + PER_WORD * min(words, MOST_WORDS) + links * min(1.0, b.linked / max(1, len(b.text))) + SENTENCE * (b.text[-1] in ".!?…\"”»")
        score += HEADING * (b.tag in ("h1", "h2", "h3")) + CONTENT_NAME * b.named
        score += INSIDE_BOILERPLATE * b.bad + INSIDE_CONTENT * (b.good and not b.bad) + OUTSIDE_CONTENT * (framed and not b.good) + HEADER_OUTSIDE * (b.header and not b.good)
        out.append(score)
    return out if any(x > 0 for x in out) else [x - BIAS for x in out]


def edges_of(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours on the page and between neighbours below one parent."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            a = blocks[i - 1]
            out.append((i - 1, i, NEAR + SAME_PARENT * (a.parent == b.parent) + SAME_ABOVE * (a.above == b.above or b.parent in (a.above, a.parent) or a.parent == b.above)))
        if last.get(b.parent, i) < i - 1:
            out.append((last[b.parent], i, SAME_PARENT))
        last[b.parent] = i
    return out


def minimum_cut(score: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a maximum flow, found by blocking flows over shortest paths."""
    n = len(score)
    source, sink = n, n + 1
    weight = [0.0] * n
    for a, b, c in edges:
        weight[a] += c
        weight[b] += c
    fixed = [abs(s) > w for s, w in zip(score, weight, strict=True)]  # no cut of its edges pays for the other label
    node = [(source if s > 0 else sink) if f else i for i, (s, f) in enumerate(zip(score, fixed, strict=True))]
    out: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((there, back))

    for i, s in enumerate(score):
        if not fixed[i] and s:
            join(*((source, i) if s > 0 else (i, sink)), abs(s), 0.0)
    for a, b, c in edges:
        if node[a] != node[b] and {node[a], node[b]} != {source, sink}:
            join(node[a], node[b], c, c)
    while True:
        depth, queue = {source: 0}, deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and to[e] not in depth:
                    depth[to[e]] = depth[a] + 1
                    queue.append(to[e])
        if sink not in depth:
            return [node[i] == source if fixed[i] else i in depth for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                cut = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                at = to[path[cut] ^ 1]
                del path[cut:]
            while turn[at] < len(out[at]):
                e = out[at][turn[at]]
                if room[e] > 1e-9 and depth.get(to[e]) == depth[at] + 1:
                    break
                turn[at] += 1
            else:
                if not path:
                    break
                at = to[path.pop() ^ 1]
                turn[at] += 1
                continue
            path.append(e)
            at = to[e]


def main_text(page: str) -> str:
    blocks = blocks_of(page)
    content = minimum_cut(scores(blocks), edges_of(blocks))
    return "\n".join(b.text for b, keep in zip(blocks, content, strict=True) if keep)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    Null or empty pages, and pages without an article, give the empty text.  Pages are read whole, each
    on its own account; repeated rows and null ids change nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(x.as_py()) for x in text_of(part.column(2))]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html_col).mapInArrow(run, RESULT)
