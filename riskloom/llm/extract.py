"""Main text of web pages by minimum-cut labelling of their blocks.

A page becomes a row of text blocks. Costs of calling a block article or boilerplate come from a small linear classifier
over its length, punctuation, links, and the elements around it; they are the capacities to the two terminals. Neighbours
in the page and siblings in the document tree are tied by smoothness capacities. The minimum cut, found by max-flow,
is the labelling with the least total cost: a short line inside an article stays, a long one inside a menu goes.

Names of classes and elements are features with a finite cost like the others. An `article` or `main` element takes back what
wrappers around it were named, and a page that would be left with nothing is cut once more without the names of its layout.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import Carried, whole

# Element names and name parts of the markup vocabulary.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template svg iframe object title textarea canvas video audio noframes".split())
OUTSIDE_TAGS = frozenset("nav footer aside form head button select menu dialog fieldset".split())
# Names that themes also give to wrappers of a whole page, and names that nothing but boilerplate bears.
WRAPPER_NAMES = frozenset("sidebar widget modal overlay popup header masthead menu nav navbar toolbar footer social search".split())
SURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo cookie cookies consent gdpr notice newsletter subscribe subscription "
    "signup share sharing related recommended recommendations breadcrumb breadcrumbs pagination pager navigation login skip copyright "
    "comment comments reply replies respond disqus".split())
#: A name with one of these parts tells of a layout, a state or a topic, not of what the element is; CONTENT only in front.
LAYOUT_PARTS = frozenset("no not has with without is wrap wrapper container layout open closed enabled disabled category tag format type".split())
CONTENT_PARTS = frozenset(("content", "main", "page"))
#: Wording of notices, which need not be named.
NOTICE = re.compile(r"\b(?:cookies?|privacy policy|terms of (?:use|service)|all rights reserved|unsubscribe|newsletter)\b", re.I)
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ARTICLE_TAGS = frozenset(("article", "main"))
ARTICLE_NAMES = frozenset("article content entry post story main".split())

_TAG = re.compile(r"""<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW_TAGS}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Costs in units of a clear short sentence: of a telling element, of a telling name, of a notice's wording; of parting neighbours.
ELEMENT, NAME, WORDING = 9.0, 8.0, 2.5
NEIGHBOUR, SIBLING, STRANGER = 0.8, 0.5, 0.15


class Block:
    """away: what the elements around speak against the text; surely: the part of it that no wrapper of a page can bear."""

    __slots__ = ("text", "linked", "away", "surely", "article", "tag", "parent")

    def __init__(self, text: str, linked: int, away: float, surely: float, article: bool, tag: str, parent: int):
        self.text, self.linked, self.away, self.surely, self.article, self.tag, self.parent = text, linked, away, surely, article, tag, parent


class _Open:
    """An open element: its context, the innermost block element, and the place of a paragraph that a block would end."""

    __slots__ = ("tag", "number", "away", "surely", "article", "block", "paragraph")

    def __init__(self, tag, number, away, surely, article, block, paragraph):
        self.tag, self.number, self.away, self.surely, self.article, self.block, self.paragraph = tag, number, away, surely, article, block, paragraph


def _named(value: str) -> tuple[bool, bool, bool]:
    """Of a class or id: does a name in it tell of boilerplate, surely so, of an article."""
    outside = sure = article = False
    for name in value.split():
        parts = [x.lower() for x in _PARTS.findall(name)]
        if not parts:
            continue
        article = article or bool(ARTICLE_NAMES.intersection(parts))
        if LAYOUT_PARTS.intersection(parts) or parts[0] in CONTENT_PARTS and len(parts) > 1:
            continue
        outside = outside or bool(WRAPPER_NAMES.intersection(parts))
        sure = sure or bool(SURE_NAMES.intersection(parts))
    return outside or sure, sure, article


def blocks(page: str) -> list[Block]:
    """Text blocks in page order. Unclosed elements end where an outer one is closed; broken tags are dropped."""
    out: list[Block] = []
    stack = [_Open("", 0, 0.0, 0.0, False, ("", 0), 0)]
    # How many elements of a name are open: a closing tag without one costs nothing.
    opened: dict[str, int] = {}
    pieces: list[str] = []
    links, linked, count, at, size = 0, 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            top = stack[-1]
            out.append(Block(text, linked, top.away, top.surely, top.article, *top.block))
        pieces.clear()
        linked = 0

    def close(place: int) -> None:
        """Close the elements from this place of the stack on."""
        nonlocal links
        for gone in stack[place:]:
            opened[gone.tag] -= 1
            links -= gone.tag == "a"
        del stack[place:]

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        pieces.append(text)
        if links:
            linked += len(text)

    while at < size:
        less = page.find("<", at)
        if less < 0:
            add(page[at:])
            break
        if less > at:
            add(page[at:less])
        if page.startswith("<!--", less):
            end = page.find("-->", less + 4)
            at = size if end < 0 else end + 3
            continue
        found = _TAG.match(page, less)
        if not found:
            if less + 1 < size and (page[less + 1].isalpha() or page[less + 1] in "/!?"):
                end = page.find(">", less)
                at = size if end < 0 else end + 1
            else:
                add("<")
                at = less + 1
            continue
        closing, tag, rest = found[1], found[2].lower(), found[3]
        at = found.end()
        if tag in BLOCK_TAGS:
            flush()
        elif tag == "br":
            pieces.append(" ")
        if closing:
            if opened.get(tag):
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                close(place)
            continue
        if tag in RAW_TAGS:
            if not rest.endswith("/"):
                stop = _ENDS[tag].search(page, at)
                at = stop.end() if stop else size
            continue
        if tag in VOID_TAGS:
            continue
        # A block ends an open paragraph; a list item or a cell ends the one before it.
        if tag in BLOCK_TAGS and stack[-1].paragraph:
            close(stack[-1].paragraph)
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[-1].tag == tag:
            close(len(stack) - 1)
        top = stack[-1]
        away, surely, article = top.away, top.surely, top.article
        outside = named_sure = of_article = False
        roles = set()
        if rest:
            for m in _NAMES.finditer(rest):
                value = m[2] or m[3] or m[4] or ""
                if m[1].lower() == "role":
                    roles.add(value.lower())
                else:
                    found_names = _named(value)
                    outside, named_sure, of_article = outside or found_names[0], named_sure or found_names[1], of_article or found_names[2]
        if tag in ARTICLE_TAGS or roles & {"main", "article"}:
            # The article itself: what wrappers are named does not count against it.
            article, away = True, surely
        elif tag not in ("html", "body"):
            telling = ELEMENT if tag in OUTSIDE_TAGS and tag != "form" or roles & OUTSIDE_ROLES or tag == "header" and not article else 0.0
            if telling or named_sure:
                surely = max(surely, telling, NAME if named_sure else 0.0)
            away = max(away, surely, NAME if outside or tag == "form" else 0.0)
            article = article or of_article and not away
        count += 1
        block = (tag, count) if tag in BLOCK_TAGS else top.block
        paragraph = len(stack) if tag == "p" else 0 if tag in BLOCK_TAGS else top.paragraph
        stack.append(_Open(tag, count, away, surely, article, block, paragraph))
        opened[tag] = opened.get(tag, 0) + 1
        links += tag == "a"
    flush()
    return out


def costs(block: Block, names: bool = True) -> tuple[float, float]:
    """Cost of calling the block boilerplate, and of calling it article. names: whether wrappers' names count."""
    length, share = len(block.text), min(1.0, block.linked / max(1, len(block.text)))
    stops = sum(block.text.count(c) for c in ".,;:!?")
    score = 0.6 * math.log1p(length / 20) + 0.3 * min(stops, 6) - 3.0 * share - 1.2
    score += 1.5 * block.article + 0.5 * (block.tag in ("p", "blockquote", "pre", "h1", "h2", "h3")) - 0.5 * (block.tag in ("li", "td", "th"))
    if not block.article and length < 400 and NOTICE.search(block.text):
        score -= WORDING
    score -= block.away if names else block.surely
    return (score, 0.0) if score > 0 else (0.0, -score)


def ties(row: list[Block]) -> Iterator[tuple[int, int, float]]:
    """Smoothness capacities: next block in the page, and next one under the same parent. Blocks in unlike surroundings are strangers."""
    last: dict[int, int] = {}
    for i, block in enumerate(row):
        if i:
            near = row[i - 1].article == block.article and row[i - 1].away == block.away
            yield i - 1, i, NEIGHBOUR if near else STRANGER
        before = last.get(block.parent)
        if before is not None and before != i - 1:
            yield before, i, SIBLING
        last[block.parent] = i


def labels(row: list[Block], names: bool = True) -> list[bool]:
    """Which blocks are article: the source side of a minimum cut."""
    n = len(row)
    spare = []
    for block in row:
        boilerplate, article = costs(block, names)
        spare.append(boilerplate - article)
    # What can go straight from source to sink through a block is gone already; the rest flows along the ties.
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def edge(a: int, b: int, there: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        room.append(there)
        graph[b].append(len(to))
        to.append(a)
        room.append(back)

    source, sink = n, n + 1
    for i, x in enumerate(spare):
        if x > 0:
            edge(source, i, x, 0.0)
        elif x < 0:
            edge(i, sink, -x, 0.0)
    for a, b, w in ties(row):
        edge(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in graph[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 and (spare[i] > 0 or level[i] > 0) for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[a] < len(graph[a]):
                e = graph[a][nxt[a]]
                if room[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                nxt[a] += 1
            else:
                if not path:
                    break
                e = path.pop()
                a = to[e ^ 1]
                nxt[a] += 1
                continue
            path.append(e)
            a = to[e]


def main_text(page: str) -> str:
    """The article's blocks in page order, one to a line."""
    row = blocks(page)
    kept = labels(row)
    if not any(kept):
        # A wrapper of the whole page may bear a telling name, or be a form: then such names tell nothing.
        kept = labels(row, names=False)
    return "\n".join(b.text for b, keep in zip(row, kept) if keep)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [c for c in batch.schema.names if c != "_html"]
        texts = [main_text(x) for x in batch.column("_html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(c) for c in names], pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*names, "text", "n_chars"])


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` of `pages` with text and n_chars (code points).

    Null or empty html gives an empty text, an empty table no rows. Repeated rows stay and get the same text. Long pages are
    read whole, in time that grows with their length. Columns of `keep` named text or n_chars are replaced.
    """
    carried = Carried(pages.select(*keep), ("text", "n_chars"))
    frame = pages.select(*carried.inside(), whole("html").alias("_html"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema[:-1])
    return frame.mapInArrow(_extracted, f"{schema}, text string, n_chars long").select(*carried.outside(), "text", "n_chars")
