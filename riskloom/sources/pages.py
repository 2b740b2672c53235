"""Parts of stored web pages by a tag parser, in Arrow batches.

One pass over a page keeps the stack of open `div`s, so a preview block ends where its own tag ends, however deeply others are
nested in it. Work grows with the page, not with what is left open.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import clean_text, is_garbled, keep_open_references

#: Meta tags whose content belongs to a page's text, in this order.
TEXT_METAS = ("og:title", "og:description", "twitter:title", "twitter:description", "description")
IMAGE_METAS = ("og:image", "twitter:image")
PREVIEW = "data-ad-preview"
_HIDDEN = {"script", "style", "noscript"}


class _Page(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title: str | None = None
        self.metas: dict[str, str] = {}
        self.previews: list[tuple[int, str]] = []
        self.visible: list[str] = []
        self._in_title: list[str] | None = None
        self._hidden = 0
        self._inside: list[str] = []
        self._divs: list[tuple[int, int] | None] = []
        self._open, self._seen = 0, 0

    def handle_starttag(self, tag, attrs):
        named = dict(reversed(attrs))
        if tag == "meta":
            content = named.get("content")
            for key in (named.get("property"), named.get("name")):
                if key and content:
                    self.metas.setdefault(key.strip().lower(), content)
        elif tag == "title" and self.title is None and self._in_title is None:
            self._in_title = []
        elif tag in _HIDDEN:
            self._hidden += 1
        elif tag == "div":
            preview = PREVIEW in named
            self._divs.append((self._seen, len(self._inside)) if preview else None)
            if preview:
                self._open += 1
                self._seen += 1

    def handle_startendtag(self, tag, attrs):
        # As in a browser, <div/> opens a div and <script/> opens a script; void tags have no end anyway.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "title" and self._in_title is not None:
            self.title, self._in_title = "".join(self._in_title), None
        elif tag in _HIDDEN:
            self._hidden = max(0, self._hidden - 1)
        elif tag == "div" and self._divs:
            self._end_div()

    def _end_div(self):
        start = self._divs.pop()
        if start is not None:
            order, at = start
            self.previews.append((order, " ".join(self._inside[at:])))
            self._open -= 1
            if not self._open:
                self._inside = []

    def handle_data(self, data):
        if self._in_title is not None:
            self._in_title.append(data)
        text = data.strip()
        if text and not self._hidden:
            self.visible.append(text)
            if self._open:
                self._inside.append(text)

    def done(self) -> _Page:
        self.close()
        if self._in_title is not None:
            self.title = "".join(self._in_title)
        while self._divs:
            self._end_div()
        return self


def parse(html: str, closed: bool = False) -> _Page:
    page = _Page()
    try:
        page.feed(keep_open_references(html) if closed else html)
        return page.done()
    except AssertionError:
        # Declarations the parser gives up on: what was read up to there stays.
        while page._divs:
            page._end_div()
        return page


def _parts(keep: int, closed: bool):
    metas = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = [parse(h.as_py() or "", closed) for h in batch.column(keep)]
            wanted = {*TEXT_METAS, *IMAGE_METAS}
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:keep], pa.array([p.title for p in pages], pa.string()),
                 pa.array([[(k, v) for k, v in p.metas.items() if k in wanted] for p in pages], metas),
                 pa.array([[t for _, t in sorted(p.previews)] for p in pages], pa.list_(pa.string())),
                 pa.array([" ".join(p.visible) for p in pages], pa.string())],
                [*batch.schema.names[:keep], "title", "metas", "previews", "visible"])
    return run


def page_parts(df: DataFrame, html: str, keep: Sequence[str], closed: bool = False) -> DataFrame:
    """Columns `keep` with title, metas (name to first content), previews (texts of the marked divs, in the order they open)
    and visible (all text outside scripts and styles). A null page has a null title and nothing else.
    closed: references without a semicolon stay."""
    frame = df.select(*keep, html)
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return frame.mapInArrow(_parts(len(keep), closed), f"{kinds}, title string, metas map<string,string>, previews array<string>, visible string")


def with_text(parts: DataFrame, previews: Column, out: str = "page_text", closed: bool = False, judged: bool = True) -> DataFrame:
    """Adds the text of a page from its parts: title, meta texts, preview texts where `previews` holds, each once; the visible
    text as well when fewer than two are there. Garbled parts are left out, and a garbled whole is empty if `judged`."""
    named = F.array(*[F.element_at("metas", m) for m in TEXT_METAS])
    every = F.concat(named, F.when(previews, F.col("previews")).otherwise(F.array().cast("array<string>")))

    def squeezed(p: Column) -> Column:
        return F.btrim(F.regexp_replace(F.translate(p, "\u00a0\u200b\ufeff", "   "), r"\s+", " "))

    # A title is taken as it stands; of the rest what can be read.
    rest = F.filter(F.transform(F.filter(every, lambda p: p.isNotNull()), squeezed), lambda p: ~is_garbled(p))
    title = F.filter(F.array(squeezed(F.col("title"))), lambda p: p.isNotNull())
    staged = parts.withColumn("_parts", F.array_distinct(F.filter(F.concat(title, rest), lambda p: p != "")))
    staged = staged.withColumn("_body", F.when(F.size("_parts") < 2, clean_text(F.col("visible"), closed)))
    whole = F.concat("_parts", F.filter(F.array("_body"), lambda b: b.isNotNull() & (b != "") & ~is_garbled(b)))
    staged = staged.withColumn("_text", clean_text(F.array_join(F.array_distinct(whole), " "), closed))
    text = F.col("_text")
    return staged.withColumn(out, F.when(is_garbled(text), "").otherwise(text) if judged else text).drop("_parts", "_body", "_text")


def image_link(metas: str = "metas") -> Column:
    """The page's social image, if it is a link."""
    image = F.coalesce(*[F.element_at(metas, m) for m in IMAGE_METAS])
    return F.when(image.startswith("http"), image)
