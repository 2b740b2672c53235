"""Text and links from stored page HTML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import clean_text, is_garbled

_TAG_BODY = r"(?is)<{0}\b[^>]*>.*?</{0}\s*>"


def title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title", 1), F.lit(""))


def _meta(html: Column, key: str, names: Sequence[str]) -> Column:
    """Content of the first meta tag whose attribute `key` is one of the names, either order."""
    alt = "|".join(n.replace(".", r"\.") for n in names)
    before = rf"""(?is)<meta\b[^>]*\b{key}\s*=\s*["'](?:{alt})["'][^>]*\bcontent\s*=\s*["']([^"']*)["']"""
    after = rf"""(?is)<meta\b[^>]*\bcontent\s*=\s*["']([^"']*)["'][^>]*\b{key}\s*=\s*["'](?:{alt})["']"""
    empty = F.lit("")
    return F.coalesce(F.nullif(F.regexp_extract(html, before, 1), empty), F.nullif(F.regexp_extract(html, after, 1), empty))


def meta_content(html: Column, *names: str) -> Column:
    """First non-empty content among the named meta tags, in name order."""
    return F.coalesce(*[_meta(html, key, [n]) for n in names for key in ("property", "name")])


def ad_previews(html: Column) -> Column:
    """Inner markup of divs that carry a data-ad-preview attribute."""
    return F.regexp_extract_all(html, F.lit(r"(?is)<div\b[^>]*\bdata-ad-preview\b[^>]*>(.*?)</div"), 1)


def visible_markup(html: Column) -> Column:
    """Page without scripts, styles, comments and tags, entities still encoded; whole text, no cut."""
    bare = html
    for tag in ("script", "style", "noscript"):
        bare = F.regexp_replace(bare, _TAG_BODY.format(tag), " ")
    bare = F.regexp_replace(bare, r"(?s)<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?i)<!doctype[^>]*>", " "), r"<[^>]+>", " ")


def with_page_text(df: DataFrame, html: str, out: str = "page_text", closed: bool = False) -> DataFrame:
    """Title, social titles and descriptions and ad texts; the visible text when fewer than two.

    Built in stages, so the searches and the entity decoding of a page run once. closed: references without a semicolon stay.
    """
    h = F.col(html)
    named = [title(h), meta_content(h, "og:title", "twitter:title"),
             meta_content(h, "og:description", "twitter:description", "description")]
    ads = F.transform(ad_previews(h), lambda a: F.trim(F.regexp_replace(a, "<[^>]+>", " ")))
    staged = df.withColumn("_parts", F.filter(F.concat(F.array_compact(F.array(*named)), ads), lambda p: p != ""))
    staged = staged.withColumn("_body", clean_text(F.when(F.size("_parts") < 2, visible_markup(h)), closed))
    parts = F.array_distinct(F.concat("_parts", F.filter(F.array("_body"), lambda p: p != "")))
    staged = staged.withColumn("_text", clean_text(F.array_join(parts, " "), closed))
    return staged.withColumn(out, F.when(is_garbled(F.col("_text")), "").otherwise(F.col("_text"))).drop("_parts", "_body", "_text")


def thumbnail(html: Column, url: Column, video_host: str = "youtube.com", key: str = "v",
              template: str = "https://img.youtube.com/vi/{}/hqdefault.jpg") -> Column:
    """Image link of a video page by its id, else of the page's social meta tags."""
    video = F.try_parse_url(url, F.lit("QUERY"), F.lit(key))
    head, tail = template.split("{}")
    by_id = F.when(F.contains(url, F.lit(video_host)) & video.isNotNull(), F.concat(F.lit(head), video, F.lit(tail)))
    image = meta_content(html, "og:image", "twitter:image")
    return F.coalesce(by_id, F.when(image.startswith("http"), image))


def captions(html: Column, patterns: Sequence[str]) -> Column:
    """First capture of each pattern that occurs, distinct, in pattern order."""
    found = [F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns]
    return F.array_distinct(F.array_compact(F.array(*found)))
