"""Host, handle and platform rules over URL columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def on_trusted_host(url: Column, suffixes: Sequence[str]) -> Column:
    return host(url).rlike("(" + "|".join(re.escape(s) for s in suffixes) + r")\.*$")


def links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"""(?i)(https?://[^\s<>"'\)\]]+)"""), 1)


def has_trusted_link(text: Column, suffixes: Sequence[str]) -> Column:
    return F.exists(links(F.coalesce(text, F.lit(""))), lambda u: on_trusted_host(u, suffixes))


def is_suspicious_url(url: Column, marks: Sequence[str]) -> Column:
    return F.lower(url).rlike("|".join(re.escape(m) for m in marks))


def platform_of(url: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """First platform whose domain is the host or one of its parents."""
    out = None
    for name, domains in rules:
        test = host(url).rlike(r"(^|\.)(" + "|".join(re.escape(d) for d in domains) + ")$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def handle_tokens(url: Column, pattern: str) -> Column:
    """Lower-case a-z pieces of the account name that `pattern` captures, plus the name itself."""
    name = F.lower(F.regexp_extract(url, pattern, 1))
    pieces = F.filter(F.split(name, "[^a-z]"), lambda p: p != "")
    return F.when(name == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.array_append(pieces, name)))


def handle_is_bait(url: Column, pattern: str, bait: Sequence[str]) -> Column:
    name = F.lower(F.regexp_extract(url, pattern, 1))
    return (name != "") & name.rlike("|".join(re.escape(b) for b in bait))
