"""Column helpers the operators share: words, ASCII lower case, regular-expression spans, text identity."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"
NOT_BENCH_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def whole(text: Column | str) -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


class Carried:
    """Input columns that pass an operator unchanged. Inside they have names of their own, so none clashes with its work.

    An input column named like an output (in any case) is replaced by it.
    """

    def __init__(self, docs: DataFrame, made: tuple[str, ...] = ()):
        self.names = [c for c in docs.columns if c.lower() not in made]

    def inside(self) -> list[Column]:
        return [F.col("`" + c.replace("`", "``") + "`").alias(f"carried_{i}") for i, c in enumerate(self.names)]

    def outside(self) -> list[Column]:
        return [F.col(f"carried_{i}").alias(c) for i, c in enumerate(self.names)]


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _split(trimmed: Column, pattern: str) -> Column:
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, pattern, -1))


def space_words(text: Column) -> Column:
    """Maximal runs of characters that are not ASCII white space."""
    return _split(F.btrim(text, F.lit(SPACE)), SPACES)


def bench_words(text: Column) -> Column:
    """Lower-cased maximal runs of ASCII letters and digits and of all characters beyond ASCII."""
    return _split(F.regexp_replace(ascii_lower(text), rf"^{NOT_BENCH_WORD}|{NOT_BENCH_WORD}\z", ""), NOT_BENCH_WORD)


def text_key(text: Column) -> Column:
    """Identity of a text: rows with equal texts share all text-derived results."""
    return F.md5(text.cast("binary"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Up to so many values are folded in one go.
_FEW = 64


def scanned(values: Column, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each value, the fold of those before it. `step` must be associative, with `zero` as its neutral element.

    A fold that appends copies its list each time. Long lists are therefore folded in pieces of the root of their length,
    each from the fold of the pieces before it.
    """
    none = F.array_remove(F.array(zero), zero)

    def plain(part: Column, start: Column) -> Column:
        def one(acc: Column, x: Column) -> Column:
            return F.struct(step(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(part, F.struct(start.alias("at"), none.alias("out")), one, lambda acc: acc["out"])

    def pieces(every: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(every))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / size).cast("int")), lambda i: F.slice(every, i * size + 1, size))

    def long(every: Column) -> Column:
        return let(pieces(every), lambda parts: let(
            plain(F.transform(parts, lambda p: F.aggregate(p, zero, step)), zero),
            lambda starts: F.flatten(F.transform(parts, lambda p, i: plain(p, F.get(starts, i))))))

    return let(values, lambda v: F.when(F.size(v) <= _FEW, plain(v, zero)).otherwise(long(v)))


def spans(text: Column, pattern: str) -> Column:
    """array<struct<s,e,m>> of the leftmost non-overlapping matches, in code points, e exclusive.

    The pieces between matches and the matches themselves alternate, so their lengths give every position; both come
    from the same scan order. Texts without a match cost one search, others a little more than their length.
    """
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(both: Column) -> Column:
        lengths = F.transform(both, lambda x: (F.length(x["piece"]) + F.coalesce(F.length(x["m"]), F.lit(0))).cast("long"))
        at = scanned(lengths, F.lit(0).cast("long"), lambda a, n: a + n)
        every = F.zip_with(both, at, lambda x, a: F.struct(
            (a + F.length(x["piece"])).alias("s"), (a + F.length(x["piece"]) + F.length(x["m"])).alias("e"), x["m"].alias("m")))
        return F.filter(every, lambda x: x["m"].isNotNull())

    walked = let(F.arrays_zip(pieces.alias("piece"), found.alias("m")), placed)
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,m:string>>"))


def apart(loose: Column, base: Column) -> Column:
    """Those of `loose` (structs with s and e) that overlap none of `base`, in order of s and e. Few are compared one by one; of
    many, each is held against the farthest end before it and the next start after it."""
    def one_by_one() -> Column:
        return F.filter(loose, lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))

    def merged(every: Column) -> Column:
        none, all_ = F.lit(-1).cast("long"), F.lit(1 << 62).cast("long")
        ends = scanned(F.transform(every, lambda u: F.when(u["x"].isNull(), u["e"]).otherwise(none)), none, lambda a, b: F.greatest(a, b))
        starts = F.reverse(scanned(F.reverse(F.transform(every, lambda u: F.when(u["x"].isNull(), u["s"]).otherwise(all_))), all_, lambda a, b: F.least(a, b)))
        marked = F.zip_with(F.zip_with(every, ends, lambda u, e: F.struct(u["x"].alias("x"), e.alias("before"))), starts,
                            lambda u, n: F.struct(u["x"].alias("x"), u["before"].alias("before"), n.alias("after")))
        return F.transform(F.filter(marked, lambda u: u["x"].isNotNull() & (u["before"] <= u["x"]["s"]) & (u["after"] >= u["x"]["e"])), lambda u: u["x"])

    kind = F.get(loose, F.lit(0))
    nothing = F.when(F.lit(False), kind)
    every = F.sort_array(F.concat(
        F.transform(base, lambda b: F.struct(b["s"].alias("s"), F.lit(0).alias("k"), b["e"].alias("e"), nothing.alias("x"))),
        F.transform(loose, lambda x: F.struct(x["s"].alias("s"), F.lit(1).alias("k"), x["e"].alias("e"), x.alias("x")))))
    return F.when(F.size(loose).cast("long") * F.size(base) <= 4096, F.sort_array(one_by_one())).otherwise(let(every, merged))
