"""Word and pattern matching as native column expressions.

Patterns are Java regular expressions with Unicode classes on, so accented letters are letters.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def uni(pattern: str) -> str:
    return "(?U)" + pattern


#: Plain words up to this many are looked for one by one, without a regular expression.
FEW_WORDS = 8
_PLAIN = re.compile(r"[^\\.^$|?*+()\[\]{}]+")


def has_pattern(text: Column, pattern: str) -> Column:
    return F.contains(text, F.lit(pattern)) if _PLAIN.fullmatch(pattern) else text.rlike(uni(pattern))


def any_pattern(text: Column, patterns: Sequence[str]) -> Column:
    """True when any pattern matches: plain words one by one while they are few, the others as one alternation."""
    words = [p for p in patterns if _PLAIN.fullmatch(p)]
    words = words if len(words) <= FEW_WORDS else []
    rest = [p for p in patterns if p not in words]
    tests = [F.contains(text, F.lit(w)) for w in words]
    if rest or not words:
        tests.append(text.rlike(uni("|".join(f"(?:{p})" for p in rest))))
    return reduce(or_, tests)


def count_patterns(text: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns match at least once."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.when(has_pattern(text, p), 1).otherwise(0)
    return total


def matched_patterns(text: Column, patterns: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(has_pattern(text, p), F.lit(p)) for p in patterns]))


def any_word(text: Column, words: Sequence[str]) -> Column:
    """True when any word occurs as a substring: word by word while they are few, else one alternation of quoted words."""
    if 0 < len(words) <= FEW_WORDS:
        return reduce(or_, [F.contains(text, F.lit(w)) for w in words])
    return text.rlike("|".join(re.escape(w) for w in words))


def count_words(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur as substrings."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def matched_words(text: Column, words: Sequence[str]) -> Column:
    """The words that occur as substrings, in list order."""
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def whole_word(words: Sequence[str]) -> str:
    """Pattern for any of the words standing alone."""
    longest = sorted(words, key=lambda w: (-len(w), w))
    return r"(?<!\w)(?:" + "|".join(re.escape(w) for w in longest) + r")(?!\w)"


def tokens_overlap(text: Column, words: Sequence[str]) -> Column:
    """Does the set of a-z tokens of a lower-cased text share a word with the list."""
    return F.arrays_overlap(F.split(text, "[^a-z]+"), F.array(*[F.lit(w) for w in words]))
