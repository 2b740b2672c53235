"""Long lexicons of regular expressions over texts.

Most patterns hold a literal that every match must contain. All such literals go into one automaton per block of patterns; a
text is matched by a pattern only if the text holds one of the pattern's literals. Most patterns are also bounded: a match has
at most some number of characters other than white space around its literals. Of those only the places are matched where two
neighbouring literals stand near enough, so long texts full of a lexicon's words cost little. The match itself is Spark's own,
so results are those of testing every pattern. Patterns without a required literal are tested on every text, folded into the
plan block by block.
"""

from __future__ import annotations

import itertools
import math
import re
import warnings
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.sources.reference import BLOCK_ENTRIES, FOLDED_ENTRIES, slices

with warnings.catch_warnings():
    warnings.simplefilter("ignore", DeprecationWarning)
    import re._constants as _kinds
    import re._parser as _syntax

#: Shorter literals name too many texts to be worth a look-up.
LEAST_LITERAL = 3
#: Pairs of literals that one pattern may be looked for by, the farthest a bounded pattern reaches, and pairs of places looked at together.
MOST_PAIRS, REACH, PLACES = 64, 100, 1 << 20
UNBOUND = 1 << 30
#: By code point: white space or not; none lies beyond the last entry.
SPACES = np.array([chr(c).isspace() for c in range(0x3002)])


def required_literals(pattern: str) -> list[str]:
    """Literals of which every match holds at least one, lower-cased; empty if none of LEAST_LITERAL characters is known.

    Of the literals a pattern must hold the one with the longest shortest alternative is taken.
    """
    plain = re.sub(r"\\[pP](\{[^}]*\}|[A-Z])", r"\\w", pattern)
    try:
        tree = _syntax.parse(plain)
    except (re.error, OverflowError, RecursionError):
        return []
    best: list[str] = []
    for options in _factors(list(tree)):
        if min(map(len, options)) > min(map(len, best), default=0):
            best = options
    return sorted({b.lower() for b in best}) if best and min(map(len, best)) >= LEAST_LITERAL else []


def _factors(items: list) -> Iterator[list[str]]:
    """Sets of literals, of each of which a match of the sequence holds one."""
    run = ""
    for kind, value in items:
        if kind is _kinds.LITERAL and len(chr(value).lower()) == 1:
            run += chr(value)
            continue
        if run:
            yield [run]
            run = ""
        if kind is _kinds.SUBPATTERN:
            yield from _factors(list(value[-1]))
        elif kind in (_kinds.MAX_REPEAT, _kinds.MIN_REPEAT, _kinds.POSSESSIVE_REPEAT) and value[0] > 0:
            yield from _factors(list(value[2]))
        elif kind is _kinds.ATOMIC_GROUP:
            yield from _factors(list(value))
        elif kind is _kinds.BRANCH:
            options: list[str] = []
            for branch in value[1]:
                own = max(_factors(list(branch)), key=lambda f: min(map(len, f)), default=[])
                if not own:
                    options = []
                    break
                options += own
            if options:
                yield options
    if run:
        yield [run]


class Near(NamedTuple):
    """Where a bounded pattern can match: at one of `first`, followed by one of `second` (if any) near enough.

    Bounds count characters that are no white space: `gap` between the two, `lead` from the first to the white space behind it,
    `tail` from the white space before the second to it, `before` and `after` around both, -1 if nothing of the pattern stands
    there.
    """
    first: list[str]
    second: list[str]
    gap: int
    lead: int
    tail: int
    before: int
    after: int


#: Escapes and groups that read the same here and in Spark, and whose match does not depend on what stands around it.
_SAME_SYNTAX = re.compile(r"""(?:[^\\\[(^$]|\\[sSdDwW]|\\[!-/:-@\[-`{-~]|\\[pP](?:\{\w+\}|[A-Z])|\((?!\?)|\(\?:
    |\[\^?(?!\])(?:[^\\\[\]&]|\\[sSdDwW]|\\[!-/:-@\[-`{-~]|\\[pP](?:\{\w+\}|[A-Z]))+\])*""", re.VERBOSE)


def near_literals(pattern: str) -> Near | None:
    """The literals of a bounded pattern and how far its matches reach around them; None if it is not bounded or not plain."""
    if not _SAME_SYNTAX.fullmatch(pattern):
        return None
    try:
        items = _flat(list(_syntax.parse(re.sub(r"\\[pP](\{[^}]*\}|[A-Z])", r"\\w", pattern))))
    except (re.error, OverflowError, RecursionError, KeyError):
        return None
    # Literals in their order, and what lies before, between and behind them.
    literals: list[list[str]] = []
    between, run = [[]], ""
    for kind, value in [*items, (None, None)]:
        if kind is _kinds.LITERAL:
            run += chr(value)
            continue
        if run.isspace():
            between[-1] += [(_kinds.LITERAL, ord(c)) for c in run]
        elif run:
            literals.append([run])
            between.append([])
        run = ""
        options = _plain_options(value) if kind is _kinds.BRANCH else []
        if options:
            literals.append(options)
            between.append([])
        elif kind is not None:
            between[-1].append((kind, value))
    try:
        bounds = [_bounds(own) for own in between]
    except KeyError:
        return None
    inside = [max(sum(not c.isspace() for c in o) for o in options) for options in literals]
    pairs = [i for i in range(len(literals) - 1) if len(literals[i]) * len(literals[i + 1]) <= MOST_PAIRS]
    if pairs:
        at = max(pairs, key=lambda i: min(map(len, literals[i])) + min(map(len, literals[i + 1])))
        end = at + 1
    else:
        at = end = max(range(len(literals)), key=lambda i: min(map(len, literals[i])), default=-1)
        if at < 0 or min(map(len, literals[at])) < LEAST_LITERAL:
            return None
    before = sum(bounds[:at + 1]) + sum(inside[:at]) if at or between[0] else -1
    after = sum(bounds[end + 1:]) + sum(inside[end + 1:]) if end + 1 < len(literals) or between[-1] else -1
    gap = bounds[end] if end > at else 0
    if max(gap, before, after) > REACH:
        return None
    (lead, lone), (tail, _) = (_until_white(between[end], way) for way in (1, -1))
    if end == at or lone >= 0:
        lead = tail = UNBOUND
    return Near(literals[at], literals[end] if end > at else [], gap, lead, tail, before, after)


def _flat(items: list) -> list:
    """The sequence with groups opened."""
    return [own for kind, value in items for own in (_flat(list(value[-1])) if kind is _kinds.SUBPATTERN else [(kind, value)])]


def _plain_options(value) -> list[str]:
    """The texts a choice stands for, if each is a literal and not all white space."""
    branches = [_flat(list(branch)) for branch in value[1]]
    if not all(kind is _kinds.LITERAL for branch in branches for kind, _ in branch):
        return []
    options = {"".join(chr(own) for _, own in branch) for branch in branches}
    return sorted(options) if all(map(str.strip, options)) else []


def _bounds(items: list) -> float:
    """The most characters that are no white space in a match; KeyError for other syntax."""
    most = 0
    for kind, value in items:
        if kind in (_kinds.LITERAL, _kinds.NOT_LITERAL, _kinds.ANY, _kinds.IN):
            white = (kind is _kinds.LITERAL and chr(value).isspace()) or (kind is _kinds.IN and all(
                own == (_kinds.CATEGORY, _kinds.CATEGORY_SPACE) or (own[0] is _kinds.LITERAL and chr(own[1]).isspace()) for own in value))
            most += not white
        elif kind is _kinds.SUBPATTERN:
            most += _bounds(list(value[-1]))
        elif kind is _kinds.BRANCH:
            most += max(_bounds(list(branch)) for branch in value[1])
        elif kind in (_kinds.MAX_REPEAT, _kinds.MIN_REPEAT):
            own = _bounds(list(value[2]))
            most += 0 if not own else math.inf if value[1] is _kinds.MAXREPEAT else own * value[1]
        else:
            raise KeyError(kind)
    return most


def _until_white(items: list, way: int) -> tuple[float, float]:
    """The most characters before the first white space, and in a match without any, read forward (1) or back (-1); -1 if there is none."""
    until, without = -1, 0
    for kind, value in items[::way]:
        if kind is _kinds.SUBPATTERN:
            u, w = _until_white(list(value[-1]), way)
        elif kind is _kinds.BRANCH:
            u, w = map(max, zip(*(_until_white(list(branch), way) for branch in value[1])))
        elif kind in (_kinds.MAX_REPEAT, _kinds.MIN_REPEAT):
            u, w = _until_white(list(value[2]), way)
            most = math.inf if value[1] is _kinds.MAXREPEAT else value[1]
            u = u + (w * (most - 1) if w > 0 else 0) if u >= 0 and most else -1
            w = w * most if w > 0 and most else 0 if w == 0 or not value[0] else -1
        else:
            u, w = (-1, 1) if _bounds([(kind, value)]) else (0, -1)
        if u >= 0:
            until = max(until, without + u)
        if w < 0:
            return until, -1
        without += w
    return until, without


def _candidates(nears: list[tuple[int, Near]], wide: list[tuple[int, list[str]]]):
    """Task function: (key, low) to (key, texts, numbers): parts of the text, or the whole, and the patterns to match them by."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton, ids = ahocorasick.Automaton(), {}
        for literal in itertools.chain(*(n.first + n.second for _, n in nears), *(own for _, own in wide)):
            if literal not in ids:
                ids[literal] = len(ids)
                automaton.add_word(literal, ids[literal])
        automaton.make_automaton()
        n = len(ids) + 1
        size = np.array([*map(len, ids), 0])
        owners: list[list[int]] = [[] for _ in range(n)]
        for number, literals in wide:
            for literal in literals:
                owners[ids[literal]].append(number)
        owned = np.array([bool(own) for own in owners])
        # One row per pattern and pair of literals, sorted by pair; the pair of a pattern with one literal ends in no literal.
        rows = [(ids[a] * n + (ids[b] if b else n - 1), number, near.gap, near.lead, near.tail, near.before, near.after)
                for number, near in nears for a in near.first for b in near.second or [""]]
        pair, numbers, gaps, leads, tails, befores, afters = np.array(sorted(rows), dtype=np.int64).reshape(-1, 7).T
        firsts, seconds = pair // n, pair % n
        alone = np.zeros(n, bool)
        alone[firsts[seconds == n - 1]] = True
        # Per literal the farthest of its patterns; -1 if it is never the first, or the second, of two.
        reach, lead, tail = (np.full(n, -1) for _ in range(3))
        two = seconds < n - 1
        for farthest, literal, bound in ((reach, firsts, gaps), (lead, firsts, leads), (tail, seconds, tails)):
            np.maximum.at(farthest, literal[two], bound[two])
        far = REACH + 1
        # Most pairs of hits are no pair of a pattern: a table by remainder tells before the exact search.
        known = np.zeros((1 << 20) + 7, bool)
        known[pair % len(known)] = True

        def places(starts, ends, found, solid, space):
            """Indexes of hits (a, b) that can be the literals of one pattern; b is -1 for a pattern with one literal."""
            one = np.flatnonzero(alone[found])
            yield one, np.full(len(one), -1)
            white = np.flatnonzero(space)
            first, second = np.flatnonzero(lead[found] >= 0), np.flatnonzero(tail[found] >= 0)
            to_white = solid[white[np.searchsorted(white, ends[first])]] - solid[ends[first]]
            first = first[to_white <= lead[found[first]]]
            # The text begins behind a separator or at 0.
            edge = np.concatenate([[0], white + 1])
            from_white = solid[starts[second]] - solid[edge[np.searchsorted(edge, starts[second], "right") - 1]]
            second = second[from_white <= tail[found[second]]]
            second = second[np.argsort(starts[second], kind="stable")]
            low = np.searchsorted(starts[second], ends[first])
            high = np.searchsorted(solid[starts[second]], solid[ends[first]] + reach[found[first]], "right")
            count = np.maximum(high - low, 0)
            upto = np.cumsum(count)
            at = 0
            while at < len(first):
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PLACES, "right")))
                own = count[at:to]
                yield np.repeat(first[at:to], own), second[np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own) + np.repeat(low[at:to], own)]
                at = to

        for batch in slices(batches, 1):
            texts = batch.column(1).to_pylist()
            joined = "\n".join([*texts, ""])
            begin = np.cumsum([0, *(len(x) + 1 for x in texts)])
            flat = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            space = SPACES[np.minimum(flat, len(SPACES) - 1)]
            solid = np.concatenate([[0], np.cumsum(~space)])
            # Texts lie too far apart to be reached from each other.
            solid += np.repeat(np.arange(len(begin)), [*np.diff(begin), 1]) * far
            hits = np.fromiter(itertools.chain.from_iterable(automaton.iter(joined)), np.int64).reshape(-1, 2) if ids else np.zeros((0, 2), np.int64)
            ends, found = hits[:, 0] + 1, hits[:, 1]
            starts = ends - size[found]
            row = np.searchsorted(begin, starts, "right") - 1
            whole = ends < begin[row + 1]
            ends, found, starts, row = ends[whole], found[whole], starts[whole], row[whole]
            parts: dict[tuple[int, int], set[str]] = {}
            for a, b in places(starts, ends, found, solid, space):
                key = found[a] * n + np.where(b < 0, n - 1, found[b])
                likely = known[key % len(known)]
                a, b, key = a[likely], b[likely], key[likely]
                at = np.searchsorted(pair, key)
                many = np.searchsorted(pair, key, "right") - at
                a, b = np.repeat(a, many), np.repeat(b, many)
                at = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at, many)
                last, next_start = np.where(b < 0, ends[a], ends[b]), np.where(b < 0, ends[a], starts[b])
                good = solid[next_start] - solid[ends[a]] <= gaps[at]
                a, at, last = a[good], at[good], last[good]
                left = np.where(befores[at] < 0, starts[a], np.maximum(np.searchsorted(solid, solid[starts[a]] - befores[at]), begin[row[a]]))
                right = np.where(afters[at] < 0, last, np.minimum(np.searchsorted(solid, solid[last] + afters[at], "right") - 1, begin[row[a] + 1] - 1))
                for r, number, x, y in zip(row[a].tolist(), numbers[at].tolist(), left.tolist(), right.tolist()):
                    parts.setdefault((r, number), set()).add(joined[x:y])
            wide_hits = np.flatnonzero(owned[found])
            asked: dict[int, set[int]] = {}
            for r, own in set(zip(row[wide_hits].tolist(), found[wide_hits].tolist())):
                asked.setdefault(r, set()).update(owners[own])
            keys = pa.array([r for r, _ in parts] + list(asked), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(keys), pa.array([sorted(own) for own in parts.values()] + [[texts[r]] for r in asked], pa.list_(pa.string())),
                pa.array([[number] for _, number in parts] + [sorted(own) for own in asked.values()], pa.list_(pa.int32()))],
                [batch.schema.names[0], "texts", "numbers"])
    return run


def regex_matches(df: DataFrame, key: str, text: str, lexicon: DataFrame, folded: int = FOLDED_ENTRIES, block: int = BLOCK_ENTRIES) -> DataFrame:
    """(key, category, pattern) for each entry (category, pattern) whose regular expression is found in the lower-cased text.

    Null texts are empty. Repeated entries give repeated rows; empty patterns never match. The lexicon is read in blocks of
    at most about `block` entries, so its size is bounded by nothing but the number of passes.
    """
    entries = lexicon.select("category", "pattern").where(F.length("pattern") > 0)
    n = entries.count()
    parts = max(1, -(-n // block))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    texts, out = df.select(key, low.alias("low")), []
    kind = texts.schema[0].dataType.simpleString()
    for part in range(parts):
        rows = [(r["category"], r["pattern"]) for r in entries.where(F.pmod(F.xxhash64("category", "pattern"), F.lit(parts)) == part).collect()]
        nears = [near_literals(p) for _, p in rows]
        literals = [[] if near else required_literals(p) for near, (_, p) in zip(nears, rows)]
        known = [i for i, own in enumerate(literals) if own or nears[i]]
        if known:
            table = df.sparkSession.createDataFrame(pa.table({
                "number": pa.array(known, pa.int32()), "category": pa.array([rows[i][0] for i in known], pa.string()), "pattern": pa.array([rows[i][1] for i in known], pa.string())}))
            search = _candidates([(i, nears[i]) for i in known if nears[i]], [(i, literals[i]) for i in known if literals[i]])
            proposed = texts.mapInArrow(search, f"{key} {kind}, texts array<string>, numbers array<int>")
            # The block's patterns are at most `block` rows beside the texts.
            matched = proposed.select(key, "texts", F.explode("numbers").alias("number")).join(F.broadcast(table), "number")
            out.append(matched.where(F.exists("texts", lambda own: F.regexp(own, F.col("pattern")))).select(key, "category", "pattern"))
        open_ones = [row for row, near, own in zip(rows, nears, literals) if not near and not own]
        for at in range(0, len(open_ones), folded):
            tests = [F.when(F.col("low").rlike(p), F.struct(F.lit(c).alias("category"), F.lit(p).alias("pattern"))) for c, p in open_ones[at:at + folded]]
            out.append(texts.select(key, F.explode(F.array_compact(F.array(*tests))).alias("m")).select(key, "m.*"))
    if not out:
        return df.sparkSession.createDataFrame([], f"{key} {kind}, category string, pattern string")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
