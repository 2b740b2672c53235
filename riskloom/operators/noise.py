"""Seeded row noise for text tables, as column expressions.

Every draw is a hash of (row id, kind, place, seed): a row gives the same output on any partitioning
and after any retry. A flag tells whether its own step changed the text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Probabilities of the steps, in the order they run.
STEP_PROBABILITY = {
    "typos": 0.15, "leetspeak": 0.20, "emoji": 0.30, "whitespace": 0.10, "punctuation": 0.12,
    "case": 0.18, "repetition": 0.08, "tones": 0.20, "slang": 0.25,
}
# Substitutions.
LEET = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "t": "7", "l": "1", "g": "9", "b": "8", "z": "2"}
SLANG = {
    "không": "ko", "khong": "ko", "gì": "j", "gi": "j", "bạn": "bn", "ban": "bn", "mình": "mk", "minh": "mk",
    "vui": "vl", "buồn": "bn", "buon": "bn", "đẹp": "dp", "dep": "dp", "hay": "h", "ok": "ok", "oke": "ok",
    "thanks": "tk", "thank": "tk", "sorry": "sr",
}
EMOJIS = ("😂", "😭", "😱", "🔥", "💯", "🎉", "🤑", "😎", "👍", "❤️", "💪", "🙏", "😊", "🤔", "👏")
TONES = {
    "a": "áàảãạ", "ă": "ắằẳẵặ", "â": "ấầẩẫậ", "e": "éèẻẽẹ", "ê": "ếềểễệ", "i": "íìỉĩị", "o": "óòỏõọ",
    "ô": "ốồổỗộ", "ơ": "ớờởỡợ", "u": "úùủũụ", "ư": "ứừửữự", "y": "ýỳỷỹỵ", "d": "đ",
}
NEARBY_KEYS = {
    "q": "was", "w": "qeasd", "e": "wrsdf", "r": "etdfg", "t": "ryfgh", "y": "tughj", "u": "yihjk", "i": "uojkl",
    "o": "ipkl", "p": "ol", "a": "qwsz", "s": "qweadzx", "d": "wersfxc", "f": "ertdgcv", "g": "rtyfhvb",
    "h": "tyugjbn", "j": "yuihknm", "k": "uiojlm", "l": "iopk", "z": "asx", "x": "zsdc", "c": "xdfv", "v": "cfgb",
    "b": "vghn", "n": "bhjm", "m": "njk",
}
END_MARKS = ("!!!", "...", "!!", "??")
MARKS = (".", ",", "!", "?", ";", ":")

_PRIME = 1_000_003


class _Draws:
    """Draws in [0, 1) for one row and one kind of noise."""

    def __init__(self, key: str, kind: str, seed: int):
        self.base = (F.col(key), F.lit(kind), F.lit(seed))

    def __call__(self, name: str, place: Column | int = 0) -> Column:
        at = place if isinstance(place, Column) else F.lit(place)
        return F.pmod(F.xxhash64(*self.base, F.lit(name), at), F.lit(_PRIME)) / float(_PRIME)

    def index(self, name: str, size: Column, place: Column | int = 0) -> Column:
        return F.floor(self(name, place) * size).cast("int")


def _lookup(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _pick(options: Sequence[str], at: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), at)


def _words(new) -> Column:
    return F.array_join(new, " ")


def _typos(d: _Draws) -> Column:
    words = F.col("_w")
    at = d.index("word", F.size(words))
    word = F.get(words, at)
    n = F.length(word)

    def cut(start, size=None):
        return F.substring(word, start, size if size is not None else n)

    i = d.index("swap", n - 1) + 1
    swapped = F.concat(cut(F.lit(1), i - 1), cut(i + 1, F.lit(1)), cut(i, F.lit(1)), cut(i + 2))
    j = d.index("delete", n - 2) + 2
    deleted = F.concat(cut(F.lit(1), j - 1), cut(j + 1))
    k = d.index("char", n) + 1
    doubled = F.concat(cut(F.lit(1), k), cut(k))
    near = F.element_at(_lookup(NEARBY_KEYS), F.lower(cut(k, F.lit(1))))
    pressed = F.substring(near, d.index("near", F.length(near)) + 1, F.lit(1))
    replaced = F.when(near.isNull(), word).otherwise(F.concat(cut(F.lit(1), k - 1), pressed, cut(k + 1)))
    kind = d.index("kind", F.lit(4))
    new = F.when(kind == 0, swapped).when(kind == 1, deleted).when(kind == 2, doubled).otherwise(replaced)
    changed = F.concat(F.slice(words, F.lit(1), at), F.array(new), F.slice(words, at + 2, F.size(words)))
    return F.when((F.size(words) == 0) | (n <= 2), F.col("_t")).otherwise(_words(changed))


def _leetspeak(d: _Draws) -> Column:
    return F.array_join(F.transform(F.split(F.lower("_t"), ""), lambda c, i: F.when(
        d("char", i) < 0.3, F.coalesce(F.element_at(_lookup(LEET), c), c)).otherwise(c)), "")


def _slang(d: _Draws) -> Column:
    return _words(F.transform("_w", lambda w, i: F.when(
        d("word", i) < 0.4, F.coalesce(F.element_at(_lookup(SLANG), F.lower(w)), w)).otherwise(w)))


def _emoji(d: _Draws) -> Column:
    # Folded, so that each of up to three insertions is one copy of the expression.
    times = d.index("times", F.lit(3)) + 1

    def insert(out: Column, n: Column) -> Column:
        at = d.index("place", F.size("_w") + 1, n)
        grown = F.concat(F.slice(out, F.lit(1), at), F.array(_pick(EMOJIS, d.index("emoji", F.lit(len(EMOJIS)), n))),
                         F.slice(out, at + 1, F.size("_w") + 3))
        return F.when(times > n, grown).otherwise(out)

    grown = F.aggregate(F.sequence(F.lit(0), F.lit(2)), F.col("_w"), insert)
    return _words(F.when(F.size("_w") == 0, F.col("_w")).otherwise(grown))


def _whitespace(d: _Draws) -> Column:
    return F.rtrim(F.array_join(F.transform("_w", lambda w, i: F.when(
        d("gap", i) < 0.2, F.concat(w, F.lit(" "))).otherwise(w)), " "))


def _punctuation(d: _Draws) -> Column:
    def drop(out: Column, mark: Column) -> Column:
        return F.when(d("drop", mark["n"]) < 0.1, F.replace(out, mark["mark"], F.lit(""))).otherwise(out)

    marks = F.array(*[F.struct(F.lit(mark).alias("mark"), F.lit(n).alias("n")) for n, mark in enumerate(MARKS)])
    more = F.when(d("add") < 0.3, _pick(END_MARKS, d.index("end", F.lit(len(END_MARKS)))))
    # One end step for both cases: the end is trimmed only where a mark is added.
    return F.aggregate(marks, F.col("_t"), drop, lambda out: F.when(more.isNull(), out).otherwise(F.concat(F.rtrim(out), more)))


def _case(d: _Draws) -> Column:
    return _words(F.transform("_w", lambda w, i: F.when(d("word", i) < 0.15, F.upper(w)).when(
        d("word", i) < 0.3, F.lower(w)).otherwise(w)))


def _repetition(d: _Draws) -> Column:
    at = d.index("word", F.size("_w"))
    copies = F.array_repeat(F.get("_w", at), d.index("times", F.lit(2)) + 2)
    grown = F.concat(F.slice("_w", F.lit(1), at), copies, F.slice("_w", at + 2, F.size("_w") + 1))
    return F.when(F.size("_w") == 0, F.col("_t")).otherwise(_words(grown))


def _tones(d: _Draws) -> Column:
    def one(c, i):
        forms = F.element_at(_lookup(TONES), F.lower(c))
        other = F.substring(F.concat(forms, F.lower(c)), d.index("form", F.length(forms) + 1, i) + 1, F.lit(1))
        changed = F.when(d("strip", i) < 0.5, F.lower(c)).otherwise(other)
        return F.when(forms.isNotNull() & (d("char", i) < 0.2), changed).otherwise(c)

    return F.array_join(F.transform(F.split("_t", ""), one), "")


_STEPS = {
    "typos": _typos, "leetspeak": _leetspeak, "emoji": _emoji, "whitespace": _whitespace, "punctuation": _punctuation,
    "case": _case, "repetition": _repetition, "tones": _tones, "slang": _slang,
}


def augment(df: DataFrame, key: str, text: str, seed: int = 42, kinds: Sequence[str] | None = None,
            probability: Mapping[str, float] | None = None) -> DataFrame:
    """Adds perturbed_text, one flag per kind, and the share of kinds that changed the text."""
    kinds = list(kinds or _STEPS)
    chance = {**STEP_PROBABILITY, **(probability or {})}
    out = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    for kind in kinds:
        d = _Draws(key, kind, seed)
        staged = out.withColumn("_w", F.filter(F.split("_t", r"\s+"), lambda w: w != ""))
        staged = staged.withColumn("_new", F.when(d("apply") <= chance[kind], _STEPS[kind](d)).otherwise(F.col("_t")))
        out = staged.withColumns({f"noise_{kind}": F.col("_new") != F.col("_t"), "_t": F.col("_new")}).drop("_w", "_new")
    fired = sum((F.col(f"noise_{k}").cast("int") for k in kinds), F.lit(0))
    return out.withColumns({"perturbed_text": F.col("_t"), "perturbation_score": fired / float(len(kinds))}).drop("_t")


def noise_report(rows: DataFrame, kinds: Sequence[str], dimensions: Sequence[str]) -> DataFrame:
    """(section, key, value): share per kind, mean score and distributions, from one scan."""
    share = [F.struct(F.lit("share_pct").alias("section"), F.lit(k).alias("key"), (F.col(f"noise_{k}").cast("double") * 100).alias("v")) for k in kinds]
    mean = [F.struct(F.lit("mean").alias("section"), F.lit("perturbation_score").alias("key"), F.col("perturbation_score").alias("v"))]
    count = [F.struct(F.concat(F.lit("count_"), F.lit(d)).alias("section"), F.col(d).cast("string").alias("key"), F.lit(None).cast("double").alias("v")) for d in dimensions]
    long = rows.select(F.explode(F.array(*share, *mean, *count)).alias("m")).select("m.*")
    return long.groupBy("section", "key").agg(F.coalesce(F.avg("v"), F.count(F.lit(1)).cast("double")).alias("value"))
