"""Quality rules: repetition and length rules, then divergence from the language's own histograms.

A document's characters are counted in seven classes and its words in the common words below. Both histograms are
compared, by Jensen-Shannon divergence in bits, with those of all documents of the same `lang` value (null is a value of
its own). Documents shorter than a guard are not judged by divergence: their histograms are mostly noise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import Carried, let, space_words, whole
from riskloom.session import written

# The commonest function words of the four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "ist"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del"],
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words})
# Counted among the characters that stay when lower-case letters, spaces and all beyond ASCII are taken out.
CLASSES = {"upper": r"[A-Z]+", "digit": r"[0-9]+", "stop": r"[.,;:'()-]+", "symbol": r"[#*$%&|<>]+"}
PLAIN = r"[a-z\x20\x09-\x0D\x{80}-\x{10FFFF}]+"
BINS = len(CLASSES) + 3
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
# A document of n words, GUARD_WORDS at least, is rejected over limit + noise / n bits.
GUARD_WORDS, CHAR_LIMIT, CHAR_NOISE, WORD_LIMIT, WORD_NOISE = 50, 0.045, 3.0, 0.035, 5.0


def with_histograms(frame: DataFrame, text: str, words: str) -> DataFrame:
    """Adds word_chars, n_symbols, and the counts _q_chars and _q_common (by class, by common word; all of them last).

    Character bins: the classes above, white space, extra bytes of characters beyond ASCII, all characters.
    """
    frame = frame.withColumns({
        "_q_hits": F.filter(words, lambda w: w.isin(WORDS)), "_q_marks": F.regexp_replace(text, PLAIN, ""),
        "word_chars": F.length(F.array_join(words, "")).cast("long")})
    frame = frame.withColumn("_q_line", F.concat(F.lit(" "), F.array_join("_q_hits", "  "), F.lit(" ")))
    counts = [F.length("_q_marks") - F.length(F.regexp_replace("_q_marks", p, "")) for p in CLASSES.values()]
    each = [(F.length("_q_line") - F.length(F.replace("_q_line", F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2) for w in WORDS]
    return frame.withColumns({
        "n_symbols": counts[-1].cast("long"),
        "_q_chars": F.array(*counts, F.length(text) - F.col("word_chars"), F.octet_length(text) - F.length(text), F.length(text)).cast("array<bigint>"),
        "_q_common": F.array(*each, F.size(words)).cast("array<bigint>")})


def _rest(counts: Column) -> Column:
    """The last entry holds the total: what the others leave of it takes its place."""
    return F.concat(F.slice(counts, 1, F.size(counts) - 1), F.array(2 * F.element_at(counts, -1) - _sum(counts)))


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def divergence(mine: str, theirs: str, total: str, their_total: str) -> Column:
    """Jensen-Shannon divergence in bits of two count columns with their totals; null if either is empty."""
    def term(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def both(n: Column, k: Column) -> Column:
        p, q = n / F.nullif(F.col(total), F.lit(0)), k / F.nullif(F.col(their_total), F.lit(0))
        return (term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2

    return F.aggregate(F.zip_with(mine, theirs, both), F.lit(0.0), lambda a, x: a + x)


def references(docs: DataFrame) -> DataFrame:
    """Histograms of all documents of each `lang` value, from those long enough to be judged."""
    frame = docs.select("lang", whole("text").alias("_t")).withColumn("_w", space_words(F.col("_t")))
    bins = with_histograms(frame, "_t", "_w").where(F.size("_w") >= GUARD_WORDS)
    sums = bins.groupBy("lang").agg(
        *[F.sum(F.col("_q_chars")[i]).alias(f"c{i}") for i in range(BINS)],
        *[F.sum(F.col("_q_common")[i]).alias(f"h{i}") for i in range(len(WORDS) + 1)])
    return sums.select(
        F.col("lang").alias("_q_ref_lang"), _rest(F.array(*[f"c{i}" for i in range(BINS)])).alias("_q_ref_chars"),
        _rest(F.array(*[f"h{i}" for i in range(len(WORDS) + 1)])).alias("_q_ref_words"),
        F.col(f"c{BINS - 1}").alias("_q_ref_length"), F.col(f"h{len(WORDS)}").alias("_q_ref_size"))


def with_windows(frame: DataFrame, words: str) -> DataFrame:
    """Adds _q_h8, the hashes of all 8-word windows in order: hashes of 1, 2, 4 and 8 words, each from two of the ones before."""
    frame = frame.withColumn("_q_h1", F.transform(words, lambda w: F.xxhash64(w)))
    for size in (2, 4, 8):
        half = f"_q_h{size // 2}"
        frame = frame.withColumn(f"_q_h{size}", F.zip_with(
            half, F.slice(half, size // 2 + 1, F.greatest(F.size(half), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    return frame.withColumn("_q_h8", F.slice("_q_h8", 1, F.greatest(F.size("_q_h8") - WINDOW + 1, F.lit(0))))


def _covered(hashes: Column) -> Column:
    """Words covered by the windows whose hash stands twice or more, from all window hashes in order."""
    order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(o: Column) -> Column:
        # Sorted neighbours with equal hashes.
        def same(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(o, k)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(o, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    def words(marked: Column) -> Column:
        return F.aggregate(F.transform(marked, lambda i, k: F.least(F.lit(WINDOW), i - F.coalesce(F.get(marked, k - 1), F.lit(-WINDOW)))),
                           F.lit(0).cast("bigint"), lambda a, n: a + n)

    return let(let(order, repeated), words)


def measure(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, js_chars, js_words, base_failed, kept.

    Null text counts as empty and fails the base rule. Input columns stay, but a column named like an output is replaced.
    Ties and repeated rows get the same values; an empty table gives an empty result. Only column expressions run; the
    references (one row per `lang` value) are written first, so the planner sees their true size.
    """
    refs = written(references(docs), "quality-refs")
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_chars", "js_words", "base_failed", "kept")
    carried = Carried(docs, made)
    text = F.col("_q_text")
    frame = docs.select(*carried.inside(), F.col("lang").alias("_q_lang"), whole("text").alias("_q_text")).withColumn("_q_words", space_words(text))
    words = F.col("_q_words")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    frame = with_histograms(frame, "_q_text", "_q_words").withColumn("_q_lines", lines)
    frame, windows = with_windows(frame, "_q_words"), F.col("_q_h8")
    frame = frame.withColumns({
        "n_words": F.size(words).cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct(windows)) < F.size(windows), _covered(windows)).otherwise(F.lit(0)).cast("long"),
    })
    frame = frame.withColumns({
        "_q_length": F.length("_q_text"), "_q_chars": _rest(F.col("_q_chars")), "_q_common": _rest(F.col("_q_common"))})
    frame = frame.join(refs, frame["_q_lang"].eqNullSafe(refs["_q_ref_lang"]), "left")
    frame = frame.withColumns({
        "js_chars": F.round(divergence("_q_chars", "_q_ref_chars", "_q_length", "_q_ref_length"), 6),
        "js_words": F.round(divergence("_q_common", "_q_ref_words", "n_words", "_q_ref_size"), 6),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    })
    far = (F.col("n_words") >= GUARD_WORDS) & ((F.col("js_chars") > CHAR_LIMIT + CHAR_NOISE / F.col("n_words"))
                                               | (F.col("js_words") > WORD_LIMIT + WORD_NOISE / F.col("n_words")))
    frame = frame.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))
    return frame.select(*carried.outside(), *made)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that `measure` keeps, with all their columns.

    Verdicts are written before they are used: a filter on them would be pushed down and compute each measure many times.
    """
    carried = Carried(docs)
    inside = docs.select(*carried.inside(), "text", "lang")
    judged = written(measure(inside).select(*inside.columns[:-2], "kept"), "quality-kept")
    return judged.where("kept").select(*carried.outside())
