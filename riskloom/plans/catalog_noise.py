"""Seeded row noise over documents and its report."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import noise
from riskloom.plans.fixture import quoted
from riskloom.plans.registry import query
from riskloom.session import spread


def _register(kind: str):
    @query(f"noise_{kind}")
    def _(t):
        rows = noise.augment(spread(t("documents").select("doc_id", "text")), "doc_id", "text", 42, [kind], {kind: 1.0})
        return rows.select("doc_id", F.col(f"noise_{kind}").alias("changed"), F.sha2("perturbed_text", 256).alias("digest"))


for _kind in noise.STEP_PROBABILITY:
    _register(_kind)


@query("noise_all_kinds")
def _(t):
    rows = noise.augment(spread(t("documents").select("doc_id", "text", "lang")), "doc_id", "text")
    return rows.select("doc_id", *[f"noise_{k}" for k in noise.STEP_PROBABILITY], "perturbation_score",
                       F.sha2("perturbed_text", 256).alias("digest"))


# The draws have no SQL form; a test holds the shares against the flags of noise_all_kinds.
@query("noise_report")
def _(t):
    rows = noise.augment(spread(t("documents").select("doc_id", "text", "lang")), "doc_id", "text")
    return noise.noise_report(rows, list(noise.STEP_PROBABILITY), ["lang"])


#: All tone-marked forms and the letter each stands for, in step.
_FORMS = "".join(noise.TONES.values())
_BARE = "".join(letter * len(forms) for letter, forms in noise.TONES.items())
_WORDS = r"\s+"


def _split_words(text):
    return F.filter(F.split(text, _WORDS), lambda w: w != "")


def _sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{_WORDS}'), lambda w: w <> '')"


def _joined(text):
    return F.array_join(_split_words(text), " ")


def _sql_joined(text: str) -> str:
    return f"array_to_string({_sql_words(text)}, ' ')"


def _without(text, parts):
    for part in parts:
        text = F.replace(text, F.lit(part), F.lit(""))
    return text


def _sql_without(text: str, parts) -> str:
    for part in parts:
        text = f"replace({text}, {quoted(part)}, '')"
    return text


def _letters_of(table):
    return "".join(table), "".join(table.values())


def _plain_slang(text):
    known = F.create_map(*[F.lit(x) for pair in noise.SLANG.items() for x in pair])
    return F.array_join(F.transform(_split_words(F.lower(text)), lambda w: F.coalesce(F.element_at(known, w), w)), " ")


def _sql_plain_slang(text: str) -> str:
    known = "map {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in noise.SLANG.items()) + "}"
    return f"array_to_string(list_transform({_sql_words(f'lower({text})')}, lambda w: coalesce({known}[w], w)), ' ')"


def _once(text):
    words = _split_words(text)
    # Each word beside the one before it; joining leaves out the nulls.
    return F.array_join(F.zip_with(words, F.concat(F.array(F.lit("")), words), lambda w, before: F.when(w != before, w)), " ")


def _sql_once(text: str) -> str:
    pairs = f"(SELECT list_zip(w, list_prepend('', w)) FROM (SELECT {_sql_words(text)} AS w))"
    return f"array_to_string(list_transform(list_filter({pairs}, lambda x: x[1] <> x[2]), lambda x: x[1]), ' ')"


def _folded(text):
    # The capitals of this one letter are two.
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _sql_folded(text: str) -> str:
    return f"replace(lower({text}), 'ß', 'ss')"


#: What a kind of noise never changes, as a column of the text and in SQL: equal before and after.
_KEPT = {
    "whitespace": (_joined, _sql_joined),
    "case": (lambda t: _joined(_folded(t)), lambda t: _sql_joined(_sql_folded(t))),
    "emoji": (lambda t: _joined(_without(t, noise.EMOJIS)), lambda t: _sql_joined(_sql_without(t, noise.EMOJIS))),
    "punctuation": (lambda t: F.rtrim(_without(t, noise.MARKS)), lambda t: f"rtrim({_sql_without(t, noise.MARKS)}, ' ')"),
    "leetspeak": (lambda t: F.translate(F.lower(t), *_letters_of(noise.LEET)),
                  lambda t: "translate(lower({}), '{}', '{}')".format(t, *_letters_of(noise.LEET))),
    "tones": (lambda t: F.translate(F.lower(t), _FORMS, _BARE), lambda t: f"translate(lower({t}), '{_FORMS}', '{_BARE}')"),
    "slang": (_plain_slang, _sql_plain_slang),
    "repetition": (_once, _sql_once),
    # A typo is in one word and leaves all others and the number of words.
    "typos": (lambda t: F.size(_split_words(t)).cast("string"), lambda t: f"len({_sql_words(t)})::VARCHAR"),
}


def _register_kept(kind: str):
    kept, sql = _KEPT[kind]

    @query(f"noise_{kind}_kept", f"""
        SELECT doc_id, sha256({sql("coalesce(text, '')")}) AS kept_digest FROM documents""")
    def _(t):
        rows = noise.augment(spread(t("documents").select("doc_id", "text")), "doc_id", "text", 42, [kind], {kind: 1.0})
        return rows.select("doc_id", F.sha2(kept(F.col("perturbed_text")), 256).alias("kept_digest"))


for _kind in noise.STEP_PROBABILITY:
    _register_kept(_kind)


#: Kinds whose traces can be wiped off in any company: the others change words or their number.
_WIPED = ("leetspeak", "emoji", "whitespace", "punctuation", "case", "tones")


def _wiped(text):
    return F.translate(F.translate(_folded(_joined(_without(_without(text, noise.EMOJIS), noise.MARKS))), _FORMS, _BARE), *_letters_of(noise.LEET))


def _sql_wiped(text: str) -> str:
    bare = f"translate({_sql_folded(_sql_joined(_sql_without(_sql_without(text, noise.EMOJIS), noise.MARKS)))}, '{_FORMS}', '{_BARE}')"
    return "translate({}, '{}', '{}')".format(bare, *_letters_of(noise.LEET))


@query("noise_wiped_off", f"""
    SELECT doc_id, sha256({_sql_wiped("coalesce(text, '')")}) AS kept_digest, lang FROM documents""")
def _(t):
    rows = noise.augment(spread(t("documents").select("doc_id", "text", "lang")), "doc_id", "text", 42, _WIPED)
    return rows.select("doc_id", F.sha2(_wiped(F.col("perturbed_text")), 256).alias("kept_digest"), "lang")
