"""Secret scan: multipart credentials linked by an interval join.

A credential has up to three parts: an identifier, a secret, an endpoint. Assignments with a telling name, cloud access
identifiers and long hexadecimal runs are strong and always reported. Weak candidates (named accounts, unlabelled
high-entropy runs, hosts and addresses) are common in harmless text, so they are reported only when parts that complete
them lie in the same scope: SCOPE characters of the same text.

The interval join meets in cells of SCOPE characters. Per text, cell and role only the first start and the last end are
kept, which decide whether any part of that role is near enough; so a text full of candidates costs no more than its
candidates, and never their pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import apart, spans, text_key, whole
from riskloom.session import written


def any_case(pattern: str) -> str:
    """Each letter in either case, written out."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


_ASSIGNED = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = f"({any_case('password')}|{any_case('passwd')}|{any_case('secret')}|{any_case('token')}|{any_case('api_?key')}){_ASSIGNED}([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
NAMED = "(?:" + "|".join(any_case(w) for w in ("user", "username", "login", "account", "client_?id", "access_?key_?id")) + f"){_ASSIGNED}[A-Za-z0-9@._-]" + "{3,}"
RANDOM = r"[A-Za-z0-9+/_-]{32,}={0,2}"
HOST = "(?:[Hh][Tt][Tt][Pp][Ss]?://|" + "(?:" + "|".join(any_case(w) for w in ("host", "endpoint", "server")) + f"){_ASSIGNED})" + r"[A-Za-z0-9._:/-]{4,}"

#: Strong kinds as listed, then weak ones; the role each plays.
BASE = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
WEAK = {"named": NAMED, "random": RANDOM, "host": HOST}
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "named": "identifier", "random": "secret", "host": "endpoint"}
#: Characters between two parts, at most.
SCOPE = 200


def _parts(text: Column) -> dict[str, Column]:
    found = {kind: spans(text, pattern) for kind, pattern in (BASE | WEAK).items()}
    found["assign"] = F.filter(found["assign"], lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6)
    found["access"] = F.filter(found["access"], lambda x: F.length(x["m"]) >= 20)
    found["random"] = F.filter(found["random"], lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[a-z]") & x["m"].rlike("[A-Z]"))
    return found


def _named(found: Column, kind: str) -> Column:
    rank = list(ROLES).index(kind)
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("rank"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base, added: arrays of struct<s,rank,e,kind> by start, then kind, in code points, e exclusive.

    One row per row of `docs`, none for an empty table; a text of any length is read whole, in time that grows with its length
    and its spans. Equal texts get equal results, null text has no spans, other columns are ignored. A weak
    candidate that overlaps a strong span is part of it and is not reported.
    """
    text = F.col("_t")
    frame = docs.select("doc_id", whole("text").alias("_t")).withColumn("text_key", text_key(text))
    made = {f"_{kind}": _named(found, kind) for kind, found in _parts(text).items()}
    frame = frame.withColumns(made).withColumns({
        "base": F.sort_array(F.concat(*[f"_{k}" for k in BASE])), "_loose": F.concat(*[f"_{k}" for k in WEAK])})
    frame = written(frame.withColumn("weak", apart(F.col("_loose"), F.col("base"))).select("doc_id", "text_key", "base", "weak"), "secret-parts")

    open_texts = frame.where(F.size("weak") > 0).where(F.size("base") + F.size("weak") > 1).select("text_key", "base", "weak").distinct()
    parts = open_texts.select("text_key", F.explode(F.concat("base", "weak")).alias("p")).select("text_key", "p", F.element_at(
        F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair]), F.col("p.kind")).alias("role"))
    cells = F.explode(F.sequence(F.floor(F.col("p.s") / SCOPE), F.floor((F.col("p.e") - 1) / SCOPE))).alias("cell")
    edges = parts.select("text_key", "role", "p", cells).groupBy("text_key", "role", "cell").agg(
        F.min("p.s").alias("first"), F.max("p.e").alias("last"))
    around = F.explode(F.sequence(F.floor(F.col("p.s") / SCOPE) - 1, F.floor((F.col("p.e") - 1) / SCOPE) + 1)).alias("cell")
    weak = parts.where(F.col("p.kind").isin(*WEAK)).select("text_key", F.col("role").alias("own"), "p", around)
    near = (F.col("first") - F.col("p.e") <= SCOPE) & (F.col("p.s") - F.col("last") <= SCOPE)
    met = weak.join(edges, ["text_key", "cell"]).where((F.col("own") != F.col("role")) & near)
    roles = met.groupBy("text_key", "own", "p").agg(*[F.max((F.col("role") == r).cast("int")).alias(r) for r in ("identifier", "secret", "endpoint")])
    # A secret needs an identifier or an endpoint, an identifier a secret, an endpoint both of the others.
    complete = (((F.col("own") == "secret") & (F.col("identifier") + F.col("endpoint") > 0)) | ((F.col("own") == "identifier") & (F.col("secret") > 0))
                | ((F.col("own") == "endpoint") & (F.col("identifier") + F.col("secret") > 1)))
    added = roles.where(complete).groupBy("text_key").agg(F.sort_array(F.collect_list("p")).alias("added"))
    none = F.array().cast(frame.schema["base"].dataType)
    return frame.join(added, "text_key", "left").select("doc_id", "text_key", "base", F.coalesce("added", none).alias("added"))
