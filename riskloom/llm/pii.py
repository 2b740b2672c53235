"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Kinds: email, ip, card (Luhn), phone; the method adds iban (mod 97) and national number (nine to eleven grouped digits with
no checksum of their own, so reported only beside a context word). A text is worked off in one pass per kind, in Arrow
batches, in time that grows with its length and its spans.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.columns import Carried, whole

# Every loop is possessive or starts only where a run starts, so a text of one long run is scanned in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Only the first four characters are taken, so a number is tried at each of them; what may follow is looked at.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+))")
NATIONAL = re.compile(r"(?<![A-Za-z0-9.+-])[0-9]{2,4}-[0-9]{2,4}-[0-9]{3,5}(?![A-Za-z0-9-])")
#: Length of an account number by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
BASE, ADDED = ("email", "ip", "card", "phone"), ("iban", "national")

# Words that raise the score of a span when they stand before it within CONTEXT characters.
CONTEXT_WORDS = {
    "email": "mail|contact|write|reach", "ip": "(^|[^a-z0-9])ip([^a-z0-9]|$)|address|host|server", "card": "card|visa|master|credit|payment",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank|konto|compte|cuenta", "national": "ssn|social|passport|tax|insurance|national",
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national": 0.2}
CONTEXT, BONUS, FLOOR = 40, 0.4, 0.5


_COUNTRY = {c: n for n, names in IBAN_LENGTHS.items() for c in names.split()}
_NUMBER = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}") for n in IBAN_LENGTHS}
_CONTEXT = {kind: re.compile(words) for kind, words in CONTEXT_WORDS.items()}
_NOT_DIGIT = re.compile("[^0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(text: str) -> bool:
    """The digits of `text`, 13 to 19 of them, pass the Luhn check."""
    digits = [int(d) for d in reversed(_NOT_DIGIT.sub("", text))]
    return 13 <= len(digits) <= 19 and (sum(digits[::2]) + sum(_DOUBLED[d] for d in digits[1::2])) % 10 == 0


def mod97(text: str) -> bool:
    """The international account number check: first four characters last, letters as 10 to 35, remainder 1."""
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses around each @: the run of characters before it that no address before has taken, and the domain after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        if domain:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                done = domain.end()
                yield start, done
        at = text.find("@", max(at + 1, done))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Proposed account numbers: as long as their country's are; of other codes, the whole run."""
    for m in IBAN.finditer(text):
        size = _COUNTRY.get(m[0][:2])
        number = _NUMBER[size].match(text, m.start(), m.end(1)) if size else None
        if not size:
            yield m.start(), m.end(1)
        elif number:
            yield number.span()


def spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Start and end (exclusive) of the valid spans of each kind, in order."""
    return {
        "email": list(_emails(text)),
        "ip": [m.span() for m in IP.finditer(text) if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in (q.lstrip("0") for q in m[0].split(".")))],
        "card": [m.span() for m in CARD.finditer(text) if luhn(m[0])],
        "phone": [m.span() for m in PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15],
        "iban": [(s, e) for s, e in _ibans(text) if mod97(text[s:e])],
        "national": [m.span() for m in NATIONAL.finditer(text)],
    }


def judged(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, s, e, score) by kind, then start. Base kinds whenever valid; added kinds when their score reaches the floor and
    they overlap no base span."""
    found, out = spans(text), []

    def score(kind: str, s: int) -> float:
        near = _CONTEXT[kind].search(text[max(0, s - CONTEXT):s].lower())
        return min(1.0, PRIOR[kind] + (BONUS if near else 0.0))

    for kind in BASE:
        out += [(kind, s, e, score(kind, s)) for s, e in found[kind]]
    taken = sorted((s, e) for _, s, e, _ in out)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for kind in ADDED:
        for s, e in found[kind]:
            # Of the base spans that start before this one's end, the farthest end.
            before = bisect_left(starts, e)
            if (not before or reach[before - 1] <= s) and (sure := score(kind, s)) >= FLOOR:
                out.append((kind, s, e, sure))
    return out


def redacted(text: str) -> str:
    """The text with its spans replaced by their kind in brackets. Overlapping ones are one, of the kind that starts first (of
    equal starts the shorter)."""
    out, to = [], 0
    for s, e, kind in sorted((s, e, kind) for kind, s, e, _ in judged(text)):
        if s >= to:
            out += [text[to:s], f"[{kind.upper()}]"]
        to = max(to, e)
    return "".join([*out, text[to:]]) if out else text


_PII = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64()), ("score", pa.float64())]))


def _mapped(keep: int, name: str, kind: pa.DataType, work: Callable[[str], object]):
    """Task function: the first `keep` columns and `work` of the text after them, null for null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if t is None else work(t) for t in map(pa.StringScalar.as_py, batch.column(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(made, kind)], [*batch.schema.names[:keep], name])
    return run


def _rows(text: str) -> list[dict]:
    return [{"kind": k, "s": s, "e": e, "score": x} for k, s, e, x in judged(text)]


def find(docs: DataFrame) -> DataFrame:
    """`docs` with `pii`: array<struct<kind,s,e,score>> by kind, then start. Code points, e exclusive.

    Base kinds are reported whenever they are valid; added kinds only when their score reaches the floor and they do not
    overlap a base span. Null text has none. Other columns pass unchanged; one named `pii` is replaced. Repeated rows get equal
    spans, an empty table gives no rows, and a text of any length is read whole, in time that grows with its length and spans.
    """
    carried = Carried(docs, ("pii",))
    frame = docs.select(*carried.inside(), whole("text").alias("_t"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema[:-1]), "pii array<struct<kind:string,s:bigint,e:bigint,score:double>>"])
    made = frame.mapInArrow(_mapped(len(frame.columns) - 1, "pii", _PII, _rows), schema)
    return made.select(*carried.outside(), "pii")


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span of `find` in `text` replaced by its kind in brackets; null text stays null.

    Overlapping spans are replaced as one, by the kind of the one that starts first. Columns are those of `docs`, in their
    order; rows, repeated ones too, stay; an empty table gives no rows.
    """
    carried = Carried(docs, ("text",))
    frame = docs.select(*carried.inside(), F.col("text").alias("_t"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema[:-1]), "_clean string"])
    made = frame.mapInArrow(_mapped(len(frame.columns) - 1, "_clean", pa.string(), redacted), schema)
    names = dict(zip(carried.names, carried.outside()))
    return made.select(*[names.get(c, F.col("_clean").alias(c)) for c in docs.columns])
