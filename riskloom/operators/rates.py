"""Quantity mentions with positions, and exchange rates far outside reference bands."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf, udtf

from riskloom.functions import fixed_values as fixed
from riskloom.functions.patterns import uni
from riskloom.sources.reference import literal_table

#: Grouped by threes or plain. It starts with one class of characters, by which a search leaps from digit to digit.
NUMBER = r"[0-9](?:[0-9]{0,2}(?:[\.,][0-9]{3})+|[0-9]*(?:[\.,][0-9]+)?)"
#: White space of all kinds, spelled out so that every engine reads it alike.
BLANKS = "[ \\t\\n\\x0b\\f\\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]*"


#: One pattern a list of units. A plain table: it travels with the job, which a cached function does not.
_PATTERNS: dict[tuple[str, ...], re.Pattern] = {}


def _mention_pattern(units: tuple[str, ...]) -> re.Pattern:
    if units not in _PATTERNS:
        longest = sorted(units, key=lambda u: (-len(u), u))
        _PATTERNS[units] = re.compile(rf"({NUMBER}){BLANKS}({'|'.join(re.escape(u) for u in longest)})(?!\w)")
    return _PATTERNS[units]


def found_mentions(text: str, units: Sequence[str]) -> Iterator[tuple[int, str, str]]:
    """(pos, raw, unit) of each `number unit` in a lower-cased text, in order. One pass, whatever the number of mentions."""
    search, at = _mention_pattern(tuple(units)).search, 0
    while m := search(text, at):
        at = m.end()
        # A combining mark goes on with the unit's last letter, so the unit ends elsewhere.
        if at < len(text) and text[at] > "\u02ff" and unicodedata.category(text[at])[0] == "M":
            at = m.start() + 1
            continue
        yield m.start(), m[1], m[2]


def number_of(raw: str) -> float | None:
    """`functions.text.parse_number` for the number of a mention."""
    dot, comma = raw.rfind("."), raw.rfind(",")
    if dot >= 0 and comma >= 0:
        plain = raw.replace(",", "") if dot > comma else raw.replace(".", "").replace(",", ".")
    else:
        mark = "." if dot >= 0 else ","
        grouped = dot + comma > -2 and all(len(part) == 3 for part in raw.split(mark)[1:])
        plain = raw.replace(mark, "" if grouped else ".")
    try:
        return float(plain)
    except ValueError:
        return None


def found_pairs(text: str, prices: Sequence[str], items: Sequence[str], proximity: int) -> Iterator[tuple[int, str, str, int, str, str]]:
    """(price_pos, price, unit, item_pos, amount, alias) of the price and item mentions that start within `proximity` of each other.

    One search finds both kinds: every mention ends at its unit, so the kinds cannot overlap. A window moves over the items in
    order, so a text costs its mentions and its pairs.
    """
    kinds = {u.lower() for u in prices}
    every = list(found_mentions(text, (*prices, *items)))
    wares, low = [m for m in every if m[2] not in kinds], 0
    if not wares:
        return
    for pos, raw, unit in every:
        if unit not in kinds:
            continue
        while low < len(wares) and wares[low][0] < pos - proximity:
            low += 1
        for k in range(low, len(wares)):
            if wares[k][0] > pos + proximity:
                break
            yield pos, raw, unit, *wares[k]


MENTION = "pos int, raw string, unit string"


def mentions(text: Column, units: Sequence[str]) -> Column:
    """All mentions of a lower-cased text as array<struct<pos, raw, unit>>."""
    wanted = tuple(units)

    @pandas_udf("array<struct<pos:int,raw:string,unit:string>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"pos": p, "raw": r, "unit": u} for p, r, u in found_mentions(t or "", wanted)])

    return found(text)


def register_mentions(spark: SparkSession, units: Sequence[str], name: str = "mentions") -> str:
    """A table function for SQL: `SELECT ... FROM t, LATERAL mentions(lower(text))` gives a row (pos, raw, unit) a mention."""
    wanted = tuple(units)

    @udtf(returnType=MENTION)
    class Mentions:
        def eval(self, text: str):
            yield from found_mentions(text or "", wanted)

    spark.udtf.register(name, Mentions)
    return name


def mention_rows(df: DataFrame, key: str, text: str, units: Sequence[str]) -> DataFrame:
    """(key, pos, raw, unit): a row per mention of the lower-cased text."""
    return mention_kinds(df, key, text, {"": units}).drop("kind")


def mention_kinds(df: DataFrame, key: str, text: str, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, kind, pos, raw, unit): a row per mention of the lower-cased text, of the kind its unit belongs to.

    One search finds all kinds: every mention ends at its unit, so the kinds cannot overlap.
    """
    kind_of = {unit.lower(): kind for kind, units in kinds.items() for unit in units}
    wanted = tuple(kind_of)
    shape = [("kind", pa.string()), ("pos", pa.int32()), ("raw", pa.string()), ("unit", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, kind_of[unit], pos, raw, unit) for i, t in enumerate(batch.column(1).to_pylist()) for pos, raw, unit in found_mentions(t, wanted)]
            yield _generated(batch, rows, shape)

    return _lowered(df, key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, kind string, {MENTION}")


def mention_counts(df: DataFrame, key: str, text: str, kinds: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, kind, pos, raw, unit, n): how often each mention stands in the texts of a key.

    Texts are dealt and sorted by key, and mentions are counted where they are found, key by key: what is shuffled is the texts
    and not their mentions, and a task holds the mentions of one key.
    """
    kind_of = {unit.lower(): kind for kind, units in kinds.items() for unit in units}
    wanted = tuple(kind_of)
    names = ["kind", "pos", "raw", "unit", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, rows, name, of = None, {}, [], key, pa.null()
        for batch in batches:
            name, of = batch.schema.names[0], batch.schema.types[0]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if k != now:
                    rows += [(now, *m, n) for m, n in counts.items()]
                    now, counts = k, {}
                for pos, raw, unit in found_mentions(t, wanted):
                    m = kind_of[unit], pos, raw, unit
                    counts[m] = counts.get(m, 0) + 1
            yield given(rows, name, of)
            rows = []
        yield given([(now, *m, n) for m, n in counts.items()], name, of)

    def given(rows: list[tuple], name: str, of: pa.DataType) -> pa.RecordBatch:
        types = [of, pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()]
        cols = list(zip(*rows)) if rows else [()] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [name, *names])

    dealt = _lowered(df, key, text).repartition(F.col(key)).sortWithinPartitions(key)
    return dealt.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, kind string, {MENTION}, n long")


def _lowered(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("low"))


def _generated(batch: pa.RecordBatch, rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    """The first column of the batch beside rows that start with a row number of the batch."""
    cols = list(zip(*rows)) if rows else [()] * (len(columns) + 1)
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, (_, t) in zip(cols[1:], columns)]],
        [batch.schema.names[0], *[n for n, _ in columns]])


def band_table(spark: SparkSession, bands=fixed.RATE_BANDS) -> DataFrame:
    """Reference bands as one row per alias: a literal table, whose size the planner knows and broadcasts."""
    rows = [(a.lower(), name, lo, hi, susp, scam) for name, aliases, lo, hi, susp, scam in bands for a in aliases]
    return literal_table(
        spark, rows, "alias string, currency string, safe_min double, safe_max double, suspicious_high double, scam_high double")


def rate_pairs(
    df: DataFrame, key: str, text: str, aliases: Sequence[str], proximity: int = fixed.PROXIMITY_CHARS,
    units: Sequence[str] = fixed.PRICE_UNITS,
) -> DataFrame:
    """Price and item mentions of one text that start within `proximity` characters.

    Numbers are read where they are found, once, and not once per use in the plan.
    """
    prices, items = tuple(units), tuple(aliases)
    shape = [("price_pos", pa.int32()), ("item_pos", pa.int32()), ("price", pa.float64()), ("amount", pa.float64()), ("alias", pa.string())]

    def read(texts: pa.Array) -> Iterator[tuple]:
        for i, t in enumerate(texts):
            for price_pos, price_raw, unit, item_pos, item_raw, item in found_pairs(t.as_py(), prices, items, proximity):
                price, amount = number_of(price_raw), number_of(item_raw)
                if price and amount and price > 0 and amount > 0:
                    yield i, price_pos, item_pos, price * 1000.0 if unit == "k" else price, amount, item.strip(" ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _generated(batch, list(read(batch.column(1))), shape)

    return _lowered(df, key, text).mapInArrow(
        run, f"`{key}` {df.schema[key].dataType.simpleString()}, price_pos int, item_pos int, price double, amount double, alias string")


def rate_hits(pairs: DataFrame, bands: DataFrame) -> DataFrame:
    """Pairs whose rate reaches the suspicious or scam bound of their currency."""
    ratio = F.col("amount") / (F.col("price") / 1000.0)
    judged = pairs.join(bands, "alias").withColumn("ratio", ratio)
    severity = (
        F.when((F.col("scam_high") > 0) & (F.col("ratio") >= F.col("scam_high")), "scam")
        .when((F.col("suspicious_high") > 0) & (F.col("ratio") >= F.col("suspicious_high")), "suspicious"))
    return judged.withColumn("severity", severity).filter("severity is not null").withColumns({
        "risk": F.when(F.col("severity") == "scam", fixed.RATE_RISK["scam"]).otherwise(fixed.RATE_RISK["suspicious"]),
        "over_safe": F.try_divide("ratio", "safe_max"),
    })


def rate_verdict(hits: DataFrame, key: str) -> DataFrame:
    """Per text: risk, hit counts and the worst hit of the top severity (first on ties)."""
    worst = F.max_by(
        F.struct("currency", "ratio", "over_safe", "severity"),
        F.struct("risk", F.coalesce("over_safe", F.lit(0.0)), -F.col("price_pos"), -F.col("item_pos")))
    return hits.groupBy(key).agg(
        F.max("risk").alias("rate_risk"), F.count(F.lit(1)).alias("rate_hits"), worst.alias("top")
    ).select(key, "rate_risk", "rate_hits", F.col("top.currency").alias("top_currency"),
             F.col("top.ratio").alias("top_ratio"), F.col("top.over_safe").alias("top_over_safe"),
             F.col("top.severity").alias("top_severity"))


def with_rate_risk(
    df: DataFrame, key: str, text: str, aliases: Sequence[str], bands=fixed.RATE_BANDS, proximity: int = fixed.PROXIMITY_CHARS,
    units: Sequence[str] = fixed.PRICE_UNITS,
) -> DataFrame:
    """`df` with rate_risk and top_severity of all texts of its key, as `rate_verdict` has them; null where no rate reaches a bound.

    Each text is judged where it stands and goes to its key once; pairs and hits are no rows of their own.
    """
    prices, items = tuple(units), tuple(aliases)
    limits: dict[str, list[tuple[float, float]]] = {}
    for _, names, _, _, suspicious, scam in bands:
        for alias in names:
            limits.setdefault(alias.lower(), []).append((suspicious, scam))
    grades = ("suspicious", "scam")

    def grade(found: str) -> int:
        worst, numbers = 0, {}
        for _, price_raw, unit, _, item_raw, item in found_pairs(found, prices, items, proximity):
            for raw in (price_raw, item_raw):
                if raw not in numbers:
                    numbers[raw] = number_of(raw) or 0.0
            price, amount = numbers[price_raw], numbers[item_raw]
            thousands = (price * 1000.0 if unit == "k" else price) / 1000.0
            if thousands > 0 and amount > 0:
                ratio = amount / thousands
                for suspicious, scam in limits.get(item.strip(" "), ()):
                    # A ratio that is no number is above every bound, as in the plan.
                    if scam and scam > 0 and not ratio < scam:
                        return 2
                    if suspicious and suspicious > 0 and not ratio < suspicious:
                        worst = 1
        return worst

    @arrow_udf("int")
    def graded(texts: pa.Array) -> pa.Array:
        return pa.array([grade(t) for t in texts.to_pylist()], pa.int32())

    own = df.withColumn("_grade", graded(F.lower(F.coalesce(F.col(text), F.lit("")))))
    top = F.when(F.col(key).isNotNull(), F.max("_grade").over(Window.partitionBy(key)))

    def of_grade(values: Sequence) -> Column:
        return F.when(F.col("_top") == 2, values[1]).when(F.col("_top") == 1, values[0])

    return own.withColumn("_top", top).withColumns({
        "rate_risk": of_grade([fixed.RATE_RISK[g] for g in grades]), "top_severity": of_grade(grades)}).drop("_grade", "_top")


def exchange_ratio(text: Column, patterns: Sequence[str]) -> Column:
    """Largest hi/lo over all number pairs that the two-group patterns capture; null without one."""
    ratios = []
    for p in patterns:
        a = F.regexp_extract_all(text, F.lit(uni(p)), 1)
        b = F.regexp_extract_all(text, F.lit(uni(p)), 2)
        pairs = F.zip_with(a, b, lambda x, y: F.try_divide(
            F.greatest(x.cast("double"), y.cast("double")), F.least(x.cast("double"), y.cast("double"))))
        # Most texts hold none: they are read once.
        ratios.append(F.when(text.rlike(uni(p)), pairs).otherwise(F.array().cast("array<double>")))
    return F.array_max(F.concat(*ratios))


# ---- offer texts derived from sales lines, so rate work can run over the base tables ---------

def _whole(value: str) -> Column:
    x = F.col(value)
    return (x >= 1) & (x < 1e15) & (x == F.floor(x))


def _no_digits(value: Column) -> Column:
    """`format_string("%.0f", value)`; a value that is not near a half is its nearest whole number, which costs less."""
    near = F.rint(value)
    return F.when((near >= 1) & (near < 1e15) & (F.abs(value - near) < 0.49), near.cast("long").cast("string")).otherwise(
        F.format_string("%.0f", value))


def written_amounts(lines: DataFrame) -> DataFrame:
    """Each sales line with one of its amounts written in one of six separator styles."""
    grouped = F.format_number("l_extendedprice", 2)
    whole = F.format_number(F.floor("l_extendedprice"), 0)
    style = F.col("l_orderkey") % 6
    swapped = F.translate(grouped, ",.", ".,")
    quantity = F.when(_whole("l_quantity"), F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(".0"))).otherwise(
        F.format_string("%.1f", "l_quantity"))
    raw = (
        F.when(style == 0, grouped).when(style == 1, swapped).when(style == 2, F.translate(whole, ",", "."))
        .when(style == 3, whole).when(style == 4, F.translate(quantity, ".", ",")).otherwise(quantity))
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                        "l_discount", raw.alias("raw"))


def offer_texts(lines: DataFrame, aliases: Sequence[str]) -> DataFrame:
    """One short offer text per sales line, with two prices and two amounts."""
    names = F.array(*[F.lit(a) for a in aliases])

    def pick(col):
        return F.get(names, (F.col(col) % len(aliases)).cast("int"))

    text = F.concat(
        F.lit("Nạp "), F.col("raw"), F.lit(" VND nhận "), _no_digits(F.col("l_quantity") * 7), F.lit(" "),
        pick("l_partkey"), F.lit(", thêm "), _no_digits(F.col("l_quantity")), F.lit(" "), pick("l_suppkey"),
        F.repeat(F.lit(" -"), F.col("l_linenumber") * 8), F.lit(" chỉ "),
        _no_digits(F.col("l_discount") * 100 + 1), F.lit("k"))
    return written_amounts(lines).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("offer_id"),
        "l_orderkey", "l_linenumber", "l_partkey", text.alias("text"))
