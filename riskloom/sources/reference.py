"""Small reference tables: from a file when given, else from fixed values."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEXICON_SCHEMA = "category string, ordinal int, pattern string, weight double"


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table written out in the plan, so the planner knows its size and joins it without a shuffle.

    Rows given as a Python list would be a scan of unknown size, beside which any large table may look small.
    """
    names = spark.createDataFrame([], schema).columns
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(pa.table({name: [row[i] for row in rows] for i, name in enumerate(names)}), schema)


def lookup_table(spark: SparkSession, pairs: Mapping[str, str], key: str, value: str) -> DataFrame:
    """A literal two-column table."""
    return literal_table(spark, list(pairs.items()), f"{key} string, {value} string")


def load_or_default(spark: SparkSession, path: str | None, schema: str, default: Sequence[tuple]) -> DataFrame:
    """The JSON-lines table at `path`, or the default rows when no path is given or nothing is there."""
    if path:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
            return spark.read.schema(schema).json(path)
    return literal_table(spark, list(default), schema)


def checked_rows(df: DataFrame, limit: int) -> list:
    """Rows of a table that must be small; an error rather than a silent cut when it is not."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"reference table has more than {limit} rows; join it instead of folding it")
    return rows


def load_intents(lexicon: DataFrame, limit: int = 5000) -> list[tuple[str, float, list[str]]]:
    """Intent categories from a lexicon table, in the order of their first pattern."""
    rows = checked_rows(lexicon.orderBy("ordinal"), limit)
    out: dict[str, tuple[str, float, list[str]]] = {}
    for r in rows:
        out.setdefault(r["category"], (r["category"], r["weight"], []))[2].append(r["pattern"])
    return list(out.values())


#: Lexicon entries worked on at once: they are folded into the plan, or travel to the tasks as one automaton.
FOLDED_ENTRIES, BLOCK_ENTRIES = 100, 50_000
#: Bytes of text searched at a time, beyond one whole text.
SLICE_BYTES = 1 << 18


def lexicon_matches(df: DataFrame, key: str, text: str, lexicon: DataFrame, folded: int = FOLDED_ENTRIES, block: int = BLOCK_ENTRIES) -> DataFrame:
    """(key, category, pattern) for each lexicon entry that the lower-cased text contains, whatever the lexicon's size.

    A few entries fold into expressions. More are cut into blocks of a bounded number of entries; the texts are searched
    once a block, for all its entries at a time. Repeated entries give repeated rows; empty patterns never match.
    """
    entries = lexicon.select("category", "pattern").where(F.length("pattern") > 0)
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = entries.take(folded + 1)
    if len(rows) <= folded:
        entry = [F.when(F.contains(low, F.lit(r["pattern"])), F.struct(
            F.lit(r["category"]).alias("category"), F.lit(r["pattern"]).alias("pattern"))) for r in rows]
        found = F.array_compact(F.array(*entry)) if entry else F.array().cast("array<struct<category:string,pattern:string>>")
        return df.select(key, F.explode(found).alias("m")).select(key, "m.*")
    parts = -(-entries.count() // block)
    texts, out = df.select(key, low.alias("low")), None
    schema = f"{key} {texts.schema[0].dataType.simpleString()}, category string, pattern string"
    for i in range(parts):
        words = entries.where(F.pmod(F.xxhash64("category", "pattern"), F.lit(parts)) == i).collect()
        found = texts.mapInArrow(_search([tuple(r) for r in words]), schema)
        out = found if out is None else out.unionByName(found)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most about `most` bytes of text, so that what is found in them stays small."""
    for batch in batches:
        start, held = 0, 0
        for at, size in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            if held and held + size > most:
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += size + 1
        if start < batch.num_rows:
            yield batch.slice(start)


def _search(entries: list[tuple[str, str]]):
    """Task function: (key, low) rows to (key, category, pattern), by one automaton over all patterns."""
    def run(batches):
        import ahocorasick

        automaton, owners = ahocorasick.Automaton(), {}
        for category, pattern in entries:
            owners.setdefault(pattern, []).append(category)
        for pattern in owners:
            automaton.add_word(pattern, pattern)
        automaton.make_automaton()
        for batch in slices(batches, 1):
            hits = [(i, c, p) for i, low in enumerate(batch.column(1).to_pylist()) for p in sorted({p for _, p in automaton.iter(low)}) for c in owners[p]]
            rows, categories, patterns = zip(*hits) if hits else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(categories, pa.string()), pa.array(patterns, pa.string())],
                [batch.schema.names[0], "category", "pattern"])
    return run
