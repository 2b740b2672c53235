"""Queries beside their SQL twins on rows that the smallest tables do not hold."""

import duckdb
import pytest

from riskloom.functions import text as tx
from riskloom.plans.registry import runners, sql_texts
from riskloom.sources.tables import SCHEMAS
from tests.test_texts import one
from tools.oracle_check import compare, table


def differs(spark, folder, name, tables):
    con = duckdb.connect()
    for which, rows in tables.items():
        path = f"{folder}/{which}.parquet"
        spark.createDataFrame(rows, SCHEMAS[which]).coalesce(1).write.parquet(path)
        con.execute(f"create view {which} as select * from '{path}/*.parquet'")
    frame = runners()[name](spark, str(folder))
    cur = con.execute(sql_texts()[name])
    return compare(name, table(frame.columns, frame.collect()), table([d[0] for d in cur.description], cur.fetchall()))


def pages(*titles):
    return {"pages": [(i, f"https://a{i % 2}.example.net/?page={i}", f"<title>{t}</title><p>{t} and words enough to be read</p>") for i, t in enumerate(titles)]}


def documents(*texts):
    return {"documents": [(i, t, "en", "src1", len(t)) for i, t in enumerate(texts)]}


CUT = ("the of&amp;&amp;&amp", "a &lt;b&gt; &quot", "plain", "&copy; &middot; &amp;")
GARBLED = ("Than*** edeser$$$ haoner$$$ oreshe$$$ thndtion&amp;&amp;&amp", "y$$$ de$$$ la$$$ en$$$ ciii$$$")


def test_clean_page_text_keeps_a_cut_reference(spark, tmp_path):
    assert differs(spark, tmp_path, "clean_page_text", pages(*CUT)) is None


def test_references_by_a_browsers_rule_or_closed_ones_only(spark):
    text = "a&amp;&amp b &notit; &#65; &#66 &unknown; &"
    assert one(spark, text, tx.clean_text) == "a&& b ¬it; A B &unknown; &"
    assert one(spark, text, lambda c: tx.clean_text(c, closed=True)) == "a&&amp b &notit; A &#66 &unknown; &"


def test_slang_that_an_expansion_completes(spark, tmp_path):
    texts = ("on, that that thing enonor", "that that thing that thing", "The the² the\nTHE", "que_ que, que", "nothing")
    assert differs(spark, tmp_path, "slang_expanded", documents(*texts)) is None


def test_page_text_keeps_a_cut_reference(spark, tmp_path):
    assert differs(spark, tmp_path, "page_text", pages(*CUT)) is None


def test_page_parts_keeps_a_cut_reference_and_odd_titles(spark, tmp_path):
    assert differs(spark, tmp_path, "page_parts", pages(*CUT, *GARBLED)) is None


@pytest.mark.parametrize("name", ["rule_detector", "rule_detector_from_table", "rule_detector_with_trusted_source"])
def test_detector_code_before_an_accented_letter(spark, tmp_path, name):
    texts = ("zu undß der this", "zu und der this", "zu undx der this", "zu und_ der this", "der undö this from with")
    assert differs(spark, tmp_path, name, documents(*texts)) is None
