"""The registered queries beside their SQL, and the pipeline beside a brute-force version."""

import collections
import re

import duckdb
import pytest

import corpus_pipeline
from riskloom.llm import catalog, quality
from riskloom.sources.tables import SCHEMAS
from tests.llm.test_operators import ASCII_LOWER, _components, _refilled, _windows_hit
from tools.oracle_check import compare, table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.sql_texts()))
def test_same_result_as_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, FOLDER)
    cur = duck.execute(catalog.sql_texts()[name])
    problem = compare(name, table(frame.columns, frame.collect()), table([d[0] for d in cur.description], cur.fetchall()))
    assert problem is None, problem


def test_account_numbers_are_those_of_the_sql(spark, tmp_path):
    numbers = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "NO9386011117947", "XX89370400440532013000"]
    texts = [f"{lead}{n}{after}" for n in numbers for lead in ("", "my iban ", "x", "AB12 ", "é") for after in ("", " Bank", " BIC COBADEFF", " The end", " 7 I paid", "9", "x", " " + numbers[0])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    frame = catalog.queries()["op4_personal_data"](spark, str(tmp_path))
    rows = frame.collect()
    assert sum("iban" in r.spans for r in rows) > 100
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(catalog.sql_texts()["op4_personal_data"])
    problem = compare("op4_personal_data", table(frame.columns, rows), table([d[0] for d in cur.description], cur.fetchall()))
    assert problem is None, problem


def test_language_accuracy_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = [r for r in catalog.queries()["op2_language"](spark, FOLDER).collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in rows) >= 0.9 * len(rows)


def test_queries_cover_every_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in catalog.queries()) == list(range(1, 14))


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    kept = {r.doc_id for r in quality.measure(docs).where("kept").collect()}
    kept = {k for k, (_, c) in _components({k: texts[k] for k in kept}).items() if k == c}
    kept = {k for k in kept if not ((x := _windows_hit(texts[k], items))[1] and 20 * x[1] >= x[0])}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(out) <= kept
    assert not any(re.search(r"[a-z0-9]@[a-z0-9]+\.[a-z]", r.text.translate(ASCII_LOWER)) for r in out.values())
    sizes = collections.Counter()
    clean = corpus_pipeline.personal_data(spark, docs, FOLDER)
    for r in clean.collect():
        if r.doc_id in kept:
            sizes[source[r.doc_id]] += len(re.findall("[^\x20\x09-\x0D]+", r.text))
    target, taken = _refilled(dict(sizes)), collections.Counter()
    for r in out.values():
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
