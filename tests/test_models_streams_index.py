"""Batched models, keyed streams, the metric index, long pattern lexicons, page parts, keyed tables, ranks and mentions."""

import datetime
import os
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.operators import models, noise, pattern_lexicon, rates, reports, similarity, ttl, vector_index
from riskloom.plans import catalog_verdicts, detector
from riskloom.plans.registry import runners
from riskloom.sources import files, pages
from riskloom.sources.keyed_table import KeyedTable
from riskloom.streaming import jobs, stateful

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


# --- batched model ------------------------------------------------------------------------------------------------------

def test_failing_texts_stay_as_rows_and_the_model_loads_once_a_task(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        with open(log, "a") as f:
            f.write("x")

        def model(texts: pa.Array) -> np.ndarray:
            if any("bad" in t.as_py() for t in texts):
                raise ValueError("cannot read")
            p = np.array([0.9 if "scam" in t.as_py() else 0.3 for t in texts])
            return np.column_stack([1 - p, p])
        return model

    rows = spark.createDataFrame([(i, "bad" if i % 50 == 7 else "scam" if i % 3 == 0 else "fine") for i in range(400)] + [(400, None)], "id long, text string").coalesce(1)
    got = {r.id: r for r in models.score_batches(rows, ["id"], "text", load, ["SAFE", "SCAM"], "SAFE", size=16).collect()}
    assert open(log).read() == "x" and len(got) == 401
    for i in range(400):
        r = got[i]
        if i % 50 == 7:
            assert (r.prediction, r.confidence, r.probabilities, r.is_safe, r.requires_review, r.status, r.error) == ("ERROR", 0.0, None, False, True, "error", "ValueError: cannot read")
        elif i % 3 == 0:
            assert (r.prediction, r.confidence, r.requires_review, r.status, r.error) == ("SCAM", 0.9, False, "ok", None)
        else:
            assert (r.prediction, r.is_safe, r.requires_review) == ("SAFE", True, False) and abs(r.probabilities["SAFE"] - 0.7) < 1e-9
    assert got[400].error == "no text"


def test_measures_of_tasks_and_of_columns_agree(spark):
    texts = ["", "ABC!! é||", "worthless idiot", "日本語 A!", "x" * 50]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    patterns = ["[A-Z]", "!", "[|]", "worthless|idiot"]
    model = models.Discriminant(["a"], patterns, np.zeros((1, 5)), np.zeros(1))
    rows = frame.orderBy("id").select(*[c.alias(f"x{i}") for i, c in enumerate(models.Discriminant.columns("text", patterns))]).collect()
    assert np.allclose(model.measure(pa.array(texts)), np.array([list(r) for r in rows]))


# --- keyed streams ------------------------------------------------------------------------------------------------------

def _one_by_one(spark, folder, parts, schema):
    """One file a part, read by the stream in this order."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        for name in os.listdir(folder):
            if name.endswith(".parquet") and not hasattr(_one_by_one, folder + name):
                setattr(_one_by_one, folder + name, True)
                os.utime(f"{folder}/{name}", (1_700_000_000 + 10 * n,) * 2)


SCHEMA = "event_id long, ts timestamp, user_id long"


def _state(spark, checkpoint, name):
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()


def test_ttl_marks_of_files_in_reverse_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, START + datetime.timedelta(seconds=rng.randrange(36_000)), rng.choice([1, 2, 3])) for i in range(300)]
    rows.sort(key=lambda r: r[1])
    parts = [rows[a:a + 60] for a in range(0, 300, 60)][::-1]
    folder = f"{tmp_path}/events"
    _one_by_one(spark, folder, parts, SCHEMA)

    def build(events):
        return stateful.ttl_marks(events, "user_id", "ts", "event_id", 1800, "11 hours")

    out, checkpoint = jobs.settled_output(spark, folder, SCHEMA, build, "user_id", "ts", datetime.timedelta(hours=24), "ttl-test", files_per_batch=1)
    got = {r.id: (r.is_miss, r.is_late) for r in out.collect()}
    batch = ttl.ttl_dedup(spark.createDataFrame(rows, SCHEMA), "user_id", "ts", "event_id", 1800)
    assert got == {r.event_id: (r.is_miss, False) for r in batch.collect()}
    assert _state(spark, checkpoint, "held").count() == 0 and _state(spark, checkpoint, "until").count() == 0


def test_late_requests_are_listed(spark, tmp_path):
    folder = f"{tmp_path}/events"
    day = datetime.timedelta(days=1)
    parts = [[(1, START + 9 * day, 1), (2, START + 9 * day, 2)], [(3, START + 9 * day + datetime.timedelta(seconds=5), 1)], [(4, START, 1)]]
    _one_by_one(spark, folder, parts, SCHEMA)

    def build(events):
        return stateful.ttl_marks(events, "user_id", "ts", "event_id", 60, "1 day")

    out, _ = jobs.settled_output(spark, folder, SCHEMA, build, "user_id", "ts", 3 * day, "ttl-late", files_per_batch=1)
    assert {(r.id, r.is_miss, r.is_late) for r in out.collect()} == {(1, True, False), (2, True, False), (3, False, False), (4, None, True)}


def test_alerts_with_bounded_state_and_late_rows(spark, tmp_path):
    """90 days, 2 days of lateness: rows in time give the batch answer, late ones are listed, old hours leave the state."""
    rng = random.Random(9)
    hour = datetime.timedelta(hours=1)
    parts, late, n = [], [], 0
    for day in range(0, 90, 6):
        rows = []
        for _ in range(40):
            back = rng.choice([0, 0, 0, 30])
            rows.append((n, START + day * 24 * hour + rng.randrange(24) * hour - back * hour, rng.choice([1, 2])))
            n += 1
        if day == 60:
            late = [(n, START + 5 * hour, 1), (n + 1, START + 6 * hour, 1)]
            rows, n = rows + late, n + 2
        parts.append(rows)
    folder = f"{tmp_path}/events"
    _one_by_one(spark, folder, parts, SCHEMA)

    def build(events):
        return stateful.sliding_counts(events, "user_id", "ts", "event_id", 3, "2 days")

    out, checkpoint = jobs.settled_output(spark, folder, SCHEMA, build, "user_id", "ts", datetime.timedelta(days=4), "alerts-test", "update", files_per_batch=1)
    alerts, missed = jobs.sliding_alerts(out, "user_id")
    every = [r for p in parts for r in p]

    def batch(rows):
        counts = {}
        for _, at, user in rows:
            end = datetime.datetime.fromtimestamp(at.timestamp() // 3600 * 3600, datetime.timezone.utc)
            for h in range(1, 25):
                counts[user, int((end + h * hour).timestamp())] = counts.get((user, int((end + h * hour).timestamp())), 0) + 1
        return {(u, e, c) for (u, e), c in counts.items() if c >= 3}

    def told(frame):
        return {(r.user_id, r.e, r.n) for r in frame.select("user_id", F.unix_seconds("window_end").alias("e"), "n").collect()}

    assert {r.id for r in missed.collect()} == {r[0] for r in late}
    assert told(alerts) == batch([r for r in every if r not in late])
    fixed = jobs.corrected_alerts(alerts, missed, spark.createDataFrame(every, SCHEMA), "user_id", "ts", 3)
    assert told(fixed) == batch(every)
    assert _state(spark, checkpoint, "count").count() == 0


def test_observed_counters_are_the_running_counts(spark, tmp_path):
    folder = f"{tmp_path}/in"
    parts = [[(i + 10 * n, START, i % 3) for i in range(4 + n)] for n in range(3)]
    _one_by_one(spark, folder, parts, SCHEMA)
    counters = {"rows": F.count(F.lit(1)), "zeros": F.count_if(F.col("user_id") == 0)}
    out, told = jobs.observed_counters(jobs.stream_table(spark, folder, SCHEMA, 1), counters, "observed-test")
    per_batch = {r.batch_id: (r.n, r.z) for r in out.groupBy("batch_id").agg(F.count("*").alias("n"), F.count_if(F.col("user_id") == 0).alias("z")).collect()}
    rows = sorted(told.collect())
    assert {r.batch_id: (r.rows, r.zeros) for r in rows} == per_batch and len(rows) == 3
    assert (rows[-1].running_rows, rows[-1].running_zeros) == (15, sum(z for _, z in per_batch.values()))


# --- metric index -------------------------------------------------------------------------------------------------------

def _cosines(a, b):
    return np.round(vector_index.unit_rows(a) @ vector_index.unit_rows(b).T, 6) + 0.0


def test_index_spares_pairs_of_blocks_and_loses_nothing(spark):
    rng = np.random.default_rng(6)
    middles = rng.standard_normal((30, 16))
    rows = [(i, (middles[i % 30] + 0.03 * rng.standard_normal(16)).tolist()) for i in range(2400)]
    rows += [(5000 + i, rows[0][1]) for i in range(200)] + [(6000, [0.0] * 16)]
    frame = spark.createDataFrame(rows, "id long, vector array<double>")
    ids, sims = np.array([r[0] for r in rows]), _cosines([r[1] for r in rows], [r[1] for r in rows])
    found, pairs = vector_index.k_nearest(frame, frame, 3, None, True, 50)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((-r.similarity, r.vec_id))
    for k, i in enumerate(ids):
        order = [j for j in np.lexsort((ids, -sims[k])) if ids[j] != i][:3]
        assert sorted(got[i]) == [(-sims[k, j], ids[j]) for j in order]
    assert pairs.compared < 0.3 * pairs.possible
    apart = frame.where("id < 5000")
    edges, pairs = vector_index.edges_at_least(apart, 0.95, 50)
    near = {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in zip(*np.nonzero(sims >= 0.95)) if ids[a] != ids[b] and max(ids[a], ids[b]) < 5000}
    assert {(r.query_id, r.vec_id) for r in edges.select("query_id", "vec_id").collect()} == near and pairs.compared < 0.3 * pairs.possible


def test_a_block_travels_once_a_tile(spark):
    rng = np.random.default_rng(8)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((1200, 4)))], "id long, vector array<double>")
    pivots = vector_index.pivots_of(vector_index.sampled(frame), 8)
    laid = vector_index.blocks(frame, pivots, 5)
    n, met = laid.count(), vector_index._met(laid, laid, len(pivots), one_way=False)
    # 240 blocks and more: pair by pair each would travel as often as there are blocks.
    assert n >= 240 and met.count() <= 2 * vector_index.TILES * n
    assert met.select("a", "b").distinct().count() <= vector_index.TILES ** 2


def test_threshold_of_two_tables_in_blocks(spark):
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((60, 4)), rng.standard_normal((70, 4))
    left = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "id long, vector array<double>")
    right = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "id long, vector array<double>")
    got = {(r.query_id, r.vec_id) for r in similarity.neighbours(left, right, k=0, floor=0.8, block=16).collect()}
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(_cosines(a, b) >= 0.8))}
    assert similarity.neighbours(left, right.where("false"), k=2, block=16).count() == 0


# --- pattern lexicon ----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("pattern, literals", [
    (r"token\s*=", ["token"]), (r"(?:free|cheap) robux", [" robux"]), (r"\bpay(?:ment)?s? now\b", [" now"]), (r"[0-9]{16}", []), (r"a|bcdef", []),
    (r"(abcd|efghij)", ["abcd", "efghij"]), (r"x(?:secret)+y", ["secret"]), (r"x(?:secret)*y", []), (r"\p{L}+word", ["word"]), (r"(?i)OFFER", ["offer"]), (r"((", [])])
def test_required_literals(pattern, literals):
    assert pattern_lexicon.required_literals(pattern) == literals


def test_ten_thousand_patterns(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 7))) for _ in range(3000)]
    shapes = [lambda a, b: rf"\b{a}\s+{b}", lambda a, b: rf"{a}(?:s|ed)?\s+{b}", lambda a, b: rf"(?:{a}|{b}) [0-9]+", lambda a, b: rf"{a}.{{0,3}}{b}$"]
    lexicon = [(f"c{i % 5}", rng.choice(shapes)(rng.choice(words), rng.choice(words))) for i in range(9990)]
    lexicon += [("open", "[0-9]{4}"), ("open", "^.?$"), ("open", "é|ü"), ("twice", "abc"), ("twice", "abc"), ("empty", ""), ("both", "(?:long|[0-9])")]
    docs = []
    for i in range(80):
        text = " ".join(rng.choices(words, k=rng.randint(0, 60)))
        a, b = rng.choice(words), rng.choice(words)
        docs.append((i, rng.choice([text, text.upper(), f"{text} {a} 4711", f"{a}s {b}", "", "abc é"])))
    docs.append((80, None))
    got = sorted(tuple(r) for r in pattern_lexicon.regex_matches(
        spark.createDataFrame(docs, "id long, text string"), "id", "text", spark.createDataFrame(lexicon, "category string, pattern string"), folded=2, block=4000).collect())
    tests = [(c, p, re.compile(p)) for c, p in lexicon if p]
    assert got == sorted((i, c, p) for i, t in docs for c, p, x in tests if x.search((t or "").lower()))


FAR = pattern_lexicon.UNBOUND


@pytest.mark.parametrize("pattern, near", [
    (r"las?\s+(?:the\s+|[a-z]{2}\s+)?de", (["la"], ["de"], 4, 1, 0, -1, -1)), (r"token\s*=", (["token"], ["="], 0, FAR, FAR, -1, -1)),
    (r"(?:free|cheap) robux[0-9]{0,2}", (["cheap", "free"], [" robux"], 0, FAR, FAR, -1, 2)), (r"\p{L}{1,4}\sword[a-z]?", (["word"], [], 0, FAR, FAR, 4, 1)),
    (r"ab(?:x\s+yy|z \w){1,2}c?dd", (["ab"], ["dd"], 7, 1, 3, -1, -1)), (r"\bpay day", None), (r"ab.*cd", None), (r"ab++cd", None), (r"a[b[c]]def", None),
    (r"(?i)offer now", None), (r"[0-9]{16}", None), (r"(abc)x\1", None), (r"ab\vcd", None), (r"ab.{0,5000}cd", None)])
def test_near_literals(pattern, near):
    assert pattern_lexicon.near_literals(pattern) == near


def test_texts_are_matched_only_where_literals_are_near():
    import pyarrow as pa

    near = pattern_lexicon.near_literals(r"alphas?\s+(?:the\s+)?beta")
    words = "alpha gamma delta beta " * 10_000
    texts = [words, words + "alphas  the\nbeta " + words, "alpha", "beta"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], ["id", "low"])
    got = [row for own in pattern_lexicon._candidates([(7, near)], [])(iter([batch])) for row in own.to_pylist()]
    assert got == [{"id": 1, "texts": ["alphas  the\nbeta"], "numbers": [7]}]


def test_bounded_patterns_match_as_every_pattern_on_every_text(spark):
    rng = random.Random(11)
    words = ["a", "b", "ab", "ba", "abc", "é", "cab", "x=", "the"]
    parts = [r"s?", r"\s+", r"\s*", r"[a-c]{0,2}", r"(?:the\s+|[a-z]{2}\s+)?", r"(?: x|\sab ?)", r".?", r"\S{1,3}", " ", r"(?:a\s?){1,2}", r"[^b]", r"(ab|cab|é)", r"\p{L}", r"\b", r"[ \t]+?"]
    lexicon = sorted({"".join(rng.choice(words) if i % 2 == 0 or rng.random() < 0.2 else rng.choice(parts) for i in range(rng.randint(1, 6))) for _ in range(500)}
                     | {rng.choice(parts) + rng.choice(words) + rng.choice(parts) for _ in range(60)} - {""})
    lexicon += lexicon[:9]
    whites = [" ", " ", "  ", "\n", "\t ", "", "\x0b", "\x1c", " ", " " * 300]
    docs = [(i, "".join(rng.choice([*words, "s", "cc"]) + rng.choice(whites) for _ in range(rng.randint(0, 25)))) for i in range(120)]
    texts, table = spark.createDataFrame(docs, "id long, text string").repartition(3), spark.createDataFrame([("c", p) for p in lexicon], "category string, pattern string")
    found = sorted(tuple(r) for r in pattern_lexicon.regex_matches(texts, "id", "text", table).collect())
    assert sum(pattern_lexicon.near_literals(p) is not None for p in lexicon) > 200
    assert found == sorted(tuple(r) for r in texts.crossJoin(table).where(F.regexp(F.lower("text"), F.col("pattern"))).select("id", "category", "pattern").collect())


# --- pages --------------------------------------------------------------------------------------------------------------

def test_page_parts(spark):
    html = """<html><head><title>A &amp; B</title><meta property="og:title" content="Social &lt;one&gt;"><meta content="twice" property="og:title">
      <meta content="http://x/y.png" name="twitter:image"><script>var a = "<div data-ad-preview>no</div>"</script></head>
      <body><div><div data-ad-preview="m">Buy <div>now <div data-ad-preview>inner</div> or</div> never</div> after</div><style>p {}</style>
      <noscript>hidden</noscript></div></div><p>tail</p><div data-ad-preview>open <b>end"""
    got = pages.page_parts(spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "plain <text"), (5, "<![bad[ x")], "id int, html string"), "html", ["id"])
    rows = {r.id: r for r in got.collect()}
    assert rows[1].title == "A & B" and rows[1].metas == {"og:title": "Social <one>", "twitter:image": "http://x/y.png"}
    assert rows[1].previews == ["Buy now inner or never", "inner", "open end"]
    assert rows[1].visible == "A & B Buy now inner or never after tail open end"
    assert rows[2].title is None and rows[2].previews == [] and rows[2].visible == "" and rows[4].visible.startswith("plain")
    texts = {r.id: r for r in pages.with_text(got, F.col("id") == 1).select("id", "page_text", pages.image_link().alias("image")).collect()}
    assert texts[1].page_text == "A & B Social <one> Buy now inner or never inner open end" and texts[1].image == "http://x/y.png"
    assert texts[2].page_text == "" and texts[4].page_text.startswith("plain")


def test_open_divs_cost_no_more_than_their_number():
    start = time.time()
    page = pages.parse("<div>" * 100_000 + "<div data-ad-preview>x" + "</div>" * 50_000 + "</p>" * 100_000)
    assert page.previews == [(0, "x")] and time.time() - start < 20


# --- files and tables ---------------------------------------------------------------------------------------------------

def test_json_arrays_with_optional_and_broken_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, text string").repartition(4)
    files.write_json_arrays(rows, f"{tmp_path}/a")
    files.write_json_arrays(rows.where("id < 0"), f"{tmp_path}/none")
    (tmp_path / "b.json").write_text('[{"id": 100, "text": "b"}, {"id": 101}]')
    (tmp_path / "broken.json").write_text('[{"id": 7, ')
    got, broken = files.read_json_arrays(spark, [f"{tmp_path}/a", f"{tmp_path}/none", f"{tmp_path}/b.json"], "id long, text string", [f"{tmp_path}/absent", f"{tmp_path}/broken.json"])
    assert sorted((r.id, r.text) for r in got.collect()) == sorted([(i, f"t{i}") for i in range(50)] + [(100, "b"), (101, None)], key=lambda r: r[0])
    assert [r.source.rsplit("/", 1)[-1] for r in broken.collect()] == ["broken.json"]


def test_an_upsert_rewrites_only_its_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id long, at int, v string", ["id"], ["at"], buckets=32)
    assert table.read().count() == 0
    rows = {i: (i, 1, "old") for i in range(2000)}
    table.upsert(spark.createDataFrame(list(rows.values()), "id long, at int, v string"))
    before = table.folders()
    times = {f: os.stat(f"{tmp_path}/t/{f}").st_mtime_ns for f in before.values()}
    changes = [(i, 2, "new") for i in range(0, 20, 4)] + [(3, 0, "stale"), (4, 3, "newest"), (9999, 1, "added"), (8, 5, "gone")]
    table.upsert(spark.createDataFrame(changes, "id long, at int, v string"), gone=F.col("v") == "gone")
    rows |= {i: (i, 2, "new") for i in range(0, 20, 4)} | {4: (4, 3, "newest"), 9999: (9999, 1, "added")}
    del rows[8]
    assert sorted(tuple(r) for r in table.read().collect()) == sorted(rows.values())
    after = table.folders()
    same = [b for b in before if before[b] == after.get(b)]
    assert len(same) >= 32 - 8 and {f: os.stat(f"{tmp_path}/t/{f}").st_mtime_ns for f in before.values()} == times
    assert table.read(0).where("v <> 'old'").count() == 0
    assert [tuple(r) for r in table.lookup(spark.createDataFrame([(4,), (77777,)], "id long")).collect()] == [(4, 3, "newest")]
    with pytest.raises(RuntimeError):
        late = KeyedTable(spark, str(tmp_path / "t"), "id long, at int, v string", ["id"], ["at"], buckets=32)
        late._latest = lambda: 0
        late.upsert(spark.createDataFrame([(1, 9, "x")], "id long, at int, v string"))


# --- ranks --------------------------------------------------------------------------------------------------------------

def test_ranks_without_windows(spark):
    rng = random.Random(8)
    rows = [("one", 4.0)] * 500 + [("two", rng.choice([1.0, 2.0])) for _ in range(5001)]
    rows += [("wide", rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300)) for _ in range(4000)] + [("wide", v) for v in (1.7e308, -1.7e308, 0.0, 5e-324)]
    rows += [("inf", v) for v in (float("inf"), float("-inf"), 1.0, 2.0, float("inf"))]
    frame = spark.createDataFrame(rows, "k string, v double")
    wanted = [(k, r) for k in ("one", "two", "wide", "inf") for r in (0, 1, 2, 4)] + [("two", 2500), ("wide", 2001), ("wide", 4003)]
    got = reports.values_at_ranks(frame, "k", "v", spark.createDataFrame(wanted, "k string, r long"))
    ordered = {k: sorted(v for kk, v in rows if kk == k) for k in ("one", "two", "wide", "inf")}
    assert {(r.k, r.r): r.value for r in got.collect()} == {(k, r): ordered[k][r] for k, r in wanted}
    assert "Window" not in got._jdf.queryExecution().toString()


# --- mentions -----------------------------------------------------------------------------------------------------------

def test_pairs_by_a_moving_window_are_all_pairs_nearby():
    rng = random.Random(2)
    for _ in range(200):
        text = " ".join(rng.choice(["12 vnd", "1.000k", "7 robux", "x" * rng.randint(1, 40), "3,5 kc", "9 vnds"]) for _ in range(rng.randint(0, 25)))
        every = list(rates.found_mentions(text, ("vnd", "k", "robux", "kc")))
        prices, items = [m for m in every if m[2] in ("vnd", "k")], [m for m in every if m[2] in ("robux", "kc")]
        assert list(rates.found_pairs(text, ("vnd", "k"), ("robux", "kc"), 60)) == [(*p, *i) for p in prices for i in items if abs(p[0] - i[0]) <= 60]


def test_two_hundred_thousand_mentions_in_one_text(spark):
    text = "12 vnd 7 robux " * 100_000
    frame = spark.createDataFrame([(1, text)], "id long, text string")
    start = time.time()
    assert rates.mention_rows(frame, "id", "text", ("vnd", "robux")).count() == 200_000
    assert rates.rate_pairs(frame, "id", "text", ["robux"], proximity=8, units=("vnd",)).count() == 199_999
    assert time.time() - start < 60


def test_mentions_by_lateral(spark):
    name = rates.register_mentions(spark, ("vnd",))
    spark.createDataFrame([(1, "5 vnd và 1.000 vnd"), (2, "none"), (3, None)], "id long, text string").createOrReplaceTempView("offers_to_read")
    got = spark.sql(f"select id, pos, raw from offers_to_read, lateral {name}(text)").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "5"), (1, 9, "1.000")]


# --- rules and noise ----------------------------------------------------------------------------------------------------

def test_rules_survive_their_table(spark):
    rows = detector.rule_rows(catalog_verdicts.RULES)
    back = detector.load_rules(spark.createDataFrame(rows, detector.RULE_SCHEMA))
    for section, value in vars(catalog_verdicts.RULES).items():
        loaded = getattr(back, section)
        assert (dict(loaded) if isinstance(value, dict) else loaded if isinstance(value, str) else list(loaded)) == (value if isinstance(value, (dict, str)) else list(value)), section


def test_noise_report_holds_the_shares_of_the_flags(spark):
    folder = "/root/testdata/sf0.001"
    flags = runners()["noise_all_kinds"](spark, folder).collect()
    report = {(r.section, r.key): r.value for r in runners()["noise_report"](spark, folder).collect()}
    for kind, chance in noise.STEP_PROBABILITY.items():
        share = 100 * sum(r[f"noise_{kind}"] for r in flags) / len(flags)
        assert report["share_pct", kind] == pytest.approx(share) and share <= 100 * chance + 15
    assert any(v > 0 for (s, _), v in report.items() if s == "share_pct")
    assert report["mean", "perturbation_score"] == pytest.approx(sum(r.perturbation_score for r in flags) / len(flags))
