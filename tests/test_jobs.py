import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import graph, metrics, noise, ordered, reports, similarity, ttl
from riskloom.plans import detector, guards


def test_quantiles_match_numpy(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([rng.random(), 0.5, rng.gauss(0, 100)])) for k in "ab" for _ in range(3000)] + [("c", 4.0)]
    rows += [(f"s{n}", rng.random()) for n in range(2, 220, 9) for _ in range(n)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = (0.0, 0.25, 0.5, 0.9, 1.0)
    got = {(r["k"], r["p"]): r["q"] for r in reports.exact_quantiles(df, "k", "v", probs).collect()}
    for k in {r[0] for r in rows}:
        values = [v for kk, v in rows if kk == k]
        for p in probs:
            assert got[(k, p)] == pytest.approx(np.quantile(values, p))


def test_positions_and_running_totals(spark):
    rows = [(i % 3, i * 7 % 100, i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t int, id int")
    got = {(r["k"], r["id"]): r["position"] for r in ordered.with_position(df, ["k"], F.floor(F.col("t") / 10), [F.col("t"), F.col("id")]).collect()}
    sums = {(r["k"], r["id"]): r["s"] for r in ordered.running_total(
        df, ["k"], F.floor(F.col("t") / 10), [F.col("t"), F.col("id")], {"s": F.col("t")}).collect()}
    for k in range(3):
        total = 0
        for n, (t, i) in enumerate(sorted((t, i) for kk, t, i in rows if kk == k), 1):
            total += t
            assert got[(k, i)] == n and sums[(k, i)] == total


@pytest.mark.parametrize("chunk", [100, 1000, 10_000])
def test_ttl_chain_is_the_same_for_every_chunk(spark, chunk):
    rng = random.Random(chunk)
    rows = [(i, rng.choice("ab"), rng.randrange(0, 20_000)) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["is_miss"] for r in ttl.ttl_dedup(df, "k", "ts", "id", 300, chunk).collect()}
    for k in "ab":
        busy = None
        for s, i in sorted((s, i) for i, kk, s in rows if kk == k):
            miss = busy is None or s > busy
            busy = s + 300 if miss else busy
            assert got[i] == miss


def test_metrics_absent_labels_and_empty(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("C", "A")], "e string, p string")
    rows = {r["label"]: r for r in metrics.class_metrics(df, "e", "p", ["A", "B", "C"]).collect()}
    assert rows["A"]["precision"] == 0.5 and rows["B"]["support"] == 0 and rows["C"]["recall"] == 0
    assert metrics.accuracy_summary(df.limit(0), "e", "p", ["A", "B"]).first()["accuracy"] == 0


def test_calibration_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.1, 1.0), (0.10001, 0.0), (1.0, 1.0)], "p double, y double")
    assert sorted((r["bin"], r["n"]) for r in metrics.calibration_bins(df, "y", "p").collect()) == [(1, 1), (2, 1), (10, 1)]


def small_graph(spark):
    rows = [(1, 2), (2, 3), (1, 3), (10, 11), (11, 12), (3, 4), (4, 5), (5, 6)]
    return spark.createDataFrame(rows, "src long, dst long").withColumn("weight", F.lit(1.0))


def test_rank_sums_to_one_and_hub_parts_change_nothing(spark):
    edges = small_graph(spark)
    whole = {r["id"]: r["score"] for r in graph.page_rank(edges, iterations=10).collect()}
    parts = {r["id"]: r["score"] for r in graph.page_rank(edges, iterations=10, hub_edges=1, every=3).collect()}
    assert sum(whole.values()) == pytest.approx(1.0)
    assert whole == pytest.approx(parts)


def test_ranks_leave_the_arcs_in_their_cells(spark, monkeypatch):
    plans, write = [], graph.written

    def kept(df, label):
        if label == "ranks":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(graph, "written", kept)
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = {name: spark.conf.get(name) for name in names}
    try:
        spark.conf.set(names[0], "-1")
        spark.conf.set(names[1], "7")
        graph.page_rank(small_graph(spark), iterations=1).collect()
        assert spark.conf.get(names[1]) == "7"
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    exchanged = [line for line in plans[0].split("\n") if "Exchange hashpartitioning" in line]
    # Ranks go to their cells and sums come back to their nodes.
    assert sorted(line.split("(")[1].split("#")[0] for line in exchanged) == ["cell", "dst"]


def test_components_are_named_by_their_smallest_node(spark):
    got = {r["id"]: r["component"] for r in graph.components(small_graph(spark)).collect()}
    assert got == {**dict.fromkeys(range(1, 7), 1), 10: 10, 11: 10, 12: 10}


def test_components_of_many_edges_come_from_a_sample(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(rng.randrange(0, 300), rng.randrange(300, 400)) for _ in range(6000)] + [(rng.randrange(1000, 1100), 1200) for _ in range(3000)]
    rows += [(i, i + 1) for i in range(2000, 2060)] + [(2060, 399), (3000, 3001), (3001, 3000), (4000, 4000), (5, 5), (9, 9)] + [(5000, i) for i in range(5001, 5400)]
    low = {i: i for row in rows for i in row}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in rows:
        a, b = sorted((top(a), top(b)))
        low[b] = a
    stars, write = [], graph.written

    def kept(df, label):
        out = write(df, label)
        if label == "stars":
            stars.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", kept)
    edges = spark.createDataFrame(rows, "src long, dst long").repartition(3)
    for sampled in (graph.SAMPLED_EDGES, 0.4):
        got = [tuple(r) for r in graph.components(edges, sampled=sampled).select("id", "component").collect()]
        assert sorted(got) == sorted((i, top(i)) for i in low)
        # 6,018 different edges of 965 nodes: the rounds run on a sample of them.
        assert sampled != graph.SAMPLED_EDGES or max(stars) < 2500
    assert graph.components(edges.where("src < 0")).count() == 0


def test_communities_find_the_cliques(spark):
    def clique(ids):
        return [(a, b) for a in ids for b in ids if a < b]

    rows = clique([1, 2, 3, 4]) + clique([5, 6, 7, 8]) + [(4, 5)]
    df = spark.createDataFrame(rows, "src long, dst long").withColumn("weight", F.lit(1.0))
    got = {r["id"]: r["community"] for r in graph.communities(df).collect()}
    again = {r["id"]: r["community"] for r in graph.communities(df.repartition(3), hub_edges=2).collect()}
    assert got == again
    assert len({got[i] for i in (1, 2, 3, 4)}) == 1 and len({got[i] for i in (5, 6, 7, 8)}) == 1 and got[1] != got[5]


def test_hops_and_deletion(spark):
    edges = small_graph(spark)
    start = spark.createDataFrame([(1,)], "id long")
    assert {r["id"]: r["depth"] for r in graph.k_hop(edges, start, 2).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    nodes = spark.createDataFrame([(i, "USER") for i in (1, 2, 3, 4, 5, 6, 10, 11, 12)], "id long, node_type string")
    left, kept = graph.delete_nodes(nodes, edges, spark.createDataFrame([(3,)], "id long"))
    assert left.count() == 8 and kept.count() == 5


def test_neighbour_blocks_equal_broadcast(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")

    def run(block):
        return sorted(tuple(r) for r in similarity.neighbours(df, df, 4, skip_self=True, block=block).collect())

    assert run(4096) == run(7)


def test_copies_become_a_star(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)] + [(9, [0.0, 1.0])], "id long, vector array<double>")
    assert sorted((r["src"], r["dst"]) for r in similarity.similar_edges(df, 0.9).collect()) == [(0, i) for i in range(1, 5)]


def test_similar_to_edges_has_all_pairs_of_copies(spark, tmp_path):
    import duckdb

    from riskloom.plans import registry
    from riskloom.sources.tables import SCHEMAS

    rows = [(i, [1.0, 0.0], 0) for i in range(5)] + [(9, [0.0, 1.0], 1), (10, [0.5, 1.0], 1), (11, [0.5, 1.0], 0)]
    spark.createDataFrame(rows, SCHEMAS["embeddings"]).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    wanted = sorted(con.execute(registry.sql_texts()["similar_to_edges"]).fetchall())
    found = sorted(tuple(r) for r in registry.runners()["similar_to_edges"](spark, str(tmp_path)).select("src", "dst", "similarity").collect())
    assert found == wanted and len(wanted) == 23


def test_noise_is_stable_and_flags_tell_the_truth(spark):
    df = spark.createDataFrame([(i, f"xin chào các bạn, hay lắm nhé số {i}! ok thanks") for i in range(60)], "id long, t string")
    a = {r["id"]: r for r in noise.augment(df, "id", "t").collect()}
    b = {r["id"]: r for r in noise.augment(df.repartition(7), "id", "t").collect()}
    assert a == b
    for r in a.values():
        fired = [k for k in noise.STEP_PROBABILITY if r[f"noise_{k}"]]
        assert r["perturbation_score"] == pytest.approx(len(fired) / 9)
        if r["perturbed_text"] != r["t"]:
            assert fired
    for kind in noise.STEP_PROBABILITY:
        rows = noise.augment(df, "id", "t", 7, [kind], {kind: 1.0}).collect()
        assert all(r[f"noise_{kind}"] == (r["perturbed_text"] != r["t"]) for r in rows)
        assert any(r[f"noise_{kind}"] for r in rows), kind


RULES = detector.DetectorRules(
    signals={"pay_first": ["chuyển.*khoản.*trước"], "takeover": [r"cho\s*mượn\s*acc"]}, items=["robux"], gives=["đưa"], receives=["nhận"],
    questions=["cho hỏi"], rate_talk=[r"bảng\s*giá"])


def verdict(spark, text):
    return detector.detect(spark.createDataFrame([(text,)], "t string"), "t", RULES).first()


def test_detector_verdicts_and_question_guard(spark):
    assert verdict(spark, "hôm nay trời đẹp")["prediction"] == "SAFE"
    assert verdict(spark, "đưa robux nhận gấp đôi")["prediction"] == "FAKE_SCAM"
    asked = verdict(spark, "cho hỏi bảng giá robux này có tin được không?")
    assert "CONTEXT_RATE_QUERY" in asked["flags"] and asked["prediction"] != "FAKE_SCAM"
    paid = verdict(spark, "cho hỏi bảng giá robux, chuyển khoản trước nhé?")
    assert "FINANCIAL_SCAM:pay_first_scheme" in paid["flags"] and paid["prediction"] == "FAKE_SCAM"


def test_rewrite_takes_the_first_alternative(spark):
    df = spark.createDataFrame([("SAFE", "LOW", 0.2, False, ["A"])], "label string, risk_level string, confidence double, needs_review boolean, flags array<string>")
    row = guards.apply_step(df, [
        guards.Rewrite(F.col("label") == "SAFE", "SUSPICIOUS", "MEDIUM", F.greatest("confidence", F.lit(0.5)), True, [(F.lit(True), "A"), (F.lit(True), "B")]),
        guards.Rewrite(F.lit(True), "FAKE_SCAM")]).first()
    assert (row["label"], row["confidence"], row["flags"]) == ("SUSPICIOUS", 0.5, ["A", "B"])


def test_hot_key_keeps_every_row(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(0).alias("k"), F.col("id"))
    assert ordered.latest_per_key(df, ["k"], ["id"]).filter("k = 0").first()["id"] == 19_999
    assert ordered.with_position(df, ["k"], F.floor(F.col("id") / 1000), [F.col("id")]).count() == 20_000


def test_lexicon_rule_is_the_same_at_every_size(spark):
    from riskloom.sources.reference import lexicon_matches

    texts = spark.createDataFrame([(1, "The TOKENS of a rating, two words"), (2, None), (3, ""), (4, "nothing"), (5, "a rating")], "doc_id long, text string")
    own = [("a", "token"), ("b", "two words"), ("b", "ating"), ("c", "rating"), ("d", ""), ("a", "token")]
    padded = own + [("x", f"zz{i}q") for i in range(600)]
    found = []
    for rows, options in ((own, {}), (padded, {}), (padded, {"block": 100})):
        table = spark.createDataFrame(rows, "category string, pattern string")
        found.append(sorted(tuple(r) for r in lexicon_matches(texts, "doc_id", "text", table, **options).collect()))
    assert found[0] == found[1] == found[2]
    assert (1, "b", "two words") in found[0] and (5, "b", "ating") in found[0] and found[0].count((1, "a", "token")) == 2


def test_long_texts_are_searched_slice_by_slice():
    import pyarrow as pa

    from riskloom.sources import reference

    texts = ["ab cd " * 2_000 if i % 3 else "" for i in range(300)] + ["cd " * reference.SLICE_BYTES, "ab", ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "low"])
    cut = list(reference.slices([batch.slice(0, 0), batch], 1))
    assert [t for own in cut for t in own.column(1).to_pylist()] == texts
    assert all(own.num_rows and (own.num_rows == 1 or sum(map(len, own.column(1).to_pylist())) <= reference.SLICE_BYTES) for own in cut)
    found = list(reference._search([("x", "ab"), ("y", "ab"), ("x", "cd")])(iter([batch])))
    assert len(found) == len(cut) and max(own.num_rows for own in found) < 150
    assert sorted(tuple(r.values()) for own in found for r in own.to_pylist()) == sorted(
        (i, c, p) for i, t in enumerate(texts) for c, p in (("x", "ab"), ("y", "ab"), ("x", "cd")) if p in t)


def test_literal_tables_are_joined_without_a_shuffle(spark):
    from riskloom.operators.rates import band_table

    big = spark.range(1000).withColumn("alias", F.col("id").cast("string"))
    plan = big.join(band_table(spark), "alias")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LocalTableScan" in plan and "ExistingRDD" not in plan


def test_communities_beat_components_and_lone_nodes(spark):
    # Two dense groups with one edge between, a pair, and a node with an edge to itself.
    rows = [(i, j, 1.0) for g in (range(0, 8), range(8, 16)) for i in g for j in g if i < j] + [(0, 8, 1.0), (20, 21, 1.0), (30, 30, 1.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    label = {r.id: r.community for r in graph.communities(edges).collect()}
    assert len({label[i] for i in range(8)}) == 1 and len({label[i] for i in range(8, 16)}) == 1 and label[0] != label[8]
    whole = graph.components(edges).withColumnRenamed("component", "community")
    assert {r.id: r.community for r in whole.collect()} == {i: 0 for i in range(16)} | {20: 20, 21: 20, 30: 30}
    value = lambda members: graph.modularity(edges, members).first()[0]
    assert value(graph.communities(edges)) > value(whole)


def test_gain_of_a_merge_is_the_difference_of_modularity(spark):
    rows = [(i, j, 1.0 + (i * j) % 3) for i in range(12) for j in range(i, 12) if (i * 5 + j * 3) % 4 == 0]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    label = {i: i % 4 for i in sorted({x for r in rows for x in r[:2]})}
    frame = lambda members: spark.createDataFrame(list(members.items()), "id long, community long")
    value = lambda members: graph.modularity(edges, frame(members)).first()[0]
    gains = {(r.a, r.b): r.gain for r in graph.merge_gains(edges, frame(label)).collect()}
    assert set(gains) == {tuple(sorted((label[i], label[j]))) for i, j, _ in rows if label[i] != label[j]}
    for (a, b), gain in gains.items():
        assert value({i: a if c == b else c for i, c in label.items()}) - value(label) == pytest.approx(gain)
    assert graph.merge_gains(edges.limit(0), frame(label)).count() == 0


def test_merging_goes_on_until_no_pair_gains(spark):
    rows = [(i, j, 1.0) for g in (range(0, 4), range(4, 8)) for i in g for j in g if i < j] + [(3, 4, 1.0)]
    edges = spark.createDataFrame(rows, "src long, dst long, weight double")
    alone = spark.createDataFrame([(i, i) for i in range(8)], "id long, community long")
    members = graph._merged(graph.both_ways(edges), alone)
    assert members.count() == 8 and graph.merge_gains(edges, members).where(F.col("gain") > graph.TOLERANCE).isEmpty()
    assert graph.modularity(edges, members).first()[0] > graph.modularity(edges, alone).first()[0]


def test_communities_of_an_even_graph_take_few_rounds(spark, monkeypatch):
    # Neighbours drawn at random: single moves alone had not ended after 120 s here.
    rng = np.random.default_rng(0)
    rows = {(int(a), int(b)) for a, b in zip(rng.integers(0, 400, 6000), rng.integers(400, 900, 6000))}
    edges = spark.createDataFrame(sorted(rows), "src long, dst long").withColumn("weight", F.lit(1.0))
    labels, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: labels.append(label) or write(df, label))
    members = write(graph.communities(edges), "members")
    assert members.count() == 900 and graph.merge_gains(edges, members).where(F.col("gain") > graph.TOLERANCE).isEmpty()
    assert labels.count("named") <= 25 and labels.count("moves") <= 40
    assert graph.modularity(edges, members).first()[0] > 0.1


def test_mentions_of_all_kinds_come_from_one_pass(spark):
    from riskloom.operators import rates
    from riskloom.plans import registry

    frame = spark.createDataFrame([(1, "10k 5 kc 3 k"), (2, None), (3, "1.000 VND, 7 uc")], "id long, text string")
    kinds = {"price": ["vnd", "k"], "item": ["kc", "uc"]}
    found = sorted(tuple(r) for r in rates.mention_kinds(frame, "id", "text", kinds).collect())
    apart = sorted((r.id, kind, r.pos, r.raw, r.unit) for kind, units in kinds.items() for r in rates.mention_rows(frame, "id", "text", units).collect())
    assert found == apart and len(found) == 5
    plan = registry.runners()["quantity_mentions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_cells_of_a_ranking_keep_all_cores_at_work(spark, monkeypatch):
    assert [graph.grid_for(n) for n in (6, 8, 12, 16, 97)] == [(3, 4), (4, 4), (3, 4), (4, 4), (9, 10)]
    edges = spark.createDataFrame([(i % 17, (i * i + 1) % 23, 1.0 + i % 3) for i in range(400)] + [(99, 5, 1.0)], "src long, dst long, weight double")
    cells, make = [], graph.bucketed
    monkeypatch.setattr(graph, "bucketed", lambda *a, partitions=None, **k: cells.append(partitions) or make(*a, partitions=partitions, **k))
    wide = {r.id: r.score for r in graph.page_rank(edges, iterations=4, hub_edges=10).collect()}
    assert cells == [12, 12]  # four cores: three full waves
    square = {r.id: r.score for r in graph.page_rank(edges, iterations=4, hub_edges=10, side=4).collect()}
    assert wide.keys() == square.keys() and all(abs(wide[k] - square[k]) < 1e-12 for k in wide)
    assert abs(sum(wide.values()) - 1) < 1e-9


def test_mentions_are_counted_by_key_without_being_shuffled(spark):
    from riskloom.operators import rates
    from riskloom.plans import registry

    rows = [(i % 7, "10k 5 kc 3 k" if i % 3 else f"1.000 VND, {i} uc 10k") for i in range(3_000)] + [(None, "7 kc"), (None, "7 kc"), (8, None)]
    frame = spark.createDataFrame(rows, "id long, text string").repartition(5)
    kinds = {"price": ["vnd", "k"], "item": ["kc", "uc"]}
    found = sorted((tuple(r) for r in rates.mention_counts(frame, "id", "text", kinds).collect()), key=repr)
    counted = rates.mention_kinds(frame, "id", "text", kinds).groupBy("id", "kind", "pos", "raw", "unit").count()
    assert found == sorted((tuple(r) for r in counted.collect()), key=repr) and (None, "item", 0, "7", "kc", 2) in found
    plan = registry.runners()["quantity_mentions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_rate_risk_beside_the_text_equals_the_joined_verdict(spark):
    from riskloom.operators import rates
    from riskloom.plans import registry

    rows = [(1, "10k nhận 900 kc"), (1, "10k nhận 400 kc"), (2, "10k nhận 650 kc"), (2, None), (3, "10k nhận 5 kc"), (4, "0k 5 kc"), (5, ""),
            (6, "1" * 400 + "k " + "2" * 400 + " uc"), (7, "20.000 vnd 1,5 robux 400 rbx"), (8, "10k nhận 999 pets")]
    frame = spark.createDataFrame(rows, "id long, text string").repartition(4)
    names = ["kc", "uc", "robux", "rbx", "pets"]
    mine = rates.with_rate_risk(frame, "id", "text", names)
    hits = rates.rate_hits(rates.rate_pairs(frame, "id", "text", names), rates.band_table(spark))
    joined = frame.join(rates.rate_verdict(hits, "id").select("id", "rate_risk", "top_severity"), "id", "left")
    order = {"key": repr}
    found = sorted((tuple(r) for r in mine.collect()), **order)
    assert found == sorted((tuple(r) for r in joined.collect()), **order) and {r[3] for r in found} == {None, "suspicious", "scam"}
    plan = registry.runners()["rule_detector_with_rates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RLIKE") < 20


def test_means_are_added_in_the_order_of_the_events(spark, tmp_path):
    import datetime

    import duckdb

    from riskloom.plans import registry
    from riskloom.sources.tables import SCHEMAS

    rng, start = random.Random(7), datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    rows = [(i, start + datetime.timedelta(seconds=i), i % 500, ["click", "error"][i % 3 == 0], round(rng.uniform(5, 60), 2), None) for i in range(12_000)]
    for part in range(6):
        spark.createDataFrame(rows[part * 2000:(part + 1) * 2000], SCHEMAS["events"]).coalesce(1).write.parquet(f"{tmp_path}/events.parquet/at={part}")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*/*.parquet', hive_partitioning = false) order by event_id")
    wanted = sorted(con.execute(registry.sql_texts()["top_map_entries"]).fetchall())
    assert sorted(tuple(r) for r in registry.runners()["top_map_entries"](spark, str(tmp_path)).collect()) == wanted and len(wanted) == 500


def test_copies_of_a_vector_are_one_node(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [1.0, 0.0]), (5, [1.0, 0.1]), (6, [0.6, 0.9])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    heads = similarity.head_of(vectors)
    assert {r.id: r["head"] for r in heads.collect()} == {1: 1, 2: 2, 3: 3, 4: 1, 5: 2, 6: 6}
    edges = similarity.head_edges(vectors, heads, 0.8).select("src", "dst")
    assert {tuple(r) for r in edges.collect()} == {(1, 2), (3, 6)}
    seeds = spark.createDataFrame([(4,)], "id long")
    assert {r.id: r.depth for r in graph.propagation_depth(edges, seeds, heads, 3).collect()} == {1: 0, 4: 0, 2: 1, 5: 1}


def test_propagation_stores_no_edges_and_copies_of_seeds_are_one_step_away(spark, tmp_path, monkeypatch):
    import duckdb

    from riskloom.plans import registry
    from riskloom.sources.tables import SCHEMAS

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=12)], 1 if i % 40 == 0 else 0) for i in range(300)]
    rows += [(300 + i, rows[5 * i][1], 0) for i in range(20)] + [(400 + i, [float(x) for x in 3 + rng.normal(size=12)], 2) for i in range(4)]
    spark.createDataFrame(rows, SCHEMAS["embeddings"]).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = registry.sql_texts()["propagation_depth"].replace("0.3)", "0.6)")
    wanted = dict(con.execute(sql).fetchall())
    vectors = spark.createDataFrame(rows, "id long, vector array<float>, label int")
    sizes, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df, label: sizes.append((out := write(df, label)).count()) or out)
    found = {r.id: r.depth for r in graph.similar_depth(vectors.drop("label"), vectors.where("label = 1").select("id"), 0.6, 4, block=64).collect()}
    assert found == wanted and len(set(wanted.values())) > 3 and wanted[300] == 1
    assert max(sizes) <= len(rows)
    wanted = dict(con.execute(registry.sql_texts()["propagation_depth"]).fetchall())
    assert {r.id: r.depth for r in registry.runners()["propagation_depth"](spark, str(tmp_path)).collect()} == wanted


def test_alerts_of_a_backlog_in_reverse_order(spark, tmp_path, monkeypatch):
    import datetime

    from riskloom.plans import registry
    from riskloom.sources.tables import SCHEMAS
    from riskloom.streaming import jobs

    start, folder = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc), f"{tmp_path}/events.parquet"
    for day in (89, 45, 0):
        rows = [(10 * day + i, start + datetime.timedelta(days=day, hours=i), 1, "error", 0.0, None) for i in range(4)]
        spark.createDataFrame(rows, SCHEMAS["events"]).coalesce(1).write.mode("append").parquet(folder)
    read = jobs.stream_table
    monkeypatch.setattr(jobs, "stream_table", lambda spark, path, schema, files_per_batch=1: read(spark, path, schema, 1))
    found = {(r.window_end_us, r.n) for r in registry.runners()["stream_high_risk_alerts"](spark, str(tmp_path)).collect()}
    ends = [start + datetime.timedelta(days=d, hours=h) for d in (89, 45, 0) for h in range(1, 28)]
    counts = {e: sum(e - datetime.timedelta(hours=24) <= start + datetime.timedelta(days=d, hours=i) < e for d in (89, 45, 0) for i in range(4)) for e in ends}
    assert found == {(int(e.timestamp()) * 10**6, n) for e, n in counts.items() if n >= 3}


def test_recent_rows_with_totals_match_running_sums(spark):
    rows = [(k, i, (i * 7 + k) % 5 - 1) for k in range(3) for i in range(k * 6)] + [(None, i, 2) for i in range(4)] + [(9, 0, None), (9, 1, 3)]
    frame = spark.createDataFrame(rows, "k int, id int, v long").repartition(3)
    found = {(r.k, r.id): (r["rank"], r.v) for r in ordered.recent_with_totals(frame, "k", [F.desc("id")], 5, ["v"]).collect()}
    expected = {}
    for key in {k for k, _, _ in rows}:
        mine = sorted((i, v) for k, i, v in rows if k == key)
        for rank, (i, _) in enumerate(reversed(mine[-5:]), 1):
            expected[(key, i)] = (rank, sum(v or 0 for j, v in mine if j <= i))
    assert found == expected
