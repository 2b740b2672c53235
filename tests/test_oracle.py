"""Each listed query beside its SQL twin on the smallest tables. ALL_QUERIES=1 runs every one."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from riskloom.plans.registry import runners, sql_texts  # noqa: E402
from riskloom.sources.tables import SCHEMAS  # noqa: E402
from tools.oracle_check import compare, table  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
CORE = [
    "daily_verdict_dashboard", "median_and_box_statistics", "histogram_20_bins", "keep_first_text", "recent_ring_with_running_totals",
    "every_third_event", "speaker_turns_joined", "matching_form", "slang_expanded", "mixed_separator_numbers", "confusion_matrix",
    "accuracy_and_f1", "calibration_error", "stratified_split", "intent_scores", "drift_profile", "worst_rate_per_text", "rule_detector",
    "soft_vote_fusion", "guard_cascade", "evidence_merge", "review_batch_status_move", "upsert_by_key", "page_text", "cosine_top_k_blocked",
    "connected_components", "k_hop_neighbourhood", "stream_high_risk_alerts", "ttl_dedup", "stream_ttl_dedup",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(sql_texts()) if os.environ.get("ALL_QUERIES") else CORE)
def test_same_result_as_sql(spark, duck, name):
    frame = runners()[name](spark, FOLDER)
    cur = duck.execute(sql_texts()[name])
    problem = compare(name, table(frame.columns, frame.collect()), table([d[0] for d in cur.description], cur.fetchall()))
    assert problem is None, problem


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
