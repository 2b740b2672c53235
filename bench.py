"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1). BENCH_CPUS: local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from riskloom.plans.registry import runners  # noqa: E402
from riskloom.session import build_session  # noqa: E402

HEADLINE = (
    "daily_verdict_dashboard", "daily_dashboard_summary", "metrics_view_with_active_users", "median_and_box_statistics",
    "keep_first_text", "recent_ring_with_running_totals", "top_terms", "matching_form", "slang_expanded", "keyword_profile",
    "intent_scores", "drift_profile", "class_precision_recall", "calibration_error", "stratified_split", "rate_anomalies",
    "rule_detector", "lexicon_verdict", "soft_vote_fusion", "guard_cascade", "review_batch", "upsert_by_key", "page_text",
    "cosine_top_k", "interaction_edges", "page_rank", "connected_components", "noise_all_kinds", "stream_ingest", "ttl_dedup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    todo = runners()
    todo["group_count_desc"](spark, folder).collect()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # Every column of every row is computed; nothing is brought to the driver.
        todo[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
