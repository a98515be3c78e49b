"""Seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from folioscope.catalog import all_queries  # noqa: E402
from folioscope.session import local_session  # noqa: E402

# D6_kept_statistics builds and changes the stored index that the three after it read
HEADLINE = [
    "A2_type_gate", "A5_content_hash", "A11_capture_web", "B3_title", "B7_wikilinks", "B11_build_meta", "B22_embed_text",
    "C1_ledger_lookup", "C4_stale_embeddings", "C5_consistency_diff", "C6_link_resolution", "C8_orphan_pages",
    "D1_run_report_counts", "D3_link_index", "E1_apply_limit", "E2_latest_per_key", "E4_slug_winner",
    "F1_search", "F2_phrase_search", "D6_kept_statistics", "F2_phrase_search_indexed", "F1_search_indexed", "F5_similar_by_text_indexed", "F3_short_search", "F4_similar_by_vector",
    "F2_gram_index", "F4_all_nearest", "F5_similar_by_text", "F6_similar", "F7_graph_edges", "J1_plan_ingest", "J2_apply_outcomes", "J4_digest_sources", "J5_classify_responses",
    "J6_check_consistency", "J7_rebuild", "J8_lint", "J9_synthesize", "J10_digest_recent", "J11_index_page",
    "J12_embed_stale", "J13_link_graph", "K1_scheduled_ingest", "K2_settle_recheck", "K3_apply_changes", "K3_moves", "K5_rolling_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    known = all_queries()
    names = sys.argv[1:] or HEADLINE
    # start the workers and load the classes before the clock runs
    known["B7_wikilinks"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        began = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
