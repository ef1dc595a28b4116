"""Wall time of the headline queries: one JSON line on standard output.

BENCH_SF_DIR (tables, default sf0.1), BENCH_CPUS (local cores, default 8), BENCH_RUNS (warm runs, default 2),
BENCH_QUERIES (comma-separated names; "all" for every query).
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from govspark.session import local_session
from govspark.suite import QUERIES

HEADLINE = """
v_top_voters v_recent v_over_power v_on_proposal v_month_examples v_distinct_month
g_recent g_by_network g_text_search g_month_examples g_network_compare g_active_proposers g_amounts
join_left_power new_records new_records_small_batch grouped_topk_with_total union_merge_schema
profile_columns profile_columns_approx null_profile structure_profile column_overlap document_stats
coerce_types composite_key source_tracking proposal_link format_amount adjusted_balance
flatten_wide flatten_long scan_json_envelope scan_votes parse_text_header combine_by_group
chunk_recursive chunk_fixed paragraphs section_sample embed_chunks keyword_search trim_to_budget
vector_topk vector_topk_filtered vector_topk_batch rerank_flagged pack_context extract_sources
history_transcript memory_recall quota_batch quota_windows
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = local_session(cores, checkpoint_dir=tempfile.mkdtemp(prefix="bench-"))
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        measured = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            measured.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(measured[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total median warm seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1],
        "cores": cores,
    }))


if __name__ == "__main__":
    main()
