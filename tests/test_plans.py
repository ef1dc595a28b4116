"""Shapes of the physical plans."""

from __future__ import annotations

import re

import pytest

from govspark.suite import QUERIES

PYTHON_QUERIES = {
    "chunk_recursive", "chunk_cover", "chunk_stats", "chunk_stats_by_source", "filter_chunk_tokens", "embed_chunks", "vector_topk", "vector_topk_filtered", "vector_topk_batch", "rerank_flagged", "retrieval_confidence",
    "chunk_overlap", "embed_chunk_vectors", "vector_lsh", "search_documents", "answer_inputs", "pick_collection", "merge_collections", "filter_min_score", "extract_sources", "pack_context", "context_gate",
}
RUNS_JOBS_FIRST = {
    "quota_stream", "quota_stateful", "incremental_load", "envelope_stream", "growing_load", "growing_rejected", "history_stream", "recall_stream",
}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - RUNS_JOBS_FIRST))
def test_no_cross_join_and_no_stray_python(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name not in PYTHON_QUERIES:
        assert not re.search(r"EvalPython|MapInPandas|MapInArrow|FlatMapGroups", text)


@pytest.mark.parametrize("name", ["topk_with_total", "g_amounts", "g_text_search", "v_all_by_date", "v_top_voters", "v_over_power", "g_by_network", "grouped_topk_with_total"])
def test_top_k_moves_no_full_table(name, spark, sf_dir):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "TakeOrderedAndProject" in text and "Window" not in text


def test_report_keys_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["v_recent"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[.*In\(o_orderkey", text)


def test_month_filter_reaches_the_scan(spark, sf_dir):
    text = plan(QUERIES["filter_month"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate.*LessThan\(o_orderdate", text)
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>", text)


def test_partition_filter_prunes(spark, sf_dir):
    text = plan(QUERIES["partition_pruned_scan"](spark, sf_dir))
    assert re.search(r"PartitionFilters: \[.*status.*proposal_type", text)


def test_history_limits_before_the_shuffle(spark, sf_dir):
    text = plan(QUERIES["history_window"](spark, sf_dir))
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_new_keys_are_broadcast_to_the_target_scan(spark, sf_dir):
    text = plan(QUERIES["new_records_small_batch"](spark, sf_dir))
    assert re.search(r"BroadcastHashJoin .*LeftSemi", text)
