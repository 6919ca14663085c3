"""The plans that matter at scale: pruned scans, no products, no Python where expressions do."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", "a1_visual_edges_component a3_consumer_report a7_uncovered_ranges a25_ledger_fold g1_descendants g5_lift_container g15_impact g20_forest_counts j4_incident j5_snapshot_diff j6_last_match j7_longest_prefix j8_longest_suffix j9_innermost_span j13_clone_pairs w1_rank_in_parent u5_patch_sets r2_debounce".split())
def test_no_products_and_no_python(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas", text), text[:2000]


@pytest.mark.parametrize(
    ("name", "table", "columns"),
    [
        ("f3_strip_excerpts", "documents", {"doc_id", "lang", "source", "n_chars"}),
        ("a6_coverage", "lineitem", {"l_orderkey", "l_linenumber", "l_discount"}),
        ("a8_external_systems", "lineitem", {"l_suppkey", "l_orderkey"}),
        ("w6_latest_row", "events", {"event_id", "ts", "user_id", "event_type"}),
    ],
)
def test_scans_read_what_they_need(spark, name, table, columns):
    text = plan(entry.queries()[name](spark, SF))
    read = [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<([^>]*)>", text)]
    assert columns in read, read


def test_filters_reach_the_scan(spark):
    text = plan(entry.queries()["k10_batches"](spark, SF)) + plan(entry.queries()["j18_alias_canonical"](spark, SF)) + plan(entry.queries()["a12_latest_failure"](spark, SF))
    assert "EqualTo(p_brand,Brand#11)" in text and "EqualTo(event_type,error)" in text


def test_ranks_are_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["w4_degree_sample"](spark, SF))


def test_top_k_is_one_operator(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["k1_top_k"](spark, SF))
