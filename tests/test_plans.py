"""What the physical plans must and must not contain."""

import re

import pytest

from claimtrace.queries import QUERIES, streams

SMALL = "/root/testdata/sf0.01"

TOP_K = ["risk_score", "worklist_topk", "case_upsert", "bm25_topk", "vector_topk", "hybrid_topk", "collapse_duplicates"]
PYTHON = {"vector_topk", "vector_topk_lsh", "vector_ivf_recall", "hybrid_topk"}
BATCH = sorted(set(QUERIES) - set(streams.QUERIES))


@pytest.fixture(scope="module")
def plans(spark):
    return {name: _plan(QUERIES[name](spark, SMALL)) for name in BATCH}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_join_without_a_key(plans, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plans[name])


@pytest.mark.parametrize("name", BATCH)
def test_python_runs_only_for_vectors(plans, name):
    found = re.search("EvalPython|MapInArrow|MapInPandas|FlatMap|PythonUDF", plans[name])
    assert bool(found) == (name in PYTHON)


@pytest.mark.parametrize("name", BATCH)
def test_sessions_are_not_merged_in_batch(plans, name):
    assert "MergingSessions" not in plans[name]


@pytest.mark.parametrize("name", TOP_K)
def test_top_k_is_cut_before_the_shuffle(plans, name):
    assert re.search(r"WindowGroupLimit.*Partial", plans[name])


@pytest.mark.parametrize("name", BATCH)
def test_windows_are_partitioned(plans, name):
    """No window gathers all rows in one task."""
    assert not re.search(r"windowspecdefinition\([^,()]* (ASC|DESC)", plans[name])


def test_scans_read_only_what_is_needed(plans):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plans["frequency_limit"]).group(1)
    columns = {field.split(":")[0] for field in schema.split(",")}
    assert columns <= {"l_partkey", "l_suppkey", "l_quantity", "l_shipdate"} and "l_extendedprice" not in columns


def test_filters_reach_the_scan(plans):
    assert "EqualTo(event_type,error)" in plans["fifo_allocate"]
    assert "EqualTo(event_type,purchase)" in plans["fifo_allocate"]


def test_one_shuffle_of_lines_for_the_robust_zscore(plans):
    """Median and MAD are computed in the partitions the lines were sent to once."""
    assert plans["peer_robust_zscore"].count("Exchange hashpartitioning") == 1


def test_one_shuffle_of_events_for_cases(plans):
    assert plans["build_cases"].count("Exchange hashpartitioning") == 1
    assert plans["case_summary"].count("Exchange hashpartitioning") == 1


def test_rates_are_not_broadcast(plans):
    """A row per part and year, six times what Spark takes them for; integrity_flow prices its lines by the same step."""
    assert "SortMergeJoin" in plans["rate_variance"] and "Broadcast" not in plans["rate_variance"]
