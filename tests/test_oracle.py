"""Every named query against its SQL, on the given tables."""

import pytest

from claimtrace.queries import ORACLES, QUERIES, anomaly, cases, recovery
from tests.oracle import duck, duck_rows, spark_rows

SMALL, TINY = "/root/testdata/sf0.01", "/root/testdata/sf0.001"

# queries whose plan differs for very large groups
SPLIT = [
    "high_cost_lines",
    "peer_zscore",
    "peer_robust_zscore",
    "peer_iqr_outliers",
    "rolling_baseline",
    "rate_variance",
    "repeat_lines",
    "provider_peer_rank",
    "build_cases",
    "state_intervals",
    "case_state_asof",
    "case_backlog_daily",
    "case_summary",
    "integrity_flow",
    "recovery_ledger",
    "fifo_allocate",
    "outstanding_aging",
]


@pytest.fixture(scope="module")
def small():
    return duck(SMALL)


@pytest.fixture(scope="module")
def tiny():
    return duck(TINY)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, small, name):
    df = QUERIES[name](spark, SMALL)
    rows = spark_rows(df)
    assert rows
    if name in ORACLES:
        columns, expected = duck_rows(small, ORACLES[name])
        assert sorted(df.columns) == columns
        assert rows == expected


@pytest.mark.parametrize("name", SPLIT)
def test_same_rows_when_groups_are_split(spark, tiny, split, name):
    assert spark_rows(QUERIES[name](spark, TINY)) == duck_rows(tiny, ORACLES[name])[1]


def test_only_approximate_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"high_cost_lines_approx", "vector_topk_lsh"}


def test_families_do_not_share_names():
    families = [anomaly.QUERIES, cases.QUERIES, recovery.QUERIES]
    assert sum(map(len, families)) == len(set().union(*families))
