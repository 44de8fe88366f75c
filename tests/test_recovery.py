from collections import defaultdict
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from claimtrace.operators import recovery
from tests.frames import cents, entries, ordered, tuples

MONEY = st.integers(0, 5_000).map(lambda c: Decimal(c) / 100)
SIDE = st.lists(st.tuples(st.integers(1, 3), MONEY), max_size=12)


def _side(spark, rows, first_id):
    return entries(spark, [(p, first_id + i, f"2024-01-{i % 9 + 1:02d}T00:00", a) for i, (p, a) in enumerate(rows)])


def _brute_force(owed, paid):
    """Allocations by walking through both sides with two pointers."""
    found, sides = [], []
    for rows in (owed, paid):
        by_party = defaultdict(list)
        for party, entry_id, ts, amount in sorted(rows, key=lambda r: (r[2], r[1])):
            by_party[party].append([entry_id, amount])
        sides.append(by_party)
    for party, debts in sides[0].items():
        credits = [list(c) for c in sides[1].get(party, [])]
        debts = [list(d) for d in debts]
        while debts and credits:
            part = min(debts[0][1], credits[0][1])
            if part:
                found.append((party, debts[0][0], credits[0][0], part))
            for side in (debts, credits):
                side[0][1] -= part
            debts, credits = ([e for e in side if e[1]] for side in (debts, credits))
    return ordered(found)


@pytest.mark.parametrize("large_groups", [False, True])
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(owed=SIDE, paid=SIDE)
def test_fifo_allocation(spark, request, large_groups, owed, paid):
    if large_groups:
        request.getfixturevalue("split")
    left, right = _side(spark, owed, 1), _side(spark, paid, 100)
    found = recovery.fifo_allocate(left, right)
    rows = tuples(found, "party", "obligation_id", "recovery_id", "amount")
    assert rows == _brute_force([tuple(r) for r in left.collect()], [tuple(r) for r in right.collect()])
    for party in (1, 2, 3):
        total = sum((r[3] for r in rows if r[0] == party), Decimal(0))
        assert total == min(sum(a for p, a in owed if p == party), sum(a for p, a in paid if p == party))


def test_negative_amounts_stop_the_allocation(spark):
    owed = entries(spark, [(1, 7, "2024-01-01T00:00", -1)])
    with pytest.raises(SparkRuntimeException, match="negative amount in entry 7"):
        recovery.fifo_allocate(owed, owed).collect()


def test_closing_balance(spark):
    owed = entries(spark, [(1, 1, "2024-01-01T00:00", 10), (1, 2, "2024-01-03T00:00", 5)])
    paid = entries(spark, [(1, 3, "2024-01-02T00:00", 12), (2, 4, "2024-01-02T00:00", 1)])
    ledger = recovery.recovery_ledger(owed, paid)
    assert tuples(ledger, "entry_id", "kind", "balance") == [
        (1, "obligation", cents(10)),
        (2, "obligation", cents(3)),
        (3, "recovery", cents(-2)),
        (4, "recovery", cents(-1)),
    ]


def test_overpayments_ignore_underpayments(spark):
    rows = spark.createDataFrame([(1, cents(5)), (1, cents(-3)), (2, cents(-1)), (3, None)], "p int, variance decimal(18,2)")
    assert tuples(recovery.overpayments(rows, ["p"]), "p", "overpaid", "n_lines") == [(1, cents(5), 1)]


def test_aging_buckets(spark):
    owed = entries(spark, [(1, 1, "2024-01-01T00:00", 10), (1, 2, "2024-01-24T00:00", 6), (2, 3, "2024-01-23T23:00", 4),
                           (3, 4, "2024-01-30T00:00", 9)])
    paid = entries(spark, [(1, 9, "2024-01-30T00:00", 3), (3, 8, "2024-01-30T00:00", 9)])
    aged = recovery.outstanding_aging(owed, paid, "2024-01-31", [7, 14])
    assert tuples(aged, "bucket", "n_open", "unpaid") == [
        ("0-7", 1, cents(6)),
        ("15+", 1, cents(7)),
        ("8-14", 1, cents(4)),
    ]


def test_reconcile_statuses(spark):
    owed = entries(spark, [(p, p, "2024-01-01T00:00", 5) for p in (1, 2, 3, 4)])
    paid = entries(spark, [(p, p, "2024-01-01T00:00", a) for p, a in ((2, 5), (3, 4), (4, 6), (5, 1))])
    assert tuples(recovery.reconcile(owed, paid), "party", "status") == [
        (1, "unmatched_obligation"),
        (2, "settled"),
        (3, "short"),
        (4, "over_recovered"),
        (5, "unmatched_recovery"),
    ]


def test_rollup_tells_subtotals_from_null_keys(spark):
    rows = spark.createDataFrame(
        [("r", None, cents(4), cents(1)), ("r", "n", cents(0), cents(2))],
        "region string, nation string, identified decimal(18,2), recovered decimal(18,2)",
    )
    found = recovery.recovery_rollup(rows, ["region", "nation"])
    assert tuples(found, "region", "nation", "level", "rate") == [
        (None, None, 3, 0.75),
        ("r", None, 0, 0.25),
        ("r", None, 1, 0.75),
        ("r", "n", 0, None),
    ]
    assert recovery.recovery_rollup(rows, ["region", "nation"], cube=True).count() == 6


def test_early_recoveries_count_in_step_0(spark):
    owed = entries(spark, [(1, 1, "2024-01-10T00:00", 10), (1, 2, "2024-02-10T00:00", 10)])
    paid = entries(spark, [(1, 3, "2024-01-12T00:00", 4), (1, 4, "2024-01-20T00:00", 8)])
    found = recovery.recovery_vintage(recovery.fifo_allocate(owed, paid), owed, "month")
    assert tuples(found, F.month("cohort").alias("m"), "step", "recovered", "share") == [
        (1, 0, cents(10), 1.0),
        (2, 0, cents(2), 0.2),
    ]


def test_funnel_counts_recoveries_after_a_demand(spark):
    rows = spark.createDataFrame(
        [(1, 1, "d"), (1, 2, "r"), (2, 1, "r"), (2, 2, "d"), (3, 1, "x")], "case_id int, ts int, state string"
    ).withColumn("team", F.lit("t"))
    found = recovery.recovery_funnel(rows, ["case_id"], ["team"], "d", "r")
    assert tuples(found, "identified", "demanded", "recovered", "recovery_rate") == [(3, 2, 1, 0.5)]


def test_trend_fills_gaps(spark):
    paid = entries(spark, [(1, 1, "2024-01-01T05:00", 3), (1, 2, "2024-01-03T05:00", 5)])
    found = recovery.recovery_trend(paid, "day", ["party"]).orderBy("period_start")
    assert [(r.total, r.change) for r in found.collect()] == [
        (cents(3), None),
        (cents(0), cents(-3)),
        (cents(5), cents(5)),
    ]


def test_ledger_diff(spark):
    prev = spark.createDataFrame([(1, 5, None), (2, 6, "x"), (3, 7, "x")], "k int, amount int, note string")
    curr = spark.createDataFrame([(1, 5, None), (2, 6, None), (4, 1, "x")], "k int, amount int, note string")
    found = recovery.ledger_diff(prev, curr, ["k"])
    assert tuples(found, "k", "status", "prev_note", "curr_note") == [
        (2, "changed", "x", None),
        (3, "removed", "x", None),
        (4, "added", None, "x"),
    ]
