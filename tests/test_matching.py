"""Recoveries matched entry by entry on a stream, against a plain queue per party."""

import random
from collections import defaultdict, deque
from datetime import timedelta

import pytest

from claimtrace.streaming.matching import stream_entry_match
from claimtrace.streaming.run import ROCKSDB, run_to_table, session_settings
from tests.frames import at, cents, ordered

SCHEMA = "party bigint, entry_id bigint, ts timestamp, signed decimal(18,2)"
END = [(99, 0, at("2024-03-01T00:00"), cents(1))]


def _matched(spark, path, files, expire=None):
    # rows of a last file only move the watermark on
    for i, rows in enumerate([*files, END]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/part{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/part*")
    with session_settings(spark, ROCKSDB):
        found = run_to_table(stream_entry_match(stream, "20 days", expire), "matches").collect()
    return ordered((r.party, r.obligation_id, r.recovery_id, r.amount_cents) for r in found)


def _plain(rows, expire=None):
    queues, out = defaultdict(deque), []
    for party, entry, ts, signed in sorted(rows, key=lambda r: (r[2], r[3] < 0, r[1])):
        queue, amount = queues[party], int(signed * 100)
        while expire and queue and queue[0][0] + expire <= ts:
            queue.popleft()
        if amount > 0:
            queue.append([ts, entry, amount])
        left = -amount
        while left > 0 and queue:
            paid = min(left, queue[0][2])
            out.append((party, queue[0][1], entry, paid))
            left -= paid
            queue[0][2] -= paid
            if not queue[0][2]:
                queue.popleft()
    return ordered(out)


def test_money_that_came_before_the_demand_does_not_match(spark, tmp_path):
    rows = [(1, 1, at("2024-01-01T08:00"), cents(-5)), (1, 2, at("2024-01-01T20:00"), cents(5)), (1, 3, at("2024-01-02T08:00"), cents(-3))]
    # whichever arrives first
    assert _matched(spark, f"{tmp_path}/a", [rows]) == [(1, 2, 3, 300)]
    assert _matched(spark, f"{tmp_path}/b", [rows[1:], rows[:1]]) == [(1, 2, 3, 300)]


@pytest.mark.parametrize("expire", [None, timedelta(days=3)])
def test_matches_of_random_entries(spark, tmp_path, expire):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        party = rng.choice([None, 1, 1, 1, 2, 3])
        day, hour = rng.randint(1, 19), rng.choice([0, 8, 20])
        rows.append((party, i, at(f"2024-01-{day:02d}T{hour:02d}:00"), cents(rng.choice([-7, -3, 2, 4, 5]))))
    files = [rows[i::3] for i in range(3)]
    assert _matched(spark, str(tmp_path), files, expire) == _plain(rows, expire)


def test_rows_that_are_no_entries(spark, tmp_path):
    rows = [(1, 1, at("2024-01-01T08:00"), cents(5)), (1, 2, None, cents(-5)), (1, 3, at("2024-01-01T09:00"), None), (1, 4, at("2024-01-01T10:00"), cents(0))]
    more = [(1, None, at("2024-01-01T11:00"), cents(-2))]
    assert _matched(spark, str(tmp_path), [rows, more]) == [(1, 1, None, 200)]
