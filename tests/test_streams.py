"""Streams give the batch answer for closed windows, whatever order the rows arrive in."""

import random
import time
from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from claimtrace.operators import cases as batch
from claimtrace.sources import SCHEMAS, as_case_events, obligations, recoveries, stream_events, table
from claimtrace.streaming import alerts, cases, recovery
from claimtrace.streaming.run import ROCKSDB, run_to_table, session_settings
from tests.frames import at, tuples
from tests.oracle import spark_rows

TINY = "/root/testdata/sf0.001"


def _write(spark, path, files):
    """One file per list of rows (event_id, ts, user_id, type, value), each its own micro-batch."""
    for i, rows in enumerate(files):
        data = [(e, at(ts), u, kind, float(v), None) for e, ts, u, kind, v in rows]
        frame = spark.createDataFrame(data, SCHEMAS["events"]).coalesce(1)
        frame.write.parquet(f"{path}/part{i}")
    return path


def _stream(spark, path):
    """Files in the order they were written, one per micro-batch."""
    return stream_events(spark, f"{path}/part*", files_per_trigger=1).drop("props")


@pytest.fixture
def shuffled(spark, tmp_path):
    """The events of three days, within a day in random order, as one file per half day."""
    rows = table(spark, TINY, "events").orderBy("ts").collect()
    files, rnd = [], random.Random(1)
    for start in range(0, len(rows), 100):
        part = [tuple(r) for r in rows[start : start + 100]]
        rnd.shuffle(part)
        files.append(part)
    for i, part in enumerate(files):
        spark.createDataFrame(part, SCHEMAS["events"]).coalesce(1).write.parquet(f"{tmp_path}/part{i}")
    return str(tmp_path)


def _batch_events(spark, path):
    rows = as_case_events(spark.read.schema(SCHEMAS["events"]).parquet(f"{path}/part*"))
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def test_cases_equal_batch_cases(spark, shuffled):
    streamed = run_to_table(cases.stream_build_cases(_stream(spark, shuffled), "6 hours", "30 days"), "cases")
    assert streamed.count() == 0
    streamed = run_to_table(cases.stream_build_cases(_stream(spark, shuffled), "6 hours", "4 days"), "cases")
    events = _batch_events(spark, shuffled)
    built = batch.build_cases(events, "case_id", "ts", "6 hours", "amount", ["event_id"]).drop("case_no")
    closed = events.agg((F.max("ts") - F.expr("interval 4 days")).alias("at")).first().at
    rows = spark_rows(streamed)
    assert rows and rows == spark_rows(built.where(F.col("case_end") <= F.lit(closed)))


def test_windows_equal_batch_windows(spark, shuffled):
    events = _batch_events(spark, shuffled)
    closed = events.agg((F.max("ts") - F.expr("interval 4 days")).alias("at")).first().at
    for slide in (None, "12 hours"):
        streamed = run_to_table(
            cases.stream_event_counts(_stream(spark, shuffled), ["state"], "1 day", "4 days", slide), "counts"
        )
        counted = (
            events.groupBy("state", F.window("ts", "1 day", slide).alias("w"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))
            .select("state", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "amount")
            .where(F.col("window_end") <= F.lit(closed))
        )
        rows = spark_rows(streamed)
        assert rows and rows == spark_rows(counted)


ON_TIME = [
    [(1, "2024-01-01T01:00", 1, "a", 1)],
    [(2, "2024-01-05T01:00", 1, "a", 1)],
    [(3, "2024-01-10T01:00", 1, "a", 1)],
]
LATE = [(4, "2024-01-01T02:00", 1, "a", 1)]


def _counts(spark, path):
    counts = cases.stream_event_counts(_stream(spark, path), ["state"], "1 day", "1 hour")
    return tuples(run_to_table(counts, "counts").select(F.dayofmonth("window_start").alias("day"), "n"), "day", "n")


def test_late_rows_are_left_out(spark, tmp_path):
    """The limit for late rows is that of the batch before, so two on-time batches come first."""
    path = _write(spark, str(tmp_path), [*ON_TIME, LATE, [(5, "2024-01-20T00:00", 1, "a", 1)]])
    assert _counts(spark, path) == [(1, 1), (5, 1), (10, 1)]


def test_rows_within_the_delay_are_kept(spark, tmp_path):
    files = [ON_TIME[0], [(2, "2024-01-02T00:30", 1, "a", 1)], [(3, "2024-01-01T23:40", 1, "a", 1)],
             [(5, "2024-01-20T00:00", 1, "a", 1)]]
    assert _counts(spark, _write(spark, str(tmp_path), files)) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("salts", [1, 3])
def test_redelivered_events_are_dropped(spark, tmp_path, salts):
    files = [ON_TIME[0] * 3, [*ON_TIME[0], *ON_TIME[1]], ON_TIME[1]]
    stream = _stream(spark, _write(spark, str(tmp_path), files))
    found = run_to_table(cases.stream_dedup(stream, ["event_id"], "10 days", salts), "unique")
    assert tuples(found, "event_id") == [(1,), (2,)]


@pytest.mark.parametrize("salts", [1, 4])
def test_alerts(spark, tmp_path, salts):
    files = [[(1, "2024-01-01T00:00", 1, "a", 30), (2, "2024-01-01T00:00", 1, "a", 12)],
             [(3, "2024-01-01T00:00", 2, "a", 1), (4, "2024-01-01T00:00", 3, "a", 99)]]
    baseline = spark.createDataFrame([(1, 10.0, 5.0), (2, 10.0, 0.0)], "case_id bigint, mean double, dev double")
    stream = _stream(spark, _write(spark, str(tmp_path), files))
    found = run_to_table(alerts.stream_alerts(stream, baseline, ["case_id"], "amount", 2.0, salts), "alerts")
    assert tuples(found, "event_id", "zscore") == [(1, 4.0)]


def test_case_state_and_stale_cases(spark, tmp_path):
    files = [
        [(1, "2024-01-01T00:00", 1, "open", 1), (2, "2024-01-01T01:00", 2, "open", 2)],
        [(4, "2024-01-01T02:00", 1, "paid", 3), (3, "2024-01-01T01:30", 1, "asked", 4)],
        [(5, "2024-01-02T02:30", 2, "asked", 5)],
    ]
    path = _write(spark, str(tmp_path), files)
    with session_settings(spark, ROCKSDB):
        log = run_to_table(cases.stream_case_state(_stream(spark, path), "1 hour", timedelta(hours=20)), "log")
    assert tuples(log, "case_id", "state", "n_events", "amount_cents", "stale") == [
        (1, "open", 1, 100, False),
        (1, "paid", 3, 800, False),
        (1, "paid", 3, 800, True),
        # its next event comes before the watermark reaches the timer of the first
        (2, "asked", 2, 700, False),
        (2, "open", 1, 200, False),
    ]


def _daily_pairs(events, days):
    def daily(rows, name):
        return rows.groupBy("party", F.to_date("ts").alias(f"{name}_day")).agg(
            F.sum("amount").alias(name), F.count(F.lit(1)).alias(f"n_{name}")
        )

    joined = daily(obligations(events), "demanded").join(daily(recoveries(events), "recovered"), "party")
    gap = F.datediff("recovered_day", "demanded_day")
    return joined.where((gap >= 0) & (gap <= days))


def test_recovery_match_equals_batch(spark, shuffled):
    def side(pick):
        return pick(_stream(spark, shuffled))

    matched = run_to_table(
        recovery.stream_recovery_match(side(obligations), side(recoveries), 2, "4 days"), "matched"
    )
    days = matched.withColumns({c: F.to_date(c) for c in ("demanded_day", "recovered_day")})
    events = _batch_events(spark, shuffled)
    ends = [pick(events).agg(F.max("ts")).first()[0] for pick in (obligations, recoveries)]
    closed = F.lit(min(ends)) - F.expr("interval 4 days")
    expected = _daily_pairs(events, 2).where(F.col("recovered_day") + F.expr("interval 1 day") <= closed)
    rows = spark_rows(days)
    assert rows and rows == spark_rows(expected.select(*days.columns))


def test_case_state_goes_on_from_a_batch_and_can_be_read_back(spark, tmp_path):
    schema = SCHEMAS["events"]
    old = [(1, at("2024-01-01T00:00"), 1, "open", 1.0, None), (2, at("2024-01-01T01:00"), 1, "paid", 2.0, None),
           (3, at("2024-01-01T01:00"), None, "open", 3.0, None), (4, at("2024-01-01T02:00"), 9, "open", 4.0, None)]
    before = as_case_events(spark.createDataFrame(old, schema)).withColumn("ts", F.col("ts").cast("timestamp"))
    # one event that is older than what the batch has seen, one of the null case, one of a new case
    files = [[(5, "2024-01-01T00:30", 1, "asked", 5)], [(6, "2024-01-01T03:00", None, "paid", 6), (7, "2024-01-01T03:00", 7, "open", 7)]]
    stream = _stream(spark, _write(spark, f"{tmp_path}/in", files))
    with session_settings(spark, ROCKSDB):
        log = cases.stream_case_state(stream, "1 day", timedelta(days=30), initial=cases.case_totals(before))
        run_to_table(log, "log", f"{tmp_path}/state")
        held = cases.held_case_state(spark, f"{tmp_path}/state")
        assert tuples(held, "case_id", "state", "n_events", "amount_cents") == [
            (None, "paid", 2, 900),
            (1, "paid", 3, 800),
            (7, "open", 1, 700),
            (9, "open", 1, 400),
        ]


def test_one_case_is_folded_as_blocks_are_and_quickly():
    rng, columns = random.Random(1), cases._columns(cases._PARTIAL)
    days = [None, *pd.date_range("2024-01-01", periods=3)]
    for _ in range(150):
        rows = [(7, rng.choice(days), rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.randint(1, 3), rng.choice([None, 5, -2])) for _ in range(rng.randint(1, 5))]
        frame = pd.DataFrame(rows, columns=columns).astype({"ts": "datetime64[ns]"})
        wanted = tuple(None if pd.isna(v) else v for v in cases._collapsed(frame).iloc[0])
        cut = rng.randint(0, len(rows) - 1)
        before = cases._folded((7,), None, frame.iloc[:cut]) if cut else None
        assert cases._folded((7,), before, frame.iloc[cut:]) == wanted
    start = time.process_time()
    for _ in range(1000):
        cases._folded((7,), wanted, frame)
    # frames took 5 ms and more for each
    assert time.process_time() - start < 1.5
