"""Cases that the fixture tables do not hold: null keys, open ends, odd values, second runs."""

import datetime

import pytest
from pyspark.sql import functions as F

from claimtrace.operators import anomaly, cases, recovery, vectors
from claimtrace.streaming.ledger import ledger_balances, stream_ledger_upsert
from tests.frames import at, cents, entries, events, tuples


def test_rolling_baseline_of_the_null_entity(spark):
    rows = [(None, at("2024-01-01"), cents(10)), (None, at("2024-01-02"), cents(20)), ("a", at("2024-01-02"), cents(5))]
    lines = spark.createDataFrame(rows, "e string, ts timestamp_ntz, paid decimal(18,2)")
    found = anomaly.rolling_baseline(lines, ["e"], "ts", "paid", 7)
    assert tuples(found, "e", "paid", "prior_count") == [(None, cents(10), 0), (None, cents(20), 1), ("a", cents(5), 0)]


def test_open_rate_and_fractions_of_units(spark):
    lines = spark.createDataFrame(
        [("c", datetime.date(2024, 5, 1), 0.125, cents(10))], "code string, day date, units double, paid decimal(18,2)"
    )
    rates = spark.createDataFrame(
        [("c", cents(80), datetime.date(2024, 1, 1), None)], "code string, rate decimal(18,2), valid_from date, valid_to date"
    )
    assert tuples(anomaly.rate_variance(lines, rates, "code", "day"), "status", "variance") == [("priced", cents(0))]


def test_null_party_pays_nothing(spark):
    owed = entries(spark, [(None, 1, "2024-01-01", 10), (1, 2, "2024-01-01", 10)])
    paid = entries(spark, [(None, 3, "2024-01-02", 10), (1, 4, "2024-01-02", 4)])
    found = recovery.fifo_allocate(owed, paid)
    assert tuples(found, "party", "obligation_id", "amount") == [(1, 2, cents(4))]
    assert tuples(recovery.outstanding(owed, paid), "entry_id", "unpaid") == [(1, cents(10)), (2, cents(6))]


def test_aging_ends_at_its_day(spark):
    owed = entries(spark, [(1, 1, "2024-01-01", 10), (1, 2, "2024-03-01", 5)])
    paid = entries(spark, [(1, 3, "2024-04-02", 8)])
    found = recovery.outstanding_aging(owed, paid, "2024-01-31", [7, 14])
    assert tuples(found, "bucket", "n_open", "unpaid") == [("15+", 1, cents(10))]


def test_null_groups_keep_their_totals(spark):
    rows = entries(spark, [(None, 1, "2024-01-01", 5), (None, 2, "2024-01-03", 6)])
    trend = recovery.recovery_trend(rows, "day", ["party"])
    assert [r.total for r in trend.orderBy("period_start").collect()] == [cents(5), cents(0), cents(6)]
    opened = events(spark, [(1, 1, "2024-01-01", "new", 1), (2, 2, "2024-01-02", "new", 1)]).withColumn("g", F.lit(None).cast("string"))
    assert [r.n_open for r in cases.case_backlog_daily(opened, "g", "closed").orderBy("day").collect()] == [1, 2]


def test_probe_without_a_case_has_no_state(spark):
    log = events(spark, [(None, 1, "2024-01-01", "new", 1), (1, 2, "2024-01-01", "new", 1)])
    probes = spark.createDataFrame([(None, 7, at("2024-01-02")), (1, 8, at("2024-01-02"))], "case_id bigint, probe_id bigint, ts timestamp_ntz")
    assert tuples(cases.case_state_asof(probes, log), "probe_id", "state") == [(7, None), (8, "new")]


def test_one_odd_property_spoils_no_other(spark):
    rows = spark.createDataFrame([("c", '{"k":1,"j":2.5}'), ("c", '{"k":3,"j":4}'), ("c", '{"k":5,"z":"x"}')], "c string, props string")
    found = tuples(cases.event_props(rows, ["c"]), "prop", "total", "n", "n_other")
    assert found == [("j", 4, 1, 1), ("k", 9, 3, 0), ("z", None, 0, 1)]


def test_vector_of_another_width_stops_the_query(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "id bigint, vector array<double>")
    odd = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0])], "id bigint, vector array<double>")
    assert vectors.vector_topk(rows, odd.where("id = 1"), 2).count() == 2
    for search in (vectors.vector_topk, vectors.vector_topk_lsh):
        with pytest.raises(Exception, match="not a vector of 2 numbers"):
            search(rows, odd, 2).collect()


def test_repeated_key_in_a_snapshot_is_an_error(spark):
    one = spark.createDataFrame([(1, 5), (1, 6)], "k int, v int")
    with pytest.raises(Exception, match="more than one row"):
        recovery.ledger_diff(one.where("false"), one, ["k"]).collect()


def test_second_run_and_resumed_run_keep_the_ledger(spark, tmp_path):
    source, ledger, state = f"{tmp_path}/in", f"{tmp_path}/ledger", f"{tmp_path}/state"
    schema = "party bigint, entry_id bigint, ts timestamp, signed decimal(18,2)"

    def arrive(party, entry, amount):
        row = spark.createDataFrame([(party, entry, at("2024-01-01"), cents(amount))], schema)
        row.coalesce(1).write.mode("append").parquet(source)

    stream = lambda: spark.readStream.schema(schema).parquet(source)
    arrive(1, 1, 10)
    stream_ledger_upsert(stream(), ledger, state)
    arrive(2, 2, 20)
    stream_ledger_upsert(stream(), ledger, state)
    arrive(3, 3, 30)
    stream_ledger_upsert(stream(), ledger)
    found = tuples(ledger_balances(spark, ledger), "party", "balance", "n_entries")
    assert found == [(1, cents(10), 1), (2, cents(20), 1), (3, cents(30), 1)]
