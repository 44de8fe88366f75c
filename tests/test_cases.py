from pyspark.sql import functions as F

from claimtrace.operators import cases
from tests.frames import at, cents, events, tuples


def test_a_gap_equal_to_the_limit_stays_in_the_case(spark):
    flags = events(
        spark,
        [
            (1, 1, "2024-01-01T00:00", "a", 1),
            (1, 2, "2024-01-01T06:00", "a", 2),
            (1, 3, "2024-01-01T12:00:00.000001", "a", 4),
            (2, 4, "2024-01-01T00:00", "a", 8),
        ],
    )
    built = cases.build_cases(flags, "case_id", "ts", "6 hours", "amount", ["event_id"])
    assert tuples(built, "case_id", "case_no", "n_flags", "amount", "case_end") == [
        (1, 1, 2, cents(3), at("2024-01-01T12:00")),
        (1, 2, 1, cents(4), at("2024-01-01T18:00:00.000001")),
        (2, 1, 1, cents(8), at("2024-01-01T06:00")),
    ]
    assert cases.assign_cases(flags, "case_id", "ts", "6 hours", ["event_id"]).count() == 4


TIES = [
    (1, 2, "2024-01-01T00:00", "b", 1),
    (1, 1, "2024-01-01T00:00", "a", 1),
    (1, 3, "2024-01-02T00:00", "a", 1),
]


def test_ties_in_time_follow_the_event_number(spark):
    assert tuples(cases.current_case_state(events(spark, TIES[:2])), "case_id", "state") == [(1, "b")]
    steps = cases.state_intervals(events(spark, TIES))
    assert tuples(steps, "event_id", "next_state", "dwell_us") == [
        (1, "b", 0),
        (2, "a", 86_400_000_000),
        (3, None, None),
    ]


def test_intervals_abut(spark):
    steps = cases.state_intervals(events(spark, TIES)).orderBy("valid_from", "event_id").collect()
    assert [s.valid_to for s in steps[:-1]] == [s.valid_from for s in steps[1:]]


def test_first_event_is_not_a_transition(spark):
    found = cases.invalid_transitions(events(spark, TIES), [("a", "b")])
    assert tuples(found, "event_id", "state", "next_state") == [(2, "b", "a")]


def test_state_asof_includes_an_event_at_that_time(spark):
    probes = spark.createDataFrame(
        [(1, 1, at("2023-12-31T00:00")), (1, 2, at("2024-01-01T00:00")), (1, 3, at("2024-01-03T00:00")),
         (9, 4, at("2024-01-03T00:00"))],
        "case_id bigint, probe_id bigint, ts timestamp_ntz",
    )
    found = cases.case_state_asof(probes, events(spark, TIES))
    assert tuples(found, "probe_id", "state") == [(1, None), (2, "b"), (3, "a"), (4, None)]


def test_backlog_counts_reopened_cases_and_fills_days(spark):
    rows = events(
        spark,
        [
            (1, 1, "2024-01-01T01:00", "open", 0),
            (1, 2, "2024-01-02T01:00", "done", 0),
            (1, 3, "2024-01-04T01:00", "open", 0),
            (2, 4, "2024-01-01T01:00", "open", 0),
            (2, 5, "2024-01-01T02:00", "open", 0),
            (3, 6, "2024-01-04T02:00", "done", 0),
        ],
    ).withColumn("team", F.lit("t"))
    found = cases.case_backlog_daily(rows, "team", "done").orderBy("day")
    assert [r.n_open for r in found.collect()] == [2, 1, 1, 2]


def test_last_state_is_measured_to_the_given_time(spark):
    rows = [(1, 1, "2024-01-01T00:00", "a", 0), (1, 2, "2024-01-01T05:00", "b", 0), (1, 3, "2024-02-01T00:00", "a", 0)]
    found = cases.sla_breaches(events(spark, rows), {"a": 5, "b": 1}, "2024-01-01 06:00:00")
    assert tuples(found, "event_id", "is_open") == []
    found = cases.sla_breaches(events(spark, rows), {"a": 4.5, "b": 1}, "2024-01-01 06:00:01")
    assert tuples(found, "event_id", "is_open") == [(1, False), (2, True)]


def test_worklist_breaks_ties_by_key(spark):
    rows = spark.createDataFrame([(c, "x", 5) for c in (3, 1, 2)], "case_id int, who string, amount int")
    assert tuples(cases.worklist_topk(rows, "who", ["amount"], ["case_id"], 2), "case_id", "rank") == [(1, 1), (2, 2)]


def test_long_timelines_are_paged(spark):
    rows = events(spark, [(1, i, f"2024-01-01T{i:02d}:00", f"s{i}", i) for i in range(5)])
    pages = cases.case_summary(rows, page_size=2)
    assert tuples(pages, "page", "path", "n_events", "total") == [
        (0, "s0>s1", 5, cents(10)),
        (1, "s2>s3", 5, cents(10)),
        (2, "s4", 5, cents(10)),
    ]


def test_upsert(spark):
    current = spark.createDataFrame([(1, "a", 1), (2, "a", 5), (3, "a", 1), (4, "a", 1)], "k int, s string, v int")
    changes = spark.createDataFrame(
        [(1, "b", 1, 1, False), (2, "b", 4, 2, False), (3, "b", 2, 3, False), (3, "c", 2, 4, False),
         (4, "b", 2, 5, True), (5, "n", 1, 6, False)],
        "k int, s string, v int, seq int, gone boolean",
    )
    merged = cases.case_upsert(current, changes, ["k"], "v", "seq", "gone")
    assert tuples(merged, "k", "s") == [(1, "b"), (2, "a"), (3, "c"), (5, "n")]


def test_properties_with_several_names_and_bad_json(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": 2}'), (1, '{"a": 5}'), (1, "no json"), (1, None)], "c int, props string")
    assert tuples(cases.event_props(rows, ["c"]), "prop", "total", "n") == [("a", 6, 2), ("b", 2, 1)]


def test_pivot_has_all_states(spark):
    rows = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "b")], "team string, state string")
    found = cases.case_status_pivot(rows, "team", ["a", "b", "c"])
    assert tuples(found, "team", "a", "b", "c") == [("x", 2, 0, 0), ("y", 0, 1, 0)]
