import datetime

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from claimtrace.operators import anomaly
from tests.frames import at, cents, tuples


def _lines(spark, rows):
    return spark.createDataFrame(rows, "id int, code int, x double")


def test_high_cost_includes_ties_at_the_threshold(spark):
    lines = _lines(spark, [(i, 1, 10.0) for i in range(4)] + [(9, 2, 5.0), (10, 2, None), (11, None, 99.0)])
    found = anomaly.high_cost_lines(lines, "x", ["code"], 0.95)
    assert tuples(found, "id", "threshold") == [(0, 10.0), (1, 10.0), (2, 10.0), (3, 10.0), (9, 5.0)]


def test_quantiles_interpolate(spark):
    lines = _lines(spark, [(i, 1, float(x)) for i, x in enumerate([1, 2, 3, 10])])
    found = anomaly.high_cost_lines(lines, "x", ["code"], 0.75)
    assert tuples(found, "id", "threshold") == [(3, 4.75)]


def test_approximate_quantile_has_a_small_rank_error(spark):
    lines = spark.range(20_000).select(F.col("id"), F.lit(1).alias("code"), (F.col("id") * 7919 % 20_000).alias("x"))
    n = anomaly.high_cost_lines_approx(lines, "x", ["code"], 0.99, 1_000).count()
    assert abs(n - 200) <= 21


def test_zscore_needs_two_lines_and_deviation(spark):
    lines = _lines(spark, [(1, 1, 5.0), (2, 2, 3.0), (3, 2, 3.0), (4, 3, 0.0), (5, 3, 2.0), (6, None, 1e9)])
    found = anomaly.peer_zscore(lines, "x", ["code"], 0.5)
    assert tuples(found, "id", "zscore") == [(4, -0.7071), (5, 0.7071)]


def test_robust_zscore_by_hand_and_mad_zero(spark):
    rows = [(i, 1, float(x)) for i, x in enumerate([1, 2, 3, 4, 100])]
    rows += [(10 + i, 2, x) for i, x in enumerate([5.0, 5.0, 5.0, 900.0])]
    found = anomaly.peer_robust_zscore(_lines(spark, rows), "x", ["code"], 3.5)
    assert tuples(found, "id", "zscore") == [(4, round(0.6745 * 97, 4))]


def test_iqr_sides(spark):
    rows = [(i, 1, float(x)) for i, x in enumerate([-100, 10, 11, 12, 13, 14, 200])]
    found = anomaly.peer_iqr_outliers(_lines(spark, rows), "x", ["code"], 1.5)
    assert tuples(found, "id", "side") == [(0, "low"), (6, "high")]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    xs=st.lists(st.integers(-1000, 1000), min_size=5, max_size=25),
    shift=st.integers(-500, 500),
    scale=st.integers(1, 8),
)
def test_zscores_ignore_shift_and_scale(spark, xs, shift, scale):
    plain = _lines(spark, [(i, 1, float(x)) for i, x in enumerate(xs)])
    moved = _lines(spark, [(i, 1, float(x * scale + shift)) for i, x in enumerate(xs)])

    def scores(lines):
        z = anomaly.peer_zscore(lines, "x", ["code"], 0.0).select("id", F.round("zscore", 3).alias("z"))
        r = anomaly.peer_robust_zscore(lines, "x", ["code"], 1.0).select("id", F.round("zscore", 3).alias("z"))
        return tuples(z, "id", "z"), tuples(r, "id", "z")

    for ours, theirs in zip(scores(plain), scores(moved), strict=True):
        assert [i for i, _ in ours] == [i for i, _ in theirs]
        assert all(abs(a[1] - b[1]) <= 0.0021 for a, b in zip(ours, theirs, strict=True))


def test_rolling_baseline_looks_at_earlier_days_only(spark):
    rows = [
        (1, 7, at("2024-01-01T08:00"), cents(10)),
        (2, 7, at("2024-01-01T09:00"), cents(20)),
        (3, 7, at("2024-01-29T00:00"), cents(5)),
        (4, 7, at("2024-01-30T00:00"), cents(7)),
        (5, 8, at("2024-01-30T00:00"), cents(1)),
    ]
    lines = spark.createDataFrame(rows, "id int, who int, ts timestamp_ntz, paid decimal(18,2)")
    found = anomaly.rolling_baseline(lines, ["who"], "ts", "paid", 28)
    assert tuples(found, "id", "prior_sum", "prior_count", "deviation") == [
        (1, None, 0, None),
        (2, None, 0, None),
        (3, cents(30), 2, -10.0),
        (4, cents(5), 1, 2.0),
        (5, None, 0, None),
    ]


def _rates(spark, rows):
    day = datetime.date.fromisoformat
    data = [(c, cents(r), day(a), day(b)) for c, r, a, b in rows]
    return spark.createDataFrame(data, "code int, rate decimal(18,2), valid_from date, valid_to date")


def _priced(spark):
    rows = [(1, 1, at("2024-01-01T00:00")), (2, 1, at("2024-01-10T23:59")), (3, 1, at("2024-01-11T00:00")),
            (4, 1, at("2024-02-01T00:00")), (5, 2, at("2024-01-05T00:00")), (6, None, at("2024-01-05T00:00"))]
    data = [(i, c, ts, 2.0, cents(30)) for i, c, ts in rows]
    return spark.createDataFrame(data, "id int, code int, ts timestamp_ntz, units double, paid decimal(18,2)")


def test_rate_in_force(spark):
    rates = _rates(spark, [(1, 10, "2024-01-01", "2024-01-11"), (1, 20, "2024-01-11", "2024-02-01")])
    found = anomaly.rate_variance(_priced(spark), rates, "code", "ts")
    assert tuples(found, "id", "variance", "status") == [
        (1, cents(10), "priced"),
        (2, cents(10), "priced"),
        (3, cents(-10), "priced"),
        (4, None, "no_rate"),
        (5, None, "no_rate"),
        (6, None, "no_rate"),
    ]


def test_overlapping_rates_are_reported(spark):
    rates = _rates(spark, [(1, 10, "2024-01-01", "2024-01-12"), (1, 20, "2024-01-11", "2024-02-01")])
    with pytest.raises(SparkRuntimeException, match="overlapping rate intervals for code 1"):
        anomaly.rate_variance(_priced(spark), rates, "code", "ts").collect()


def test_repeats_within_days_inclusive(spark):
    rows = [(1, "2024-01-01"), (2, "2024-01-31"), (3, "2024-01-31"), (4, "2024-03-02")]
    lines = spark.createDataFrame([(i, 5, at(ts)) for i, ts in rows], "id int, who int, ts timestamp_ntz")
    found = anomaly.repeat_lines(lines, ["who"], "ts", 30, ["id"])
    assert tuples(found, "id", "gap_days") == [(2, 30), (3, 0)]


def test_a_rule_counts_once_per_line(spark):
    hits = spark.createDataFrame([(1, 7), (1, 7), (2, 7)], "id int, who int")
    other = spark.createDataFrame([(1, 7), (3, 8)], "id int, who int")
    scored = anomaly.risk_score({"a": hits, "b": other}, {"a": 1.0, "b": 0.5}, ["id", "who"], "who", 1)
    assert tuples(scored, "id", "score", "n_rules", "rank") == [(1, 1.5, 2, 1), (3, 0.5, 1, 1)]


def test_ranks_of_a_single_provider_and_of_ties(spark):
    rows = [(1, 1, 5.0), (2, 2, 1.0), (3, 2, 1.0), (4, 2, 9.0)]
    totals = spark.createDataFrame(rows, "provider int, peer int, amount double")
    found = anomaly.provider_peer_rank(totals, "provider", "peer", "amount")
    assert tuples(found, "provider", "pct_rank", "cume_dist", "decile") == [
        (1, 0.0, 1.0, 1),
        (2, 0.0, 2 / 3, 1),
        (3, 0.0, 2 / 3, 2),
        (4, 1.0, 1.0, 3),
    ]


def test_empty_input(spark):
    empty = _lines(spark, [])
    assert anomaly.high_cost_lines(empty, "x", ["code"], 0.9).count() == 0
    assert anomaly.peer_robust_zscore(empty, "x", ["code"]).count() == 0
