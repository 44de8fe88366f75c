"""Functions over ordered groups give the same rows whether or not groups are split."""

import random

import pytest
from pyspark.sql import functions as F

from claimtrace.plans import OrderedGroups, groups, hot_keys, salted_join, with_group_stats, with_quantiles
from tests.oracle import spark_rows


@pytest.fixture
def skewed(spark):
    """One key holds a third of the rows; keys and values are sometimes null, times repeat."""
    rnd = random.Random(7)
    rows = []
    for i in range(1200):
        key = 0 if rnd.random() < 0.33 else rnd.choice([None, *range(1, 40)])
        rows.append((key, rnd.choice([None, *range(60)]), i, rnd.choice([None, *range(-5, 20)])))
    return spark.createDataFrame(rows, "k int, t int, id int, v bigint").repartition(5).cache()


def _all_functions(df):
    return (
        OrderedGroups(df, ["k"], ["t", "id"])
        .running_sum(total="v")
        .previous(before="v")
        .following(after="v")
        .last_known(known="v")
        .next_known(upcoming="v")
        .with_column("odd", (F.coalesce("before", F.lit(0)) % 2 != 0).cast("bigint"))
        .running_sum(odds="odd")
        .result()
    )


def test_ordered_functions(spark, skewed, request):
    plain = spark_rows(_all_functions(skewed))
    request.getfixturevalue("split")
    assert hot_keys(skewed, ["k"]) is not None
    assert spark_rows(_all_functions(skewed)) == plain


def test_ordered_functions_by_hand(spark):
    df = spark.createDataFrame([(1, 10, 5), (1, 20, None), (1, 30, 7)], "k int, t int, v bigint")
    out = OrderedGroups(df, ["k"], ["t"]).running_sum(s="v").previous(p="v").following(f="t")
    out = out.last_known(l="v").next_known(n="v").result().orderBy("t")
    assert [tuple(r)[3:] for r in out.collect()] == [
        (5, None, 20, 5, 5),
        (5, 5, 30, 5, 7),
        (12, None, None, 7, 7),
    ]


def test_group_stats_and_quantiles(spark, skewed, request):
    def both(df):
        stats = with_group_stats(df, ["k"], {"n": F.count("v"), "mean": F.avg("v")})
        return with_quantiles(stats, ["k"], "v", {"q1": 0.25, "median": 0.5, "p95": 0.95})

    plain = both(skewed).select("*", *[F.round(c, 9).alias(f"{c}_") for c in ("q1", "p95")]).drop("q1", "p95")
    plain = spark_rows(plain)
    request.getfixturevalue("split")
    again = both(skewed).select("*", *[F.round(c, 9).alias(f"{c}_") for c in ("q1", "p95")]).drop("q1", "p95")
    assert spark_rows(again) == plain


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join(spark, skewed, request, how):
    right = spark.createDataFrame([(i, f"r{i}", 30) for i in range(0, 40, 2)], "k int, name string, upto int")

    def joined():
        return salted_join(skewed, right, ["k"], how, F.col("t") < F.col("upto"))

    plain = spark_rows(joined())
    request.getfixturevalue("split")
    assert spark_rows(joined()) == plain
    expected = skewed.join(right.withColumnRenamed("k", "k2"), (F.col("k") == F.col("k2")) & (F.col("t") < F.col("upto")), how)
    assert spark_rows(expected.drop("k2")) == plain


def test_number_of_hot_keys_is_bounded(spark, split):
    """Only so many of the largest groups are hot; their salts follow their sizes."""
    assert hot_keys(spark.range(300).select((F.col("id") % 100).alias("k")), ["k"]) is None
    df = spark.range(20_000).select((F.col("id") % 4_000).alias("k"))
    assert hot_keys(df, ["k"]).count() == 4_000
    assert hot_keys(df, ["k"], 1_000).count() == 1_000
    some = df.unionByName(spark.range(10_000).select(F.lit(5).cast("bigint").alias("k")))
    salts = {r.k: r["__salts"] for r in hot_keys(some, ["k"], 1_000).collect()}
    assert salts.pop(5) > 600 and set(salts.values()) == {1} and len(salts) == 999


def test_ranges_are_bounded_whatever_the_groups(spark, split):
    """4,000 groups that are each too large, and one of a third of the rows, in ranges of about 300."""
    spark.conf.set("claimtrace.rangeRows", "300")
    try:
        df = spark.range(20_000).select((F.col("id") % 4_000).alias("k"), "id")
        df = df.unionByName(spark.range(20_000, 30_000).select(F.lit(5).cast("bigint").alias("k"), "id"))
        split_up = OrderedGroups(df, ["k"], ["id"])
        ranges = {r["__range"]: r["count"] for r in split_up._rows.groupBy("__range").count().collect()}
        assert len(ranges) > 80 and max(ranges.values()) < 3 * 300
        # two groups of each range can be open, and no other is summarised
        assert split_up._open.count() <= 2 * len(ranges)
        assert split_up._carried(split_up.running_sum(s="id")._steps).count() <= 4 * len(ranges)
        found = split_up.previous(p="id").result().orderBy("k", "id").collect()
        before, total = {}, {}
        for r in found:
            assert r.p == before.get(r.k)
            before[r.k], total[r.k] = r.id, total.get(r.k, 0) + r.id
            assert r.s == total[r.k]
        assert len(found) == 30_000
    finally:
        spark.conf.unset("claimtrace.rangeRows")


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k int, t int, id int, v bigint")
    assert _all_functions(empty).count() == 0
    assert with_quantiles(empty, ["k"], "v", {"m": 0.5}).count() == 0


@pytest.mark.parametrize("bins", [2, 256])
def test_refined_quantiles_are_those_of_a_window(spark, monkeypatch, bins):
    """All values distinct, all equal, far apart, missing, infinite and not numbers; small and large groups."""
    monkeypatch.setattr(groups, "BINS", bins)
    rnd = random.Random(bins)
    inf, nan = float("inf"), float("nan")
    values = {
        1: [rnd.random() for _ in range(500)],
        2: [7.0] * 50,
        3: [10.0 ** rnd.randint(-300, 300) * rnd.choice([-1, 1]) for _ in range(200)],
        4: [None, 1.0, 2.0],
        5: [-inf, inf, 0.0, 1.0, -inf, nan, nan],
        6: [None, None],
        7: [nan],
        None: [1.0, 1.0, 3.0, 8.0],
        8: [-1.7e308, 1.7e308, 0.0],
    }
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "k int, v double")
    wanted = {"q0": 0.0, "q1": 0.25, "median": 0.5, "p95": 0.95, "q4": 1.0}
    plain = {r.k: [repr(x) for x in r[2:]] for r in groups.window_quantiles(df, ["k"], "v", wanted).collect()}
    for r in groups.refined_quantiles(df, ["k"], "v", wanted).collect():
        ours, theirs = [float(x) if x is not None else None for x in r[2:]], [float(x) if x != "None" else None for x in plain[r.k]]
        for a, b in zip(ours, theirs, strict=True):
            assert a == b or (a != a and b != b) or a == pytest.approx(b, rel=1e-12), (r.k, ours, theirs)


def test_a_hot_group_of_distinct_values_is_not_sorted(spark, split):
    df = spark.range(3000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 3001).alias("v"))
    plan = with_quantiles(df, ["k"], "v", {"m": 0.5})
    assert plan.select("m").distinct().collect() == [(plan.agg(F.percentile("v", 0.5)).first()[0],)]
