"""Group statistics attached to rows, and joins on keys that may be hot."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimtrace.plans.hot import hot_keys, join_bounded
from claimtrace.sources.storage import written

# parts of an interval in one round of refined_quantiles
BINS = 256


def split_hot(
    df: DataFrame, keys: Sequence[str], sizes_from: DataFrame | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ordinary groups, and the rows of hot groups if there are any.

    Here and below, group sizes are estimated from ``sizes_from`` instead of rows that
    are costly to compute twice.
    """
    hot = hot_keys(df if sizes_from is None else sizes_from, keys)
    if hot is None:
        return df, None
    hot = hot.select(*keys)
    return join_bounded(df, hot, keys, "left_anti"), join_bounded(df, hot, keys, "left_semi")


def with_group_stats(
    df: DataFrame, by: Sequence[str], stats: Mapping[str, Column], sizes_from: DataFrame | None = None
) -> DataFrame:
    """Each row with aggregates of its group.

    Ordinary groups: one shuffle, one unordered window. Hot groups: aggregated on the
    map side to one row each and joined back by broadcast, so their rows never move.
    """
    ordinary, hot = split_hot(df, by, sizes_from)
    group = Window.partitionBy(*by)
    rows = ordinary.select("*", *[c.over(group).alias(n) for n, c in stats.items()])
    if hot is None:
        return rows
    totals = hot.groupBy(*by).agg(*[c.alias(n) for n, c in stats.items()])
    return rows.unionByName(join_bounded(hot, totals, by, "inner"))


def with_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Each row with exact, linearly interpolated quantiles of ``value`` in its group."""
    ordinary, hot = split_hot(df, by)
    rows = window_quantiles(ordinary, by, value, quantiles)
    if hot is None:
        return rows
    return rows.unionByName(refined_quantiles(hot, by, value, quantiles))


def window_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Quantiles for groups that fit in one window partition."""
    group = Window.partitionBy(*by)
    return df.select(
        "*", *[F.percentile(value, q).over(group).alias(n) for n, q in quantiles.items()]
    )


def refined_quantiles(
    df: DataFrame, by: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Quantiles for hot groups, by narrowing the interval that holds each rank; nothing is sorted.

    A round counts, for every rank still sought, the values of its interval in BINS equal parts on
    the map side; the part that holds the rank, from its smallest to its greatest value, is the next
    interval. A rank is found when that is one value. What is kept between rounds is a row per
    group and rank, and a task sends at most BINS rows for each.
    """
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    # nan is greater than every number and takes no part in bins: it is the value of the last ranks
    nan = F.isnan("__x")
    totals = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__total"),
        F.count_if(~nan).alias("__real"),
        F.min("__x").alias("__lo"),
        F.max(F.when(~nan, F.col("__x"))).alias("__hi"),
    )
    place = lambda q: (F.col("__total") - 1) * F.lit(q)
    ranks = [F.struct(F.lit(f"{end}{i}").alias("name"), cut(place(q)).cast("bigint").alias("rank"))
             for i, q in enumerate(quantiles.values()) for end, cut in (("lo", F.floor), ("hi", F.ceil))]
    totals = written(totals, "quantile-totals")
    sought = totals.select(*by, "__real", "__lo", "__hi", F.explode(F.array(*ranks)).alias("__r"))
    # ranks of a group that are one rank are sought once
    sought = sought.groupBy(*by, "__real", "__lo", "__hi", F.col("__r.rank").alias("__rank")).agg(F.collect_list("__r.name").alias("__names"))
    state = sought.select(*by, "__names", "__rank", F.lit(0).cast("bigint").alias("__below"), "__lo", F.when(F.col("__rank") >= F.col("__real"), F.lit(float("nan"))).otherwise(F.col("__hi")).alias("__hi"))
    state = state.withColumn("__lo", F.when(F.isnan("__hi"), F.col("__hi")).otherwise(F.col("__lo")))
    state = written(state, "quantile-ranks")
    done = state.where(F.col("__lo") == F.col("__hi"))
    live = state.where(F.col("__lo") != F.col("__hi"))
    while live.take(1):
        near = join_bounded(rows, live, by, "inner").where((F.col("__x") >= F.col("__lo")) & (F.col("__x") <= F.col("__hi")))
        # halves of both ends, as their difference may be more than a double holds
        share = (F.col("__x") / 2 - F.col("__lo") / 2) / (F.col("__hi") / 2 - F.col("__lo") / 2)
        part = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")
        # an infinite end has no parts: it is one of its own
        part = F.when(F.col("__x") == F.col("__lo"), -1).when(F.col("__x") == F.col("__hi"), BINS).otherwise(F.coalesce(F.when(~F.isnan(share), part), F.lit(0)))
        bins = near.groupBy(*by, "__names", "__rank", "__below", part.alias("__part")).agg(
            F.count(F.lit(1)).alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")
        )
        so_far = Window.partitionBy(*by, "__rank").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("__below", F.col("__below") + F.coalesce(F.sum("__n").over(so_far), F.lit(0)))
        here = bins.where((F.col("__below") <= F.col("__rank")) & (F.col("__rank") < F.col("__below") + F.col("__n")))
        state = written(here.select(*live.columns), "quantile-ranks")
        done = done.unionByName(state.where(F.col("__lo") == F.col("__hi")))
        live = state.where(F.col("__lo") != F.col("__hi"))
    values = done.select(*by, F.explode("__names").alias("__name"), F.col("__lo").alias("__v"))
    ends = values.groupBy(*by).agg(
        *[F.max(F.when(F.col("__name") == f"{end}{i}", F.col("__v"))).alias(f"__{end}{i}") for i in range(len(quantiles)) for end in ("lo", "hi")]
    )
    ends = join_bounded(totals.select(*by, "__total"), ends, by, "inner")
    found = ends.select(
        *by,
        *[
            F.when(F.col(f"__lo{i}") == F.col(f"__hi{i}"), F.col(f"__lo{i}"))
            .otherwise((1 - (place(q) - F.floor(place(q)))) * F.col(f"__lo{i}") + (place(q) - F.floor(place(q))) * F.col(f"__hi{i}"))
            .alias(name)
            for i, (name, q) in enumerate(quantiles.items())
        ],
    )
    return join_bounded(df, written(found, "quantiles"), by, "left")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    condition: Column | None = None,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Equi-join (null never matches) where ``left`` may have hot keys.

    Rows of a hot key are dealt out over several salts and the matching right rows are
    repeated once per salt; other keys have the single salt 0. ``condition`` may refer
    to columns of both sides.

    ``right`` is never broadcast: Spark does not see how many rows an explode or a join below it
    makes, and adaptive execution keeps a broadcast that saves a shuffle, however large it turns out.
    """
    hot = hot_keys(left if sizes_from is None else sizes_from, on)
    if hot is not None:
        hot = hot.drop("__rows")
    else:
        renamed = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
        match = [left[c] == renamed[f"__r_{c}"] for c in on]
        if condition is not None:
            match.append(condition)
        return left.join(renamed.hint("merge"), match, how).drop(*[f"__r_{c}" for c in on])
    dealt = join_bounded(left, hot, on, "left").withColumn(
        "__salt",
        F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("__salts")).cast("int"), F.lit(0)),
    )
    repeated = join_bounded(right, hot, on, "left").select(
        *[F.col(c).alias(f"__r_{c}") if c in on else F.col(c) for c in right.columns],
        F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1)).alias("__r_salt"),
    )
    match = [dealt[k] == repeated[f"__r_{k}"] for k in on]
    match.append(dealt["__salt"] == repeated["__r_salt"])
    if condition is not None:
        match.append(condition)
    return dealt.join(repeated.hint("merge"), match, how).drop(
        "__salt", "__salts", "__r_salt", *[f"__r_{k}" for k in on]
    )


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows per group.

    The filter sits directly on the window, so Spark cuts each map task's rows to ``k``
    per group before the shuffle; a hot group is small by the time it is gathered.
    """
    place = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(place)).where(F.col(rank) <= k)
