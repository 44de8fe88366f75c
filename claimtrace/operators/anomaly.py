"""Anomaly detection on claim lines.

A null measure is left out of both statistic and result. Floats are rounded to four
places before they are compared with a limit.
"""

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimtrace.plans import OrderedGroups, salted_join, split_hot, top_k, with_group_stats, with_quantiles
from claimtrace.plans.groups import refined_quantiles, window_quantiles


def high_cost_lines(lines: DataFrame, amount: str, by: Sequence[str], q: float) -> DataFrame:
    """Lines at or above the exact q-quantile of their group, with that ``threshold``."""
    scored = with_quantiles(_peers(lines, amount, by), by, amount, {"threshold": q})
    return scored.where(F.col(amount) >= F.col("threshold"))


def high_cost_lines_approx(
    lines: DataFrame, amount: str, by: Sequence[str], q: float, accuracy: int = 10_000
) -> DataFrame:
    """``high_cost_lines`` by a quantile sketch; the rank error is at most 1/accuracy."""
    sketch = F.percentile_approx(amount, q, accuracy)
    scored = with_group_stats(_peers(lines, amount, by), by, {"threshold": sketch})
    return scored.where(F.col(amount) >= F.col("threshold"))


def peer_zscore(lines: DataFrame, value: str, by: Sequence[str], k: float) -> DataFrame:
    """Lines whose z-score in the peer group is at least ``k`` away from 0.

    Groups of one line or without deviation give no score.
    """
    x = F.col(value).cast("double")
    scored = with_group_stats(
        _peers(lines, value, by), by, {"peer_mean": F.avg(x), "peer_dev": F.stddev_samp(x)}
    )
    z = F.when(F.col("peer_dev") > 0, F.round((x - F.col("peer_mean")) / F.col("peer_dev"), 4))
    return scored.withColumn("zscore", z).where(F.abs("zscore") >= k)


def peer_robust_zscore(lines: DataFrame, value: str, by: Sequence[str], k: float = 3.5) -> DataFrame:
    """Lines whose 0.6745 * (x - median) / MAD exceeds ``k``; MAD 0 gives no score."""
    ordinary, hot = split_hot(_peers(lines, value, by), by)
    x = F.col(value).cast("double")

    def scored(rows: DataFrame, quantiles) -> DataFrame:
        rows = quantiles(rows, by, value, {"peer_median": 0.5})
        rows = rows.withColumn("__away", F.abs(x - F.col("peer_median")))
        rows = quantiles(rows, by, "__away", {"peer_mad": 0.5}).drop("__away")
        z = F.round(F.lit(0.6745) * (x - F.col("peer_median")) / F.col("peer_mad"), 4)
        return rows.withColumn("zscore", F.when(F.col("peer_mad") > 0, z)).where(F.col("zscore") > k)

    flagged = scored(ordinary, window_quantiles)
    return flagged if hot is None else flagged.unionByName(scored(hot, refined_quantiles))


def peer_iqr_outliers(lines: DataFrame, value: str, by: Sequence[str], m: float = 1.5) -> DataFrame:
    """Lines outside Q1 - m * IQR .. Q3 + m * IQR, with the ``side`` they fall on."""
    scored = with_quantiles(_peers(lines, value, by), by, value, {"q1": 0.25, "q3": 0.75})
    spread = F.lit(m) * (F.col("q3") - F.col("q1"))
    x = F.col(value).cast("double")
    side = F.when(x > F.col("q3") + spread, "high").when(x < F.col("q1") - spread, "low")
    return scored.withColumn("side", side).where(F.col("side").isNotNull())


def rolling_baseline(lines: DataFrame, entity: Sequence[str], ts: str, amount: str, days: int) -> DataFrame:
    """Each line with the sum and count of its entity's lines in the ``days`` days before its day.

    Lines are summed per entity and day first, so the moving window runs over at most
    one row per calendar day, however many lines an entity has. An empty window has
    count 0 and null sum and deviation. Lines without an entity are an entity.
    """
    rows = lines.where(F.col(amount).isNotNull()).withColumn("__day", F.to_date(ts))
    daily = rows.groupBy(*entity, "__day").agg(
        F.sum(amount).alias("__sum"), F.count(F.lit(1)).alias("__n")
    )
    before = (
        Window.partitionBy(*entity)
        .orderBy(F.datediff("__day", F.lit("1970-01-01").cast("date")))
        .rangeBetween(-days, -1)
    )
    baseline = daily.select(
        *entity,
        "__day",
        F.sum("__sum").over(before).alias("prior_sum"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("prior_count"),
    )
    keys = [*entity, "__day"]
    named = reduce(and_, [F.col(c).isNotNull() for c in keys])
    # equal nulls do not join by name, so lines with a null in a key join apart
    marked = baseline.select(*[F.col(c).alias(f"__b_{c}") for c in keys], "prior_sum", "prior_count")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__b_{c}")) for c in keys])
    nameless = rows.where(~named).join(marked, same, "left").drop(*[f"__b_{c}" for c in keys])
    scored = salted_join(rows.where(named), baseline, keys, "left").unionByName(nameless).drop("__day")
    scored = scored.withColumn("prior_count", F.coalesce("prior_count", F.lit(0)))
    mean = F.col("prior_sum").cast("double") / F.col("prior_count")
    return scored.withColumn("deviation", F.col(amount).cast("double") - mean)


def rate_variance(lines: DataFrame, rates: DataFrame, on: str, date: str) -> DataFrame:
    """Each line with its ``variance`` = paid - units * rate, the rate in force on ``date``.

    Validity is valid_from <= date < valid_to; a null valid_to is open. Units count to six places. A line without a rate in force gets a
    null variance and status ``no_rate``. Overlapping intervals of one code stop the query.
    """
    checked = (
        OrderedGroups(rates.select(on, "rate", "valid_from", "valid_to"), [on], ["valid_from", "valid_to"])
        .following(__next_from="valid_from")
        .result()
    )
    overlap = F.col("__next_from").isNotNull() & (
        F.col("valid_to").isNull() | (F.col("__next_from") < F.col("valid_to"))
    )
    message = F.concat(F.lit("overlapping rate intervals for code "), F.col(on).cast("string"))
    checked = checked.select(
        on,
        "rate",
        F.when(overlap, F.raise_error(message).cast("date")).otherwise(F.col("valid_from")).alias("valid_from"),
        "valid_to",
    )
    day = F.to_date(date)
    priced = salted_join(
        lines.where(F.col("paid").isNotNull()),
        checked,
        [on],
        "left",
        (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to"))),
    )
    owed = F.col("units").cast("decimal(18,6)") * F.col("rate").cast("decimal(18,2)")
    return (
        priced.withColumn("variance", (F.col("paid") - owed).cast("decimal(18,2)"))
        .withColumn("status", F.when(F.col("rate").isNull(), "no_rate").otherwise("priced"))
        .drop("valid_from", "valid_to")
    )


def repeat_lines(
    lines: DataFrame, keys: Sequence[str], ts: str, within_days: int, tie: Sequence[str]
) -> DataFrame:
    """Lines at most ``within_days`` days after the previous line of the same keys.

    ``tie`` makes the order unique within one time.
    """
    rows = lines.where(F.col(ts).isNotNull())
    previous = OrderedGroups(rows, keys, [ts, *[t for t in tie if t != ts]]).previous(previous_date=ts).result()
    gap = F.datediff(ts, "previous_date")
    return previous.withColumn("gap_days", gap).where(F.col("gap_days") <= within_days)


def frequency_limit(
    lines: DataFrame, entity: str, code: str, ts: str, period: str, units: str, cap: float
) -> DataFrame:
    """Entity, code and period whose total units exceed ``cap``."""
    start = F.date_trunc(period, ts).alias("period_start")
    return (
        lines.where(F.col(units).isNotNull())
        .groupBy(entity, code, start)
        .agg(F.sum(units).alias("total_units"), F.count(F.lit(1)).alias("n_lines"))
        .where(F.col("total_units") > cap)
    )


def provider_peer_rank(totals: DataFrame, provider: str, peer: str, amount: str) -> DataFrame:
    """``pct_rank``, ``cume_dist`` and ``decile`` of provider totals within the peer group.

    ``totals`` has one row per provider. The ranks are derived from one running count,
    so a peer group of any size is spread over many tasks.
    """
    rows = totals.withColumn("__one", F.lit(1))
    rows = OrderedGroups(rows, [peer], [amount, provider]).running_sum(__row="__one").result()
    rows = with_group_stats(rows, [peer], {"__n": F.count(F.lit(1))}, totals)
    rows = with_group_stats(
        rows, [peer, amount], {"__low": F.min("__row"), "__high": F.max("__row")}, totals
    )
    n, row = F.col("__n"), F.col("__row")
    size = F.floor(n / 10)
    longer = F.pmod(n, F.lit(10))
    in_longer = longer * (size + 1)
    decile = F.when(row <= in_longer, F.ceil(row / (size + 1))).otherwise(
        longer + F.ceil((row - in_longer) / size)
    )
    return rows.select(
        provider,
        peer,
        amount,
        F.when(n > 1, (F.col("__low") - 1) / (n - 1)).otherwise(0.0).alias("pct_rank"),
        (F.col("__high") / n).alias("cume_dist"),
        decile.cast("int").alias("decile"),
    )


def risk_score(
    flag_sets: Mapping[str, DataFrame],
    weights: Mapping[str, float],
    key: Sequence[str],
    provider: str,
    k: int,
) -> DataFrame:
    """The ``k`` highest-scoring lines per provider; a rule counts once per line."""
    hits = None
    for rule, flags in flag_sets.items():
        part = flags.select(*key, F.lit(rule).alias("rule"))
        hits = part if hits is None else hits.unionByName(part)
    hit = {rule: F.count_if(F.col("rule") == rule) > 0 for rule in flag_sets}
    score = sum(F.when(found, float(weights[rule])).otherwise(0.0) for rule, found in hit.items())
    n_rules = sum(found.cast("int") for found in hit.values())
    scores = hits.groupBy(*key).agg(
        F.round(score, 4).alias("score"), n_rules.cast("bigint").alias("n_rules")
    )
    order: list[Column] = [F.col("score").desc(), *[F.col(c) for c in key]]
    return top_k(scores, [provider], order, k)


def _peers(lines: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Lines that can be compared: the measure and the whole group key are known."""
    known = F.col(value).isNotNull()
    for column in by:
        known = known & F.col(column).isNotNull()
    return lines.where(known)
