"""Overpayment recovery: what was overpaid, what came back, and what is still owed.

Obligations and recoveries have the columns party, entry_id, ts and amount (a decimal).
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimtrace.plans import OrderedGroups, salted_join

MONEY = "decimal(18,2)"
TOTAL = "decimal(28,2)"


def overpayments(variance: DataFrame, by: Sequence[str]) -> DataFrame:
    """Positive variance summed per group; an underpayment never offsets it.

    Lines are chosen inside the sums: as a filter the condition would be moved into the
    join that prices the lines, and computed for every rate interval of a code.
    """
    over = F.col("variance") > 0
    totals = variance.groupBy(*by).agg(
        F.sum(F.when(over, F.col("variance"))).alias("overpaid"), F.count_if(over).alias("n_lines")
    )
    return totals.where(F.col("n_lines") > 0)


def recovery_ledger(obligations: DataFrame, recoveries: DataFrame) -> DataFrame:
    """Dated entries, obligations positive and recoveries negative, with a running balance per party."""
    entries = _entries(obligations, "obligation", F.col("amount")).unionByName(
        _entries(recoveries, "recovery", -F.col("amount"))
    )
    ledger = OrderedGroups(entries, ["party"], ["ts", "entry_id", "kind"]).running_sum(balance="signed").result()
    return ledger.withColumn("balance", F.col("balance").cast(TOTAL))


def fifo_allocate(obligations: DataFrame, recoveries: DataFrame) -> DataFrame:
    """Which recovery paid which obligation, and how much: the oldest obligation is paid first.

    Obligations and recoveries of a party are laid end to end along one line of money,
    each in (ts, entry_id) order. Between two neighbouring end points a single recovery
    pays a single obligation, so one ordered pass over the end points gives every
    allocation; no pairs of obligations and recoveries are formed. Recoveries are not
    tied to dates: an early one is a credit. Amounts of 0 are left out and a negative
    amount stops the query. Entries without a party pay nothing and are not paid.
    """
    obligations = obligations.where(F.col("party").isNotNull())
    recoveries = recoveries.where(F.col("party").isNotNull())
    owed = _end_points(obligations, "obligation")
    paid = _end_points(recoveries, "recovery")
    parties = obligations.select("party").unionAll(recoveries.select("party"))
    ends = owed.unionByName(paid, allowMissingColumns=True)
    points = (
        OrderedGroups(ends, ["party"], ["end", "kind"], sizes_from=parties)
        .previous(start="end")
        .next_known(obligation_at="obligation", recovery_at="recovery")
        .result()
    )
    amount = (F.col("end") - F.coalesce("start", F.lit(0))).cast(MONEY)
    return (
        points.where(F.col("obligation_at").isNotNull() & F.col("recovery_at").isNotNull())
        .select(
            "party",
            F.col("obligation_at.entry_id").alias("obligation_id"),
            F.col("obligation_at.ts").alias("obligation_ts"),
            F.col("recovery_at.entry_id").alias("recovery_id"),
            F.col("recovery_at.ts").alias("recovery_ts"),
            amount.alias("amount"),
        )
        .where(F.col("amount") > 0)
    )


def outstanding(obligations: DataFrame, recoveries: DataFrame) -> DataFrame:
    """Obligations with the part that recoveries, oldest obligation first, have not paid."""
    owed = _end_points(obligations, "obligation")
    paid = _accepted(recoveries).groupBy("party").agg(F.sum("amount").alias("paid"))
    joined = salted_join(owed, paid, ["party"], "left", sizes_from=obligations)
    covered = F.coalesce("paid", F.lit(0)) - (F.col("end") - F.col("amount"))
    unpaid = F.col("amount") - F.least("amount", F.greatest(covered, F.lit(0)))
    return joined.select(
        "party", "obligation.entry_id", "obligation.ts", "amount", unpaid.cast(MONEY).alias("unpaid")
    )


def outstanding_aging(
    obligations: DataFrame, recoveries: DataFrame, as_of: str, limits: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """Unpaid balance by age in days at ``as_of``; ``limits`` are the last days of all buckets but one.

    Obligations and recoveries after the day ``as_of`` do not count.
    """
    known = F.to_date("ts") <= F.lit(as_of).cast("date")
    obligations, recoveries = obligations.where(known), recoveries.where(known)
    open_items = outstanding(obligations, recoveries).where(F.col("unpaid") > 0)
    age = F.datediff(F.lit(as_of).cast("date"), F.to_date("ts"))
    bucket, first = None, 0
    for last in limits:
        label = f"{first}-{last}"
        bucket = F.when(age <= last, label) if bucket is None else bucket.when(age <= last, label)
        first = last + 1
    oldest = F.lit(f"{first}+")
    return (
        open_items.withColumn("bucket", oldest if bucket is None else bucket.otherwise(oldest))
        .groupBy(*by, "bucket")
        .agg(F.count(F.lit(1)).alias("n_open"), F.sum("unpaid").alias("unpaid"))
    )


def reconcile(obligations: DataFrame, recoveries: DataFrame) -> DataFrame:
    """Per party: owed and paid in total, and whether that is settled, short, over or one-sided."""
    owed = obligations.groupBy("party").agg(F.sum("amount").alias("owed"))
    paid = recoveries.groupBy("party").agg(F.sum("amount").alias("paid"))
    status = (
        F.when(F.col("paid").isNull(), "unmatched_obligation")
        .when(F.col("owed").isNull(), "unmatched_recovery")
        .when(F.col("owed") == F.col("paid"), "settled")
        .when(F.col("owed") > F.col("paid"), "short")
        .otherwise("over_recovered")
    )
    return owed.join(paid, "party", "full_outer").withColumn("status", status)


def recovery_rollup(rows: DataFrame, hierarchy: Sequence[str], cube: bool = False) -> DataFrame:
    """Identified and recovered amounts and their rate at each level of ``hierarchy``.

    ``level`` is the grouping id: it tells a subtotal from a null key. Rows are summed
    at the finest level before they are multiplied into levels.
    """
    finest = rows.groupBy(*hierarchy).agg(
        F.sum("identified").alias("identified"), F.sum("recovered").alias("recovered")
    )
    grouped = finest.cube(*hierarchy) if cube else finest.rollup(*hierarchy)
    totals = grouped.agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("identified").cast(TOTAL).alias("identified"),
        F.sum("recovered").cast(TOTAL).alias("recovered"),
    )
    rate = F.col("recovered").cast("double") / F.col("identified").cast("double")
    return totals.withColumn("rate", F.when(F.col("identified") != 0, rate))


def recovery_vintage(allocations: DataFrame, obligations: DataFrame, step: str) -> DataFrame:
    """Per cohort of obligations, the share recovered by the end of each step since identification.

    ``step`` is day, week or month. A recovery older than its obligation counts in step 0.
    """
    identified = obligations.groupBy(_cohort("ts", step)).agg(F.sum("amount").alias("identified"))
    paid_in = F.date_trunc(step, "recovery_ts")
    steps = {
        "day": F.datediff(paid_in, "cohort"),
        "week": F.floor(F.datediff(paid_in, "cohort") / 7).cast("int"),
        "month": F.round(F.months_between(paid_in, "cohort")).cast("int"),
    }[step]
    recovered = (
        allocations.withColumn("cohort", F.date_trunc(step, "obligation_ts"))
        .withColumn("step", F.greatest(steps, F.lit(0)))
        .groupBy("cohort", "step")
        .agg(F.sum("amount").alias("recovered"))
    )
    # at most one row per cohort and step from here on
    to_date = Window.partitionBy("cohort").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    running = recovered.withColumn("recovered_to_date", F.sum("recovered").over(to_date).cast(TOTAL))
    share = F.col("recovered_to_date").cast("double") / F.col("identified").cast("double")
    return running.join(identified, "cohort").withColumn(
        "share", F.when(F.col("identified") != 0, share)
    )


def recovery_funnel(
    events: DataFrame, unit: Sequence[str], by: Sequence[str], demanded: str, recovered: str
) -> DataFrame:
    """Units identified, then demanded, then recovered after the first demand, with conversion."""
    first_demand = F.min(F.when(F.col("state") == demanded, F.col("ts")))
    last_recovery = F.max(F.when(F.col("state") == recovered, F.col("ts")))
    units = events.groupBy(*dict.fromkeys([*by, *unit])).agg(
        first_demand.alias("first_demand"), last_recovery.alias("last_recovery")
    )
    counts = units.groupBy(*by).agg(
        F.count(F.lit(1)).alias("identified"),
        F.count("first_demand").alias("demanded"),
        F.count_if(F.col("last_recovery") > F.col("first_demand")).alias("recovered"),
    )
    return counts.select(
        "*",
        _ratio("demanded", "identified").alias("demand_rate"),
        _ratio("recovered", "demanded").alias("recovery_rate"),
    )


def recovery_trend(recoveries: DataFrame, period: str, by: Sequence[str]) -> DataFrame:
    """Period totals per group from its first to its last period, gaps as 0, with the change."""
    totals = recoveries.groupBy(*by, F.date_trunc(period, "ts").alias("period_start")).agg(
        F.sum("amount").alias("total")
    )
    step = F.expr(f"interval 1 {period}")
    spine = totals.groupBy(*by).agg(
        F.explode(F.sequence(F.min("period_start"), F.max("period_start"), step)).alias("period_start")
    )
    # null groups are groups
    renamed = totals.select(*[F.col(c).alias(f"__{c}") for c in (*by, "period_start", "total")])
    same = F.col("period_start") == F.col("__period_start")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
    # at most one row per group and period
    along = Window.partitionBy(*by).orderBy("period_start")
    return (
        spine.join(renamed, same, "left")
        .withColumn("total", F.coalesce("__total", F.lit(0)).cast(TOTAL))
        .select(*by, "period_start", "total")
        .withColumn("change", (F.col("total") - F.lag("total").over(along)).cast(TOTAL))
    )


def ledger_diff(prev: DataFrame, curr: DataFrame, key: Sequence[str]) -> DataFrame:
    """Entries added, removed or changed from one snapshot to the next.

    Rows present in both snapshots cancel out in one aggregation, partly on the map
    side; only what remains is compared by key. A key that a snapshot holds in two different rows stops
    the query.
    """
    values = [c for c in curr.columns if c not in key]
    tagged = prev.withColumn("__in", F.lit(-1)).unionByName(curr.withColumn("__in", F.lit(1)))
    left = tagged.groupBy(*key, *values).agg(F.sum("__in").alias("__in")).where(F.col("__in") != 0)
    sides = left.groupBy(*key).agg(
        F.count_if(F.col("__in") < 0).alias("__before"),
        F.count_if(F.col("__in") > 0).alias("__after"),
        *[F.max(F.when(F.col("__in") < 0, F.col(c))).alias(f"prev_{c}") for c in values],
        *[F.max(F.when(F.col("__in") > 0, F.col(c))).alias(f"curr_{c}") for c in values],
    )
    twice = F.concat(F.lit("key in more than one row: "), F.to_json(F.struct(*key)))
    status = (
        F.when((F.col("__before") > 1) | (F.col("__after") > 1), F.raise_error(twice).cast("string"))
        .when(F.col("__before") == 0, "added").when(F.col("__after") == 0, "removed").otherwise("changed")
    )
    return sides.withColumn("status", status).drop("__before", "__after")


def _accepted(entries: DataFrame) -> DataFrame:
    """Entries with a positive amount; a negative amount stops the query."""
    message = F.concat(F.lit("negative amount in entry "), F.col("entry_id").cast("string"))
    amount = F.when(F.col("amount") < 0, F.raise_error(message).cast(MONEY)).otherwise(F.col("amount"))
    return entries.withColumn("amount", amount).where(F.col("amount") != 0)


def _end_points(entries: DataFrame, kind: str) -> DataFrame:
    """Where each entry ends when a party's entries are laid end to end, oldest first."""
    summed = (
        OrderedGroups(_accepted(entries), ["party"], ["ts", "entry_id"]).running_sum(end="amount").result()
    )
    return summed.select(
        "party",
        F.col("end").cast(TOTAL).alias("end"),
        "amount",
        F.lit(kind).alias("kind"),
        F.struct("entry_id", "ts").alias(kind),
    )


def _entries(entries: DataFrame, kind: str, signed: Column) -> DataFrame:
    return entries.select("party", "entry_id", "ts", F.lit(kind).alias("kind"), signed.cast(MONEY).alias("signed"))


def _cohort(ts: str, step: str) -> Column:
    return F.date_trunc(step, ts).alias("cohort")


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole))
