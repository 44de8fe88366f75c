"""Case management: building cases from flags and following them through their states.

Case events have the columns case_id, event_id, ts, state and amount (a decimal). Events
of a case are ordered by (ts, event_id).
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from claimtrace.plans import OrderedGroups, top_k, with_group_stats

ORDER = ["ts", "event_id"]
TOTAL = "decimal(28,2)"


def assign_cases(flags: DataFrame, entity: str, ts: str, gap: str, tie: Sequence[str]) -> DataFrame:
    """Each flag with its ``case_no`` within the entity, counted from 1.

    A new case starts when more than ``gap`` has passed since the entity's previous flag.
    ``tie`` makes the order unique within one time.
    """
    rows = flags.where(F.col(ts).isNotNull())
    starts = F.col("__prev").isNull() | (F.col(ts) > F.col("__prev") + F.expr(f"interval {gap}"))
    return (
        OrderedGroups(rows, [entity], [ts, *[t for t in tie if t != ts]])
        .previous(__prev=ts)
        .with_column("__starts", starts.cast("bigint"))
        .running_sum(case_no="__starts")
        .result()
        .drop("__prev", "__starts")
    )


def build_cases(
    flags: DataFrame, entity: str, ts: str, gap: str, amount: str, tie: Sequence[str]
) -> DataFrame:
    """One row per case of ``assign_cases``; ``case_end`` is the last flag plus the gap."""
    last = F.max(ts)
    return (
        assign_cases(flags, entity, ts, gap, tie)
        .groupBy(entity, "case_no")
        .agg(
            F.min(ts).alias("first_ts"),
            last.alias("last_ts"),
            (last + F.expr(f"interval {gap}")).alias("case_end"),
            F.count(F.lit(1)).alias("n_flags"),
            F.sum(amount).cast(TOTAL).alias("amount"),
        )
    )


def current_case_state(events: DataFrame) -> DataFrame:
    """The latest state of each case."""
    latest = F.struct(*ORDER)
    return events.groupBy("case_id").agg(
        F.max_by("state", latest).alias("state"),
        F.max("ts").alias("since"),
        F.count(F.lit(1)).alias("n_events"),
        F.sum("amount").cast(TOTAL).alias("amount"),
    )


def state_intervals(events: DataFrame) -> DataFrame:
    """Each event as an interval: ``valid_to`` and ``next_state`` are null in a case's last state."""
    return (
        OrderedGroups(events, ["case_id"], ORDER)
        .following(valid_to="ts", next_state="state")
        .result()
        .withColumnRenamed("ts", "valid_from")
        .withColumn("dwell_us", _microseconds("valid_from", "valid_to"))
    )


def invalid_transitions(events: DataFrame, allowed: Sequence[tuple[str, str]]) -> DataFrame:
    """Changes of state that are not in the ``allowed`` list of (from, to) pairs."""
    steps = state_intervals(events).where(F.col("next_state").isNotNull())
    pairs = F.broadcast(
        events.sparkSession.createDataFrame(list(allowed), "state string, next_state string")
    )
    return steps.join(pairs, ["state", "next_state"], "left_anti")


def case_state_asof(probes: DataFrame, events: DataFrame) -> DataFrame:
    """The state in force at each probe (case_id, probe_id, ts), null before the first event.

    Probes and events are merged into one order per case, in which an event comes before
    a probe of the same time; the state is the last one seen. A probe without a case has none.
    """
    merged = probes.select("case_id", "ts", F.lit(1).alias("__probe"), F.col("probe_id").alias("__id")).unionByName(
        events.select("case_id", "ts", F.lit(0).alias("__probe"), F.col("event_id").alias("__id"), "state"),
        allowMissingColumns=True,
    )
    known = OrderedGroups(merged, ["case_id"], ["ts", "__probe", "__id"]).last_known(state_asof="state").result()
    return known.where(F.col("__probe") == 1).select(
        "case_id", F.col("__id").alias("probe_id"), "ts", F.when(F.col("case_id").isNotNull(), F.col("state_asof")).alias("state")
    )


def case_backlog_daily(events: DataFrame, group: str, closed: str) -> DataFrame:
    """Open cases per group at the end of each day; ``group`` is an attribute of the case.

    Each event that opens (or reopens) or closes a case changes its day's balance by one,
    so the running sum is over at most one row per day and group.
    """
    is_open = (F.col("state") != closed).cast("int")
    changes = (
        OrderedGroups(events.withColumn("__open", is_open), ["case_id"], ORDER)
        .previous(__was_open="__open")
        .result()
        .withColumn("__change", F.col("__open") - F.coalesce("__was_open", F.lit(0)))
    )
    daily = changes.groupBy(group, F.to_date("ts").alias("day")).agg(F.sum("__change").alias("__change"))
    last_day = daily.agg(F.max("day").alias("day")).scalar()
    spine = (
        daily.groupBy(group)
        .agg(F.min("day").alias("__first"))
        .select(group, F.explode(F.sequence("__first", last_day)).alias("day"))
    )
    to_date = Window.partitionBy(group).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    # the null group is a group
    changed = daily.select(F.col(group).alias("__group"), F.col("day").alias("__day"), "__change")
    same = F.col(group).eqNullSafe(F.col("__group")) & (F.col("day") == F.col("__day"))
    return spine.join(changed, same, "left").select(
        group, "day", F.sum(F.coalesce("__change", F.lit(0))).over(to_date).alias("n_open")
    )


def sla_breaches(events: DataFrame, limits: Mapping[str, float], as_of: str) -> DataFrame:
    """States held longer than their limit in hours; the last state is measured to ``as_of``."""
    hours = F.create_map(*[F.lit(v) for pair in limits.items() for v in (pair[0], float(pair[1]))])
    end = F.coalesce("valid_to", F.lit(as_of).cast("timestamp_ntz"))
    return (
        state_intervals(events.where(F.col("ts") <= F.lit(as_of).cast("timestamp_ntz")))
        .withColumn("limit_hours", F.element_at(hours, F.col("state")))
        .withColumn("held_us", _microseconds("valid_from", end))
        .withColumn("is_open", F.col("valid_to").isNull())
        .where(F.col("held_us") > F.col("limit_hours") * 3_600_000_000)
    )


def worklist_topk(
    cases: DataFrame, assignee: str, priority: Sequence[str], tie: Sequence[str], k: int
) -> DataFrame:
    """The ``k`` cases of highest priority per assignee; ``tie`` identifies a case."""
    order: list[Column] = [*[F.col(c).desc() for c in priority], *[F.col(c) for c in tie]]
    return top_k(cases, [assignee], order, k)


def case_summary(events: DataFrame, page_size: int = 1_000) -> DataFrame:
    """Counts, amounts and the ordered timeline of each case.

    The timeline is an array of at most ``page_size`` entries; a longer case has further
    rows with ``page`` 1, 2, ..., so no array grows with the data.
    """
    rows = with_group_stats(
        events.select("case_id", "event_id", "ts", "state", "amount").withColumn("__one", F.lit(1)),
        ["case_id"],
        {
            "n_events": F.count(F.lit(1)),
            "total": F.sum("amount"),
            "first_ts": F.min("ts"),
            "last_ts": F.max("ts"),
        },
    )
    numbered = OrderedGroups(rows, ["case_id"], ORDER).running_sum(__row="__one").result()
    page = F.floor((F.col("__row") - 1) / page_size).cast("int").alias("page")
    pages = numbered.groupBy("case_id", page).agg(
        *[F.max(c).alias(c) for c in ("n_events", "total", "first_ts", "last_ts")],
        F.array_sort(F.collect_list(F.struct("ts", "event_id", "state", "amount"))).alias("timeline"),
    )
    return pages.withColumn(
        "path", F.array_join(F.transform("timeline", lambda entry: entry["state"]), ">")
    )


def case_status_pivot(current: DataFrame, group: str, states: Sequence[str]) -> DataFrame:
    """Cases per group with one column per state."""
    counts = current.groupBy(group).pivot("state", list(states)).agg(F.count(F.lit(1)))
    return counts.fillna(0, list(states))


def case_upsert(
    current: DataFrame, changes: DataFrame, key: Sequence[str], version: str, tie: str, deleted: str
) -> DataFrame:
    """``current`` after ``changes``: the latest version of each key wins, deletions are honoured.

    ``changes`` has the columns of ``current`` plus the flag ``deleted`` and the column
    ``tie``, which orders changes of one version. At equal versions a change wins over
    the current row.
    """
    columns = current.columns
    kept = current.select(
        *columns,
        F.lit(False).alias("__deleted"),
        F.lit(0).alias("__change"),
        F.lit(None).cast(changes.schema[tie].dataType).alias("__tie"),
    )
    arrived = changes.select(
        *columns,
        F.col(deleted).alias("__deleted"),
        F.lit(1).alias("__change"),
        F.col(tie).alias("__tie"),
    )
    order = [F.col(version).desc(), F.col("__change").desc(), F.col("__tie").desc()]
    latest = top_k(kept.unionByName(arrived), key, order, 1, "__rank")
    return latest.where(~F.col("__deleted")).select(*columns)


def event_props(events: DataFrame, by: Sequence[str]) -> DataFrame:
    """JSON properties of the events, whole numbers summed per property name.

    ``n`` counts the whole numbers, ``n_other`` the values that are none; each value counts by itself.
    """
    parsed = F.from_json("props", "map<string,string>")
    whole = F.when(F.col("value").rlike("^-?[0-9]+$"), F.expr("try_cast(value AS bigint)"))
    return (
        events.select(*by, F.explode(parsed).alias("prop", "value"))
        .groupBy(*by, "prop")
        .agg(
            F.sum(whole).alias("total"),
            F.count(whole).alias("n"),
            F.count_if(F.col("value").isNotNull() & whole.isNull()).alias("n_other"),
        )
    )


def _microseconds(start: str, end: str | Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(start), F.col(end) if isinstance(end, str) else end)
