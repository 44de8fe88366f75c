"""Streaming queries: the events read as a stream, up to the last closed window."""

from datetime import timedelta
from functools import wraps

from pyspark.sql import functions as F

from claimtrace.functions import dollars
from claimtrace.queries.cases import CASES, EVENTS
from claimtrace.queries.recovery import SIDES
from claimtrace.sources import case_events, obligations, recoveries, scratch_path, stream_events
from claimtrace.streaming import alerts, cases, ledger, matching, recovery
from claimtrace.streaming.run import LOCAL_SESSIONS, ROCKSDB, run_to_table, session_settings

DELAY = "1 hour"
STALE = timedelta(days=1)


def _settings(settings):
    """Runs a query with session settings, one state partition per core, and times read as UTC."""

    def wrap(query):
        @wraps(query)
        def run(spark, path):
            common = {
                "spark.sql.session.timeZone": "UTC",
                "spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism),
            }
            with session_settings(spark, {**common, **settings}):
                return query(spark, path)

        return run

    return wrap


def _events(spark, path):
    return stream_events(spark, path, "events.parquet")


def _plain(df):
    """Times without zone, and money as doubles, as in the batch queries."""
    return df.withColumns(
        {
            name: F.col(name).cast("timestamp_ntz") if kind == "timestamp" else dollars(name)
            for name, kind in df.dtypes
            if kind == "timestamp" or kind.startswith("decimal")
        }
    )


@_settings({})
def stream_alerts(spark, path):
    x = F.col("amount").cast("double")
    baseline = case_events(spark, path).groupBy("case_id").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("dev"))
    alerted = alerts.stream_alerts(_events(spark, path), baseline, ["case_id"], "amount", 2.0, salts=2)
    return _plain(run_to_table(alerted.drop("props"), "alerts"))


@_settings(ROCKSDB)
def stream_case_state(spark, path):
    """The latest row of the log per case."""
    log = run_to_table(cases.stream_case_state(_events(spark, path), DELAY, STALE), "case-state")
    latest = F.struct(*[c for c in log.columns if c != "case_id"])
    current = log.groupBy("case_id").agg(F.max_by(latest, F.struct("observed_at", "stale")).alias("row"))
    return _plain(current.select("case_id", "row.state", "row.since", "row.n_events", "row.amount_cents", "row.stale"))


@_settings(ROCKSDB)
def stream_case_state_resumed(spark, path):
    """A batch over the first half of the month hands its cases to a stream over the rest; then what that holds."""
    middle = F.lit("2024-01-16").cast("timestamp")
    before = case_events(spark, path).withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("ts") < middle)
    later = _events(spark, path).where(F.col("ts") >= middle)
    checkpoint = scratch_path(spark, "resumed-state")
    log = cases.stream_case_state(later, DELAY, STALE, initial=cases.case_totals(before))
    run_to_table(log, "case-state", checkpoint)
    held = cases.held_case_state(spark, checkpoint)
    return _plain(held.select("case_id", "state", F.col("ts").alias("since"), "n_events", "amount_cents"))


@_settings(LOCAL_SESSIONS)
def stream_build_cases(spark, path):
    return _plain(run_to_table(cases.stream_build_cases(_events(spark, path), "6 hours", DELAY), "cases"))


@_settings({})
def stream_event_counts(spark, path):
    counts = cases.stream_event_counts(_events(spark, path), ["state"], "1 day", DELAY)
    return _plain(run_to_table(counts, "event-counts"))


@_settings({})
def stream_event_counts_sliding(spark, path):
    counts = cases.stream_event_counts(_events(spark, path), ["state"], "1 day", DELAY, "6 hours")
    return _plain(run_to_table(counts, "event-counts-sliding"))


@_settings({})
def stream_dedup(spark, path):
    """Every event is delivered twice."""
    delivered = _events(spark, path).union(_events(spark, path))
    unique = cases.stream_dedup(delivered, ["event_id"], "2 days", salts=4)
    return _plain(run_to_table(unique.drop("props"), "unique-events"))


@_settings({})
def stream_recovery_match(spark, path):
    matched = recovery.stream_recovery_match(
        obligations(_events(spark, path)), recoveries(_events(spark, path)), 2, DELAY
    )
    return _plain(run_to_table(matched, "recovery-match"))


@_settings(ROCKSDB)
def stream_entry_match(spark, path):
    """Which recovery paid which demand, for entries the watermark has passed."""
    return _plain(run_to_table(matching.stream_entry_match(_signed_entries(spark, path), DELAY), "entry-match"))


def _signed_entries(spark, path):
    events = _events(spark, path)
    signed = F.when(F.col("state") == "error", F.col("amount")).otherwise(-F.col("amount"))
    return events.where(F.col("state").isin("error", "purchase")).select(
        F.col("case_id").alias("party"), F.col("event_id").alias("entry_id"), "ts",
        signed.cast("decimal(18,2)").alias("signed"),
    )


@_settings({})
def stream_ledger_two_runs(spark, path):
    """Three calls on one ledger: even entries, odd entries, even entries once more."""
    entries = _signed_entries(spark, path)
    where = scratch_path(spark, "ledger")
    for remainder in (0, 1, 0):
        ledger.stream_ledger_upsert(entries.where(F.col("entry_id") % 2 == remainder), where)
    return _plain(ledger.ledger_balances(spark, where))


@_settings({})
def stream_ledger_upsert(spark, path):
    """Every entry is delivered twice."""

    def entries():
        return _signed_entries(spark, path)

    where = scratch_path(spark, "ledger")
    ledger.stream_ledger_upsert(entries().union(entries()), where)
    return _plain(ledger.ledger_balances(spark, where))


@_settings({})
def stream_ledger_versions(spark, path):
    """First deliveries, corrections and deletions, then the first deliveries once more; one entry in five has no id.

    Entries without an id cannot be told from their copies, so they come the first time only.
    """
    entries = _signed_entries(spark, path)
    number = F.col("entry_id")
    first = entries.withColumns({"version": F.lit(1), "gone": F.lit(False)})
    amount = (F.col("signed") * 2).cast("decimal(18,2)")
    second = entries.where((number % 3 == 0) & (number % 5 != 0)).withColumns({"signed": amount, "version": F.lit(2), "gone": number % 7 == 0})
    unnamed = first.withColumn("entry_id", F.when(number % 5 != 0, number))
    where = scratch_path(spark, "ledger")
    for rows in (unnamed, second, first.where(number % 5 != 0)):
        ledger.stream_ledger_upsert(rows, where, version="version", deleted="gone")
    ledger.compact_ledger(spark, where)
    return _plain(ledger.ledger_balances(spark, where))


QUERIES = {
    "stream_alerts": stream_alerts,
    "stream_case_state": stream_case_state,
    "stream_case_state_resumed": stream_case_state_resumed,
    "stream_build_cases": stream_build_cases,
    "stream_event_counts": stream_event_counts,
    "stream_event_counts_sliding": stream_event_counts_sliding,
    "stream_dedup": stream_dedup,
    "stream_recovery_match": stream_recovery_match,
    "stream_entry_match": stream_entry_match,
    "stream_ledger_upsert": stream_ledger_upsert,
    "stream_ledger_two_runs": stream_ledger_two_runs,
    "stream_ledger_versions": stream_ledger_versions,
}

# the watermark after the last row: windows that end later are still open
CLOSED = """
closed AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS at_ts FROM events)"""

ORACLES = {
    "stream_alerts": f"""
WITH {EVENTS}, baseline AS (
  SELECT case_id, avg(CAST(amount AS DOUBLE)) AS mean, stddev_samp(CAST(amount AS DOUBLE)) AS dev
  FROM ev GROUP BY case_id
), scored AS (
  SELECT case_id, event_id, ts, state, CAST(amount AS DOUBLE) AS amount,
         CASE WHEN dev > 0 THEN round((CAST(amount AS DOUBLE) - mean) / dev, 4) END AS zscore
  FROM ev JOIN baseline USING (case_id)
)
SELECT * FROM scored WHERE abs(zscore) >= 2""",
    "stream_case_state": f"""
WITH {EVENTS}, {CLOSED}
SELECT case_id, arg_max(state, ts) AS state, max(ts) AS since, count(*) AS n_events,
       CAST(sum(amount) * 100 AS BIGINT) AS amount_cents,
       date_trunc('milliseconds', max(ts)) + INTERVAL 1 DAY <= max(at_ts) AS stale
FROM ev, closed GROUP BY case_id""",
    "stream_case_state_resumed": f"""
WITH {EVENTS}
SELECT case_id, arg_max(state, ts) AS state, max(ts) AS since, count(*) AS n_events,
       CAST(sum(amount) * 100 AS BIGINT) AS amount_cents
FROM ev GROUP BY case_id""",
    "stream_build_cases": f"""
WITH {EVENTS}, {CASES}, {CLOSED}
SELECT case_id, first_ts, last_ts, case_end, n_flags, CAST(amount AS DOUBLE) AS amount
FROM cases, closed WHERE case_end <= at_ts""",
    "stream_event_counts": f"""
WITH {EVENTS}, {CLOSED}, daily AS (
  SELECT state, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n,
         CAST(sum(amount) AS DOUBLE) AS amount
  FROM ev GROUP BY ALL
)
SELECT state, window_start, window_start + INTERVAL 1 DAY AS window_end, n, amount
FROM daily, closed WHERE window_start + INTERVAL 1 DAY <= at_ts""",
    "stream_event_counts_sliding": f"""
WITH {EVENTS}, {CLOSED}, placed AS (
  SELECT *, time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR * CAST(unnest(range(0, 4)) AS INTEGER) AS window_start
  FROM ev
), counted AS (
  SELECT state, window_start, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS amount FROM placed GROUP BY ALL
)
SELECT state, window_start, window_start + INTERVAL 1 DAY AS window_end, n, amount
FROM counted, closed WHERE window_start + INTERVAL 1 DAY <= at_ts""",
    "stream_dedup": f"""
WITH {EVENTS}
SELECT case_id, event_id, ts, state, CAST(amount AS DOUBLE) AS amount FROM ev""",
    "stream_recovery_match": f"""
WITH {SIDES}, closed AS (
  SELECT date_trunc('milliseconds', least((SELECT max(ts) FROM owed), (SELECT max(ts) FROM paid)))
         - INTERVAL 1 HOUR AS at_ts
), demanded AS (
  SELECT party, CAST(date_trunc('day', ts) AS TIMESTAMP) AS demanded_day, sum(amount) AS demanded,
         count(*) AS n_demanded
  FROM owed GROUP BY ALL
), recovered AS (
  SELECT party, CAST(date_trunc('day', ts) AS TIMESTAMP) AS recovered_day, sum(amount) AS recovered,
         count(*) AS n_recovered
  FROM paid GROUP BY ALL
)
SELECT d.party, demanded_day, recovered_day, CAST(demanded AS DOUBLE) AS demanded, n_demanded,
       CAST(recovered AS DOUBLE) AS recovered, n_recovered
FROM demanded d JOIN recovered r ON d.party = r.party
 AND recovered_day >= demanded_day AND recovered_day <= demanded_day + INTERVAL 2 DAY, closed
WHERE recovered_day + INTERVAL 1 DAY <= at_ts""",
    # a party's debt is its running sum above the lowest point so far; what fell below it paid nothing
    "stream_entry_match": f"""
WITH {SIDES}, entries AS (
  SELECT party, entry_id, ts, CAST(amount * 100 AS BIGINT) AS cents FROM owed
  UNION ALL SELECT party, entry_id, ts, -CAST(amount * 100 AS BIGINT) FROM paid
), closed AS (
  SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS at_ts FROM entries WHERE cents <> 0
), summed AS (
  SELECT *, sum(cents) OVER w AS s FROM entries, closed WHERE ts < at_ts AND cents <> 0
  WINDOW w AS (PARTITION BY party ORDER BY ts, cents < 0, entry_id ROWS UNBOUNDED PRECEDING)
), lowest AS (
  SELECT *, least(0, min(s) OVER (PARTITION BY party ORDER BY ts, cents < 0, entry_id ROWS UNBOUNDED PRECEDING)) AS low
  FROM summed
), used AS (
  SELECT *, CASE WHEN cents > 0 THEN cents
                 ELSE -cents - (coalesce(lag(low) OVER (PARTITION BY party ORDER BY ts, cents < 0, entry_id), 0) - low) END AS part
  FROM lowest
), ends AS (
  SELECT *, sum(part) OVER (PARTITION BY party, cents > 0 ORDER BY ts, entry_id ROWS UNBOUNDED PRECEDING) AS upto FROM used
)
SELECT d.party, d.entry_id AS obligation_id, r.entry_id AS recovery_id, d.ts AS demanded_at, r.ts AS recovered_at,
       CAST(least(d.upto, r.upto) - greatest(d.upto - d.part, r.upto - r.part) AS BIGINT) AS amount_cents
FROM ends d JOIN ends r ON d.party = r.party AND d.cents > 0 AND r.cents < 0 AND r.part > 0
 AND d.upto > r.upto - r.part AND r.upto > d.upto - d.part""",
    "stream_ledger_upsert": f"""
WITH {SIDES}, entries AS (
  SELECT party, amount AS signed FROM owed UNION ALL SELECT party, -amount FROM paid
)
SELECT party, CAST(sum(signed) AS DOUBLE) AS balance, count(*) AS n_entries FROM entries GROUP BY party""",
}
ORACLES["stream_ledger_two_runs"] = ORACLES["stream_ledger_upsert"]
ORACLES["stream_ledger_versions"] = f"""
WITH {SIDES}, entries AS (
  SELECT party, entry_id, amount AS signed FROM owed UNION ALL SELECT party, entry_id, -amount FROM paid
), latest AS (
  SELECT party, CASE WHEN entry_id % 3 = 0 AND entry_id % 5 <> 0 THEN 2 * signed ELSE signed END AS signed
  FROM entries WHERE NOT (entry_id % 3 = 0 AND entry_id % 5 <> 0 AND entry_id % 7 = 0)
)
SELECT party, CAST(sum(signed) AS DOUBLE) AS balance, count(*) AS n_entries FROM latest GROUP BY party"""
