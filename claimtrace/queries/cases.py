"""Case queries: a user is a case, the type of an event is the state it leads to."""

from pyspark.sql import functions as F

from claimtrace.functions import dollars
from claimtrace.operators import anomaly, cases, recovery
from claimtrace.queries.anomaly import LINES, ROBUST, line_variance, unit_prices
from claimtrace.sources import LINE_KEY, case_events, table, written

# The workflow of the fixture: fixed states and transitions
STATES = ["signup", "view", "click", "error", "purchase"]
CLOSED = "purchase"
ALLOWED = [
    ("signup", "view"),
    ("view", "click"),
    ("click", "view"),
    ("view", "error"),
    ("click", "error"),
    ("error", "purchase"),
    ("purchase", "signup"),
]
SLA_HOURS = {"signup": 24, "view": 12, "click": 6, "error": 48}
AS_OF = "2024-01-31 00:00:00"
MID_MONTH = "2024-01-15 00:00:00"


def _with_nation(spark, path, rows, case="case_id"):
    customers = table(spark, path, "customer").select(F.col("c_custkey").alias(case), F.col("c_nationkey").alias("nation"))
    return rows.join(customers, case)


def build_cases(spark, path):
    built = cases.build_cases(case_events(spark, path), "case_id", "ts", "6 hours", "amount", ["event_id"])
    return built.withColumn("amount", dollars("amount"))


def current_case_state(spark, path):
    return cases.current_case_state(case_events(spark, path)).withColumn("amount", dollars("amount"))


def state_intervals(spark, path):
    return cases.state_intervals(case_events(spark, path)).select(
        "case_id", "event_id", "state", "valid_from", "valid_to", "next_state", "dwell_us"
    )


def invalid_transitions(spark, path):
    return cases.invalid_transitions(case_events(spark, path), ALLOWED).select(
        "case_id", "event_id", "state", "next_state"
    )


def case_state_asof(spark, path):
    """What state was each case in one hour before each request for information?"""
    events = case_events(spark, path)
    probes = events.where(F.col("state") == "click").select(
        "case_id", F.col("event_id").alias("probe_id"), (F.col("ts") - F.expr("interval 1 hour")).alias("ts")
    )
    return cases.case_state_asof(probes, events)


def case_backlog_daily(spark, path):
    return cases.case_backlog_daily(_with_nation(spark, path, case_events(spark, path)), "nation", CLOSED)


def sla_breaches(spark, path):
    return cases.sla_breaches(case_events(spark, path), SLA_HOURS, AS_OF).select(
        "case_id", "event_id", "state", "limit_hours", "held_us", "is_open"
    )


def worklist_topk(spark, path):
    built = cases.build_cases(case_events(spark, path), "case_id", "ts", "6 hours", "amount", ["event_id"])
    worklist = cases.worklist_topk(
        _with_nation(spark, path, built), "nation", ["amount"], ["case_id", "case_no"], 10
    )
    return worklist.select("nation", "case_id", "case_no", "n_flags", dollars("amount").alias("amount"), "rank")


def case_summary(spark, path):
    pages = cases.case_summary(case_events(spark, path), page_size=20)
    high = F.size(F.filter("timeline", lambda entry: entry["amount"] >= 100))
    return pages.select(
        "case_id", "page", "n_events", dollars("total").alias("total"), "first_ts", "last_ts", "path",
        high.alias("n_high"),
    )


def case_status_pivot(spark, path):
    current = cases.current_case_state(case_events(spark, path))
    return cases.case_status_pivot(_with_nation(spark, path, current), "nation", STATES)


def case_upsert(spark, path):
    """States at mid-month brought up to date; a new signup withdraws the case."""
    events = case_events(spark, path).select(
        "case_id", "state", "amount", F.col("ts").alias("version"), "event_id"
    )
    split = F.lit(MID_MONTH).cast("timestamp_ntz")
    newest = F.max_by(F.struct("state", "amount", "version"), F.struct("version", "event_id")).alias("row")
    current = events.where(F.col("version") < split).groupBy("case_id").agg(newest).select("case_id", "row.*")
    changes = events.where(F.col("version") >= split).withColumn("deleted", F.col("state") == "signup")
    merged = cases.case_upsert(current, changes, ["case_id"], "version", "event_id", "deleted")
    return merged.withColumn("amount", dollars("amount"))


def event_props(spark, path):
    return cases.event_props(case_events(spark, path), ["case_id"]).drop("n_other")


def integrity_flow(spark, path):
    """From flagged prices to a work list: lines, cases per provider, overpaid amount, top cases."""
    flags = anomaly.peer_robust_zscore(unit_prices(spark, path), "unit_price", ["code"], 3.5)
    priced = line_variance(spark, path).select(*LINE_KEY, "variance")
    flags = written(flags.select(*LINE_KEY).join(priced, LINE_KEY), "flags")
    in_cases = written(
        cases.assign_cases(flags, "provider", "service_date", "14 days", LINE_KEY), "flags-in-cases"
    )
    sizes = in_cases.groupBy("provider", "case_no").agg(F.count(F.lit(1)).alias("n_flags"))
    overpaid = recovery.overpayments(in_cases, ["provider", "case_no"]).drop("n_lines")
    ranked = cases.worklist_topk(
        sizes.join(overpaid, ["provider", "case_no"]), "provider", ["overpaid"], ["case_no"], 5
    )
    return ranked.withColumn("overpaid", dollars("overpaid"))


QUERIES = {
    "build_cases": build_cases,
    "current_case_state": current_case_state,
    "state_intervals": state_intervals,
    "invalid_transitions": invalid_transitions,
    "case_state_asof": case_state_asof,
    "case_backlog_daily": case_backlog_daily,
    "sla_breaches": sla_breaches,
    "worklist_topk": worklist_topk,
    "case_summary": case_summary,
    "case_status_pivot": case_status_pivot,
    "case_upsert": case_upsert,
    "event_props": event_props,
    "integrity_flow": integrity_flow,
}

EVENTS = """
ev AS (
  SELECT user_id AS case_id, event_id, ts, event_type AS state, CAST(value AS DECIMAL(18,2)) AS amount, props
  FROM events
)"""

CASES = """
marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts
  FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)
),
numbered AS (
  SELECT *, sum(starts) OVER (PARTITION BY case_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS case_no
  FROM marked
),
cases AS (
  SELECT case_id, CAST(case_no AS BIGINT) AS case_no, min(ts) AS first_ts, max(ts) AS last_ts,
         max(ts) + INTERVAL 6 HOUR AS case_end, count(*) AS n_flags, sum(amount) AS amount
  FROM numbered GROUP BY ALL
)"""

INTERVALS = """
steps AS (
  SELECT case_id, event_id, state, ts AS valid_from, lead(ts) OVER w AS valid_to,
         lead(state) OVER w AS next_state
  FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY ts, event_id)
)"""

NATIONS = "nations AS (SELECT c_custkey AS case_id, c_nationkey AS nation FROM customer)"

ORACLES = {
    "build_cases": f"""
WITH {EVENTS}, {CASES}
SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM cases""",
    "current_case_state": f"""
WITH {EVENTS}
SELECT case_id, arg_max(state, ts) AS state, max(ts) AS since, count(*) AS n_events,
       CAST(sum(amount) AS DOUBLE) AS amount
FROM ev GROUP BY case_id""",
    "state_intervals": f"""
WITH {EVENTS}, {INTERVALS}
SELECT *, epoch_us(valid_to) - epoch_us(valid_from) AS dwell_us FROM steps""",
    "invalid_transitions": f"""
WITH {EVENTS}, {INTERVALS}, allowed(state, next_state) AS (VALUES {", ".join(str(p) for p in ALLOWED)})
SELECT case_id, event_id, s.state, s.next_state
FROM steps s LEFT JOIN allowed a ON s.state = a.state AND s.next_state = a.next_state
WHERE s.next_state IS NOT NULL AND a.state IS NULL""",
    "case_state_asof": f"""
WITH {EVENTS}, probes AS (
  SELECT case_id, event_id AS probe_id, ts - INTERVAL 1 HOUR AS ts FROM ev WHERE state = 'click'
)
SELECT p.case_id, p.probe_id, p.ts, e.state
FROM probes p ASOF LEFT JOIN ev e ON p.case_id = e.case_id AND p.ts >= e.ts""",
    "case_backlog_daily": f"""
WITH {EVENTS}, {NATIONS}, days AS (
  SELECT CAST(unnest(generate_series(min(CAST(ts AS DATE)), max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS DATE) AS day
  FROM ev
), at_end AS (
  SELECT day, case_id, arg_max(state, ts) AS state
  FROM days JOIN ev ON ev.ts < day + INTERVAL 1 DAY GROUP BY ALL
)
SELECT nation, day, count(*) FILTER (WHERE state <> '{CLOSED}') AS n_open
FROM at_end JOIN nations USING (case_id) GROUP BY ALL""",
    "sla_breaches": f"""
WITH {EVENTS}, {INTERVALS}, limits(state, limit_hours) AS (
  VALUES {", ".join(f"('{s}', {float(h)}::DOUBLE)" for s, h in SLA_HOURS.items())}
)
SELECT case_id, event_id, state, limit_hours,
       epoch_us(coalesce(valid_to, TIMESTAMP '{AS_OF}')) - epoch_us(valid_from) AS held_us,
       valid_to IS NULL AS is_open
FROM steps JOIN limits USING (state)
WHERE epoch_us(coalesce(valid_to, TIMESTAMP '{AS_OF}')) - epoch_us(valid_from) > limit_hours * 3600000000""",
    "worklist_topk": f"""
WITH {EVENTS}, {CASES}, {NATIONS}, ranked AS (
  SELECT nation, case_id, case_no, n_flags, CAST(amount AS DOUBLE) AS amount,
         CAST(row_number() OVER (PARTITION BY nation ORDER BY cases.amount DESC, case_id, case_no) AS INTEGER) AS rank
  FROM cases JOIN nations USING (case_id)
)
SELECT * FROM ranked WHERE rank <= 10""",
    "case_summary": f"""
WITH {EVENTS}, numbered AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id) - 1) // 20 AS INTEGER) AS page
  FROM ev
), pages AS (
  SELECT case_id, page, string_agg(state, '>' ORDER BY ts, event_id) AS path,
         CAST(count(*) FILTER (WHERE amount >= 100) AS INTEGER) AS n_high
  FROM numbered GROUP BY ALL
), totals AS (
  SELECT case_id, count(*) AS n_events, CAST(sum(amount) AS DOUBLE) AS total, min(ts) AS first_ts,
         max(ts) AS last_ts
  FROM ev GROUP BY case_id
)
SELECT * FROM pages JOIN totals USING (case_id)""",
    "case_status_pivot": f"""
WITH {EVENTS}, {NATIONS}, latest AS (
  SELECT case_id, arg_max(state, ts) AS state FROM ev GROUP BY case_id
)
SELECT nation, {", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in STATES)}
FROM latest JOIN nations USING (case_id) GROUP BY nation""",
    "case_upsert": f"""
WITH {EVENTS}, latest AS (
  SELECT case_id, arg_max(state, ts) AS state, CAST(arg_max(amount, ts) AS DOUBLE) AS amount, max(ts) AS version
  FROM ev GROUP BY case_id
)
SELECT * FROM latest WHERE NOT (state = 'signup' AND version >= TIMESTAMP '{MID_MONTH}')""",
    "event_props": f"""
WITH {EVENTS}
SELECT case_id, 'k' AS prop, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n
FROM ev GROUP BY case_id""",
    "integrity_flow": f"""
WITH {LINES}, {ROBUST}, priced AS (
  SELECT r.*, CASE WHEN service_date >= DATE '1995-01-01' AND service_date < DATE '2001-01-01'
    THEN paid - CAST(units AS DECIMAL(4,0)) * CAST(p_retailprice AS DECIMAL(12,2)) END AS variance
  FROM robust r JOIN part ON p_partkey = code
), marked AS (
  SELECT *, CASE WHEN service_date - lag(service_date) OVER w <= INTERVAL 14 DAY THEN 0 ELSE 1 END AS starts
  FROM priced WINDOW w AS (PARTITION BY provider ORDER BY service_date, order_id, line_no, code)
), numbered AS (
  SELECT *, CAST(sum(starts) OVER (PARTITION BY provider ORDER BY service_date, order_id, line_no, code
                              ROWS UNBOUNDED PRECEDING) AS BIGINT) AS case_no
  FROM marked
), sums AS (
  SELECT provider, case_no, count(*) AS n_flags, sum(variance) FILTER (WHERE variance > 0) AS overpaid
  FROM numbered GROUP BY ALL HAVING count(*) FILTER (WHERE variance > 0) > 0
), ranked AS (
  SELECT provider, case_no, n_flags, CAST(overpaid AS DOUBLE) AS overpaid,
         CAST(row_number() OVER (PARTITION BY provider ORDER BY sums.overpaid DESC, case_no) AS INTEGER) AS rank
  FROM sums
)
SELECT * FROM ranked WHERE rank <= 5""",
}
