"""Recovery queries: error events are obligations, purchase events are recoveries."""

from pyspark.sql import functions as F

from claimtrace.functions import dollars
from claimtrace.operators import recovery
from claimtrace.queries.anomaly import LINES, line_variance
from claimtrace.sources import case_events, obligations, recoveries, table

# inside the span of the entries, so that some come after it
AGED_AT = "2024-01-22"


def _sides(spark, path):
    events = case_events(spark, path)
    return obligations(events), recoveries(events)


def _regions(spark, path):
    """Customer to nation and region."""
    return (
        table(spark, path, "customer")
        .join(table(spark, path, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, path, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("c_custkey").alias("party"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    )


def overpayments(spark, path):
    totals = recovery.overpayments(line_variance(spark, path), ["provider"])
    return totals.withColumn("overpaid", dollars("overpaid"))


def recovery_ledger(spark, path):
    ledger = recovery.recovery_ledger(*_sides(spark, path))
    return ledger.select(
        "party", "entry_id", "ts", "kind", dollars("signed").alias("signed"), dollars("balance").alias("balance")
    )


def fifo_allocate(spark, path):
    paid = recovery.fifo_allocate(*_sides(spark, path))
    return paid.select("party", "obligation_id", "recovery_id", dollars("amount").alias("amount"))


def outstanding_aging(spark, path):
    aged = recovery.outstanding_aging(*_sides(spark, path), AGED_AT, [7, 14])
    return aged.withColumn("unpaid", dollars("unpaid"))


def reconcile(spark, path):
    parties = recovery.reconcile(*_sides(spark, path))
    return parties.select("party", dollars("owed").alias("owed"), dollars("paid").alias("paid"), "status")


def _identified_and_recovered(spark, path):
    owed, paid = _sides(spark, path)
    zero = F.lit(0).cast("decimal(18,2)")
    rows = owed.select("party", F.col("amount").alias("identified"), zero.alias("recovered")).unionByName(
        paid.select("party", zero.alias("identified"), F.col("amount").alias("recovered"))
    )
    return rows.join(_regions(spark, path), "party")


def _rollup(rows, hierarchy, cube):
    totals = recovery.recovery_rollup(rows, hierarchy, cube)
    return totals.withColumns({c: dollars(c) for c in ("identified", "recovered")})


def recovery_rollup(spark, path):
    return _rollup(_identified_and_recovered(spark, path), ["region", "nation"], False)


def recovery_cube(spark, path):
    events = case_events(spark, path)
    half = F.when(F.dayofmonth("ts") <= 15, "first").otherwise("second")
    zero = F.lit(0).cast("decimal(18,2)")
    demanded, paid = F.col("state") == "error", F.col("state") == "purchase"
    rows = (
        events.where(demanded | paid)
        .select(
            F.col("case_id").alias("party"),
            half.alias("half"),
            F.when(demanded, F.col("amount")).otherwise(zero).alias("identified"),
            F.when(paid, F.col("amount")).otherwise(zero).alias("recovered"),
        )
        .join(_regions(spark, path), "party")
    )
    return _rollup(rows, ["region", "half"], True)


def recovery_vintage(spark, path):
    owed, paid = _sides(spark, path)
    vintages = recovery.recovery_vintage(recovery.fifo_allocate(owed, paid), owed, "week")
    return vintages.select(
        F.col("cohort").cast("timestamp_ntz").alias("cohort"),
        "step",
        dollars("recovered").alias("recovered"),
        dollars("recovered_to_date").alias("recovered_to_date"),
        dollars("identified").alias("identified"),
        "share",
    )


def recovery_funnel(spark, path):
    events = case_events(spark, path).withColumn("day", F.to_date("ts"))
    return recovery.recovery_funnel(events, ["case_id"], ["day"], "error", "purchase")


def recovery_trend(spark, path):
    _, paid = _sides(spark, path)
    by_nation = paid.join(_regions(spark, path), "party")
    trend = recovery.recovery_trend(by_nation, "day", ["nation"])
    return trend.select(
        "nation",
        F.col("period_start").cast("timestamp_ntz").alias("period_start"),
        dollars("total").alias("total"),
        dollars("change").alias("change"),
    )


def ledger_diff(spark, path):
    """Weekly totals per case and state, as seen on 20 January and over the 20 days up to the 30th."""
    weekly = case_events(spark, path).withColumn("week", F.to_date(F.date_trunc("week", "ts")))

    def snapshot(rows):
        return rows.groupBy("case_id", "state", "week").agg(
            F.count(F.lit(1)).alias("n"), F.sum("amount").cast("decimal(18,2)").alias("amount")
        )

    prev = snapshot(weekly.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz")))
    curr = snapshot(weekly.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")))
    diff = recovery.ledger_diff(prev, curr, ["case_id", "state", "week"])
    return diff.withColumns({c: dollars(c) for c in ("prev_amount", "curr_amount")})


QUERIES = {
    "overpayments": overpayments,
    "recovery_ledger": recovery_ledger,
    "fifo_allocate": fifo_allocate,
    "outstanding_aging": outstanding_aging,
    "reconcile": reconcile,
    "recovery_rollup": recovery_rollup,
    "recovery_cube": recovery_cube,
    "recovery_vintage": recovery_vintage,
    "recovery_funnel": recovery_funnel,
    "recovery_trend": recovery_trend,
    "ledger_diff": ledger_diff,
}

SIDES = """
owed AS (
  SELECT user_id AS party, event_id AS entry_id, ts, CAST(value AS DECIMAL(18,2)) AS amount
  FROM events WHERE event_type = 'error'
),
paid AS (
  SELECT user_id AS party, event_id AS entry_id, ts, CAST(value AS DECIMAL(18,2)) AS amount
  FROM events WHERE event_type = 'purchase'
)"""

ALLOCATED = """
owed_to AS (
  SELECT *, sum(amount) OVER (PARTITION BY party ORDER BY ts, entry_id) AS hi FROM owed
),
paid_to AS (
  SELECT *, sum(amount) OVER (PARTITION BY party ORDER BY ts, entry_id) AS hi FROM paid
),
allocated AS (
  SELECT o.party, o.entry_id AS obligation_id, o.ts AS obligation_ts, p.entry_id AS recovery_id,
         p.ts AS recovery_ts,
         least(o.hi, p.hi) - greatest(o.hi - o.amount, p.hi - p.amount) AS amount
  FROM owed_to o JOIN paid_to p
    ON o.party = p.party AND o.hi - o.amount < p.hi AND p.hi - p.amount < o.hi
  WHERE o.amount > 0 AND p.amount > 0
)"""

PLACES = """
places AS (
  SELECT c_custkey AS party, r_name AS region, n_name AS nation
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

ORACLES = {
    "overpayments": f"""
WITH {LINES}, rates AS (
  SELECT p_partkey AS code, CAST(p_retailprice AS DECIMAL(12,2)) AS rate FROM part
), variance AS (
  SELECT provider, paid - CAST(units AS DECIMAL(4,0)) * rate AS v
  FROM lines JOIN rates USING (code)
  WHERE service_date >= DATE '1995-01-01' AND service_date < DATE '2001-01-01'
)
SELECT provider, CAST(sum(v) AS DOUBLE) AS overpaid, count(*) AS n_lines
FROM variance WHERE v > 0 GROUP BY provider""",
    "recovery_ledger": f"""
WITH {SIDES}, entries AS (
  SELECT party, entry_id, ts, 'obligation' AS kind, amount AS signed FROM owed
  UNION ALL SELECT party, entry_id, ts, 'recovery', -amount FROM paid
)
SELECT party, entry_id, ts, kind, CAST(signed AS DOUBLE) AS signed,
       CAST(sum(signed) OVER (PARTITION BY party ORDER BY ts, entry_id, kind
            ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance
FROM entries""",
    "fifo_allocate": f"""
WITH {SIDES}, {ALLOCATED}
SELECT party, obligation_id, recovery_id, CAST(amount AS DOUBLE) AS amount FROM allocated""",
    "outstanding_aging": f"""
WITH {SIDES.replace("event_type =", f"CAST(ts AS DATE) <= DATE '{AGED_AT}' AND event_type =")}, {ALLOCATED}, open_items AS (
  SELECT o.ts, o.amount - coalesce(sum(a.amount), 0) AS unpaid
  FROM owed o LEFT JOIN allocated a ON a.party = o.party AND a.obligation_id = o.entry_id
  GROUP BY o.party, o.entry_id, o.ts, o.amount
), aged AS (
  SELECT *, date_diff('day', CAST(ts AS DATE), DATE '{AGED_AT}') AS age FROM open_items WHERE unpaid > 0
)
SELECT CASE WHEN age <= 7 THEN '0-7' WHEN age <= 14 THEN '8-14' ELSE '15+' END AS bucket,
       count(*) AS n_open, CAST(sum(unpaid) AS DOUBLE) AS unpaid
FROM aged GROUP BY 1""",
    "reconcile": f"""
WITH {SIDES}, o AS (SELECT party, sum(amount) AS owed FROM owed GROUP BY party),
p AS (SELECT party, sum(amount) AS paid FROM paid GROUP BY party)
SELECT party, CAST(owed AS DOUBLE) AS owed, CAST(paid AS DOUBLE) AS paid,
       CASE WHEN paid IS NULL THEN 'unmatched_obligation' WHEN owed IS NULL THEN 'unmatched_recovery'
            WHEN owed = paid THEN 'settled' WHEN owed > paid THEN 'short' ELSE 'over_recovered' END AS status
FROM o FULL JOIN p USING (party)""",
    "recovery_rollup": f"""
WITH {SIDES}, {PLACES}, rows AS (
  SELECT party, amount AS identified, 0 AS recovered FROM owed
  UNION ALL SELECT party, 0, amount FROM paid
), totals AS (
  SELECT region, nation, CAST(grouping(region, nation) AS INTEGER) AS level,
         CAST(sum(identified) AS DOUBLE) AS identified, CAST(sum(recovered) AS DOUBLE) AS recovered
  FROM rows JOIN places USING (party) GROUP BY ROLLUP (region, nation)
)
SELECT *, CASE WHEN identified <> 0 THEN recovered / identified END AS rate FROM totals""",
    "recovery_cube": f"""
WITH {PLACES}, rows AS (
  SELECT user_id AS party, CASE WHEN day(ts) <= 15 THEN 'first' ELSE 'second' END AS half,
         CASE WHEN event_type = 'error' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END AS identified,
         CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END AS recovered
  FROM events WHERE event_type IN ('error', 'purchase')
), totals AS (
  SELECT region, half, CAST(grouping(region, half) AS INTEGER) AS level,
         CAST(sum(identified) AS DOUBLE) AS identified, CAST(sum(recovered) AS DOUBLE) AS recovered
  FROM rows JOIN places USING (party) GROUP BY CUBE (region, half)
)
SELECT *, CASE WHEN identified <> 0 THEN recovered / identified END AS rate FROM totals""",
    "recovery_vintage": f"""
WITH {SIDES}, {ALLOCATED}, steps AS (
  SELECT date_trunc('week', obligation_ts) AS cohort,
         greatest(date_diff('day', CAST(date_trunc('week', obligation_ts) AS DATE),
                            CAST(date_trunc('week', recovery_ts) AS DATE)) // 7, 0) AS step,
         sum(amount) AS recovered
  FROM allocated GROUP BY ALL
), identified AS (
  SELECT date_trunc('week', ts) AS cohort, sum(amount) AS identified FROM owed GROUP BY ALL
), running AS (
  SELECT *, sum(recovered) OVER (PARTITION BY cohort ORDER BY step) AS recovered_to_date FROM steps
)
SELECT CAST(cohort AS TIMESTAMP) AS cohort, CAST(step AS INTEGER) AS step,
       CAST(recovered AS DOUBLE) AS recovered,
       CAST(recovered_to_date AS DOUBLE) AS recovered_to_date, CAST(identified AS DOUBLE) AS identified,
       CAST(recovered_to_date AS DOUBLE) / CAST(identified AS DOUBLE) AS share
FROM running JOIN identified USING (cohort)""",
    "recovery_funnel": """
WITH units AS (
  SELECT CAST(ts AS DATE) AS day, user_id,
         min(CASE WHEN event_type = 'error' THEN ts END) AS first_demand,
         max(CASE WHEN event_type = 'purchase' THEN ts END) AS last_recovery
  FROM events GROUP BY ALL
), counts AS (
  SELECT day, count(*) AS identified, count(first_demand) AS demanded,
         count(*) FILTER (WHERE last_recovery > first_demand) AS recovered
  FROM units GROUP BY day
)
SELECT *, CASE WHEN identified > 0 THEN demanded / identified END AS demand_rate,
       CASE WHEN demanded > 0 THEN recovered / demanded END AS recovery_rate
FROM counts""",
    "recovery_trend": f"""
WITH {SIDES}, {PLACES}, totals AS (
  SELECT nation, date_trunc('day', ts) AS period_start, sum(amount) AS total
  FROM paid JOIN places USING (party) GROUP BY ALL
), spine AS (
  SELECT nation, unnest(generate_series(CAST(min(period_start) AS TIMESTAMP),
         CAST(max(period_start) AS TIMESTAMP), INTERVAL 1 DAY)) AS period_start
  FROM totals GROUP BY nation
), filled AS (
  SELECT s.nation, s.period_start, coalesce(total, 0) AS total
  FROM spine s LEFT JOIN totals t ON s.nation = t.nation AND s.period_start = t.period_start
)
SELECT nation, period_start, CAST(total AS DOUBLE) AS total,
       CAST(total - lag(total) OVER (PARTITION BY nation ORDER BY period_start) AS DOUBLE) AS change
FROM filled""",
    "ledger_diff": """
WITH weekly AS (
  SELECT user_id AS case_id, event_type AS state, CAST(date_trunc('week', ts) AS DATE) AS week, ts,
         CAST(value AS DECIMAL(18,2)) AS amount
  FROM events
), prev AS (
  SELECT case_id, state, week, count(*) AS n, sum(amount) AS amount
  FROM weekly WHERE ts < TIMESTAMP '2024-01-20' GROUP BY ALL
), curr AS (
  SELECT case_id, state, week, count(*) AS n, sum(amount) AS amount
  FROM weekly WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL
)
SELECT case_id, state, week, p.n AS prev_n, c.n AS curr_n, CAST(p.amount AS DOUBLE) AS prev_amount,
       CAST(c.amount AS DOUBLE) AS curr_amount,
       CASE WHEN p.n IS NULL THEN 'added' WHEN c.n IS NULL THEN 'removed' ELSE 'changed' END AS status
FROM prev p FULL JOIN curr c USING (case_id, state, week)
WHERE p.n IS DISTINCT FROM c.n OR p.amount IS DISTINCT FROM c.amount""",
}
