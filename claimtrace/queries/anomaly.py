"""Anomaly queries on the claim lines."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimtrace.functions import dollars, money
from claimtrace.operators import anomaly, sketches
from claimtrace.sources import LINE_KEY, claim_lines, table, written

RATE_YEARS = (1995, 2000)

RULE_WEIGHTS = {"high_cost": 3.0, "robust": 2.5, "frequency": 1.25}


def unit_prices(spark: SparkSession, path: str) -> DataFrame:
    return claim_lines(spark, path).withColumn("unit_price", F.col("paid").cast("double") / F.col("units"))


def yearly_rates(spark: SparkSession, path: str) -> DataFrame:
    """One interval per part and year; the fixture has a price but no dates."""
    first, last = RATE_YEARS
    year = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year")
    return (
        table(spark, path, "part")
        .select(F.col("p_partkey").alias("code"), money("p_retailprice").alias("rate"), year)
        .select(
            "code",
            "rate",
            F.make_date("year", F.lit(1), F.lit(1)).alias("valid_from"),
            F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)).alias("valid_to"),
        )
    )


def line_variance(spark: SparkSession, path: str) -> DataFrame:
    return anomaly.rate_variance(claim_lines(spark, path), yearly_rates(spark, path), "code", "service_date")


def provider_totals(spark: SparkSession, path: str) -> DataFrame:
    totals = claim_lines(spark, path).groupBy("provider").agg(F.sum("paid").alias("total"))
    suppliers = table(spark, path, "supplier").select(
        F.col("s_suppkey").alias("provider"), F.col("s_nationkey").alias("nation")
    )
    return totals.join(suppliers, "provider")


def high_cost_lines(spark, path):
    lines = anomaly.high_cost_lines(claim_lines(spark, path), "paid", ["code"], 0.95)
    return lines.select(*LINE_KEY, dollars("paid").alias("paid"), F.round("threshold", 4).alias("threshold"))


def high_cost_lines_approx(spark, path):
    lines = anomaly.high_cost_lines_approx(claim_lines(spark, path), "paid", ["provider"], 0.95)
    return lines.select(*LINE_KEY, dollars("paid").alias("paid"), dollars("threshold").alias("threshold"))


def sketch_rank_error(spark, path):
    """Whether thresholds from sketches of days, merged, have the rank they should, for every provider."""
    lines, by, q = claim_lines(spark, path), ["provider"], 0.95
    days = sketches.day_sketches(lines, "paid", by, F.to_date(F.date_trunc("month", "service_date")))
    thresholds = sketches.sketch_thresholds(sketches.merged_sketches(days, by), by, q)
    errors = sketches.rank_errors(lines, thresholds, "paid", by, q)
    return errors.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("n").alias("n_lines"),
        (F.max("rank_error") <= sketches.RANK_ERROR).alias("within_bound"),
    )


def peer_zscore(spark, path):
    lines = anomaly.peer_zscore(claim_lines(spark, path), "paid", ["code"], 2.0)
    return lines.select(*LINE_KEY, dollars("paid").alias("paid"), "zscore")


def peer_robust_zscore(spark, path):
    lines = anomaly.peer_robust_zscore(unit_prices(spark, path), "unit_price", ["code"], 3.5)
    return lines.select(*LINE_KEY, "zscore")


def peer_iqr_outliers(spark, path):
    lines = anomaly.peer_iqr_outliers(unit_prices(spark, path), "unit_price", ["code"], 1.5)
    return lines.select(*LINE_KEY, "side")


def rolling_baseline(spark, path):
    lines = anomaly.rolling_baseline(claim_lines(spark, path), ["provider"], "service_date", "paid", 28)
    return lines.select(
        *LINE_KEY, dollars("prior_sum").alias("prior_sum"), "prior_count", "deviation"
    )


def rate_variance(spark, path):
    return line_variance(spark, path).select(*LINE_KEY, "status", dollars("variance").alias("variance"))


def repeat_lines(spark, path):
    lines = anomaly.repeat_lines(
        claim_lines(spark, path, member=True), ["member", "code"], "service_date", 90, LINE_KEY
    )
    return lines.select(*LINE_KEY, "member", "gap_days")


def frequency_limit(spark, path):
    return anomaly.frequency_limit(
        claim_lines(spark, path), "provider", "code", "service_date", "month", "units", 60.0
    )


def provider_peer_rank(spark, path):
    # group sizes are counted on the totals, so that the lines are read once
    totals = written(provider_totals(spark, path), "provider-totals")
    ranked = anomaly.provider_peer_rank(totals, "provider", "nation", "total")
    return ranked.withColumn("total", dollars("total"))


def risk_score(spark, path):
    lines = claim_lines(spark, path)
    frequent = anomaly.frequency_limit(lines, "provider", "code", "service_date", "month", "units", 60.0)
    over_cap = lines.withColumn("period_start", F.date_trunc("month", "service_date")).join(
        frequent.select("provider", "code", "period_start"), ["provider", "code", "period_start"], "left_semi"
    )
    flags = {
        "high_cost": anomaly.high_cost_lines(lines, "paid", ["code"], 0.95),
        "robust": anomaly.peer_robust_zscore(unit_prices(spark, path), "unit_price", ["code"], 3.5),
        "frequency": over_cap,
    }
    return anomaly.risk_score(flags, RULE_WEIGHTS, LINE_KEY, "provider", 10)


QUERIES = {
    "high_cost_lines": high_cost_lines,
    "high_cost_lines_approx": high_cost_lines_approx,
    "sketch_rank_error": sketch_rank_error,
    "peer_zscore": peer_zscore,
    "peer_robust_zscore": peer_robust_zscore,
    "peer_iqr_outliers": peer_iqr_outliers,
    "rolling_baseline": rolling_baseline,
    "rate_variance": rate_variance,
    "repeat_lines": repeat_lines,
    "frequency_limit": frequency_limit,
    "provider_peer_rank": provider_peer_rank,
    "risk_score": risk_score,
}

# claim lines under their role names; paid is a decimal
LINES = """
lines AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS code, l_suppkey AS provider,
         l_shipdate AS service_date, l_quantity AS units, CAST(l_extendedprice AS DECIMAL(18,2)) AS paid,
         l_extendedprice / l_quantity AS unit_price
  FROM lineitem
)"""

KEY = "order_id, line_no, code, provider, service_date"

HIGH_COST = """
high_cost AS (
  SELECT l.*, t.threshold
  FROM lines l JOIN (
    SELECT code, quantile_cont(CAST(paid AS DOUBLE), 0.95) AS threshold FROM lines GROUP BY code
  ) t USING (code)
  WHERE CAST(l.paid AS DOUBLE) >= t.threshold
)"""

ROBUST = """
centred AS (
  SELECT l.*, abs(unit_price - med) AS away, med
  FROM lines l JOIN (SELECT code, median(unit_price) AS med FROM lines GROUP BY code) m USING (code)
),
robust AS (
  SELECT * FROM (
    SELECT c.*, CASE WHEN mad > 0 THEN round(0.6745 * (unit_price - med) / mad, 4) END AS zscore
    FROM centred c JOIN (SELECT code, median(away) AS mad FROM centred GROUP BY code) d USING (code)
  ) WHERE zscore > 3.5
)"""

FREQUENT = """
frequent AS (
  SELECT provider, code, date_trunc('month', service_date) AS period_start,
         sum(units) AS total_units, count(*) AS n_lines
  FROM lines GROUP BY ALL HAVING sum(units) > 60
)"""

ORACLES = {
    "sketch_rank_error": """
SELECT count(DISTINCT l_suppkey) AS n_groups, count(*) AS n_lines, true AS within_bound FROM lineitem""",
    "high_cost_lines": f"""
WITH {LINES}, {HIGH_COST}
SELECT {KEY}, CAST(paid AS DOUBLE) AS paid, round(threshold, 4) AS threshold FROM high_cost""",
    "peer_zscore": f"""
WITH {LINES}, stats AS (
  SELECT code, avg(CAST(paid AS DOUBLE)) AS mean, stddev_samp(CAST(paid AS DOUBLE)) AS dev
  FROM lines GROUP BY code
), scored AS (
  SELECT l.*, CASE WHEN dev > 0 THEN round((CAST(paid AS DOUBLE) - mean) / dev, 4) END AS zscore
  FROM lines l JOIN stats USING (code)
)
SELECT {KEY}, CAST(paid AS DOUBLE) AS paid, zscore FROM scored WHERE abs(zscore) >= 2""",
    "peer_robust_zscore": f"""
WITH {LINES}, {ROBUST}
SELECT {KEY}, zscore FROM robust""",
    "peer_iqr_outliers": f"""
WITH {LINES}, quartiles AS (
  SELECT code, quantile_cont(unit_price, 0.25) AS q1, quantile_cont(unit_price, 0.75) AS q3
  FROM lines GROUP BY code
)
SELECT {KEY}, CASE WHEN unit_price > q3 + 1.5 * (q3 - q1) THEN 'high' ELSE 'low' END AS side
FROM lines JOIN quartiles USING (code)
WHERE unit_price > q3 + 1.5 * (q3 - q1) OR unit_price < q1 - 1.5 * (q3 - q1)""",
    "rolling_baseline": f"""
WITH {LINES}, windowed AS (
  SELECT *, sum(paid) OVER w AS s, count(*) OVER w AS n
  FROM lines
  WINDOW w AS (PARTITION BY provider ORDER BY service_date
               RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)
)
SELECT {KEY}, CAST(s AS DOUBLE) AS prior_sum, n AS prior_count,
       CAST(paid AS DOUBLE) - CAST(s AS DOUBLE) / n AS deviation
FROM windowed""",
    "rate_variance": f"""
WITH {LINES}, rates AS (
  SELECT p_partkey AS code, CAST(p_retailprice AS DECIMAL(18,2)) AS rate,
         make_date(y, 1, 1) AS valid_from, make_date(y + 1, 1, 1) AS valid_to
  FROM part, (SELECT unnest(range({RATE_YEARS[0]}, {RATE_YEARS[1] + 1})) AS y)
)
SELECT {", ".join("l." + c.strip() for c in KEY.split(","))},
       CASE WHEN r.rate IS NULL THEN 'no_rate' ELSE 'priced' END AS status,
       CAST(l.paid - CAST(l.units AS DECIMAL(4,0)) * CAST(r.rate AS DECIMAL(12,2)) AS DOUBLE) AS variance
FROM lines l LEFT JOIN rates r
  ON l.code = r.code AND CAST(l.service_date AS DATE) >= r.valid_from
 AND CAST(l.service_date AS DATE) < r.valid_to""",
    "repeat_lines": f"""
WITH {LINES}, ordered AS (
  SELECT l.*, o_custkey AS member,
         date_diff('day', lag(service_date) OVER (
           PARTITION BY o_custkey, code ORDER BY service_date, order_id, line_no, provider), service_date) AS gap
  FROM lines l JOIN orders ON o_orderkey = order_id
)
SELECT {KEY}, member, CAST(gap AS INTEGER) AS gap_days FROM ordered WHERE gap <= 90""",
    "frequency_limit": f"""
WITH {LINES}, {FREQUENT}
SELECT * FROM frequent""",
    "provider_peer_rank": f"""
WITH {LINES}, totals AS (
  SELECT provider, s_nationkey AS nation, sum(paid) AS total
  FROM lines JOIN supplier ON s_suppkey = provider GROUP BY ALL
)
SELECT provider, nation, CAST(total AS DOUBLE) AS total,
       percent_rank() OVER (PARTITION BY nation ORDER BY total) AS pct_rank,
       cume_dist() OVER (PARTITION BY nation ORDER BY total) AS cume_dist,
       CAST(ntile(10) OVER (PARTITION BY nation ORDER BY total, provider) AS INTEGER) AS decile
FROM totals""",
    "risk_score": f"""
WITH {LINES}, {HIGH_COST}, {ROBUST}, {FREQUENT}, hits AS (
  SELECT {KEY}, 3.0 AS weight FROM high_cost
  UNION ALL SELECT {KEY}, 2.5 FROM robust
  UNION ALL
  SELECT {", ".join("l." + c.strip() for c in KEY.split(","))}, 1.25
  FROM lines l SEMI JOIN frequent f
    ON l.provider = f.provider AND l.code = f.code AND date_trunc('month', l.service_date) = f.period_start
), scores AS (
  SELECT {KEY}, CAST(sum(weight) AS DOUBLE) AS score, count(*) AS n_rules FROM hits GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY provider ORDER BY score DESC, {KEY}) AS INTEGER) AS rank
  FROM scores
)
SELECT * FROM ranked WHERE rank <= 10""",
}
