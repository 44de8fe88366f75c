"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the data, BENCH_CPUS the number of cores, BENCH_RUNS the timed runs per
query after one that is not timed; the median counts. Names on the command line replace
the headline queries; ``all`` stands for every query.
"""

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from claimtrace.queries import QUERIES

HEADLINES = [
    "high_cost_lines",
    "peer_zscore",
    "peer_robust_zscore",
    "peer_iqr_outliers",
    "rolling_baseline",
    "rate_variance",
    "repeat_lines",
    "frequency_limit",
    "provider_peer_rank",
    "risk_score",
    "build_cases",
    "state_intervals",
    "case_state_asof",
    "case_backlog_daily",
    "case_summary",
    "worklist_topk",
    "build_postings",
    "bm25_topk",
    "phrase_search",
    "chunk_documents",
    "vector_topk",
    "overpayments",
    "recovery_ledger",
    "fifo_allocate",
    "outstanding_aging",
    "recovery_vintage",
    "ledger_diff",
    "stream_build_cases",
    "stream_event_counts",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("claimtrace-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    """Computes every row and column without gathering them."""
    df.write.format("noop").mode("overwrite").save()


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session(cpus)
    seconds = {}
    for name in list(QUERIES) if names == ["all"] else names or HEADLINES:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            run(QUERIES[name](spark, sf_dir))
            took.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(took[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
