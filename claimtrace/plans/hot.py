"""Which groups are too large for one task.

The *hot* groups are the largest ``MAX_HOT`` of those with more than ``HOT_ROWS`` rows.
Their number is fixed, so their keys may be fetched and broadcast whatever the size of
the data. Any other group has at most ``HOT_ROWS`` rows or one part in ``MAX_HOT`` of all
rows, so at most ``HOT_ROWS`` up to 10^11 rows.

Group sizes are estimated from a fixed share of the rows. Only the choice of plan
depends on the estimate: both plans give the same, whole result for any group.
"""

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

HOT_ROWS = 1_000_000
# a key and a few numbers each
MAX_HOT = 100_000
SAMPLE = 0.01

# session settings that override the first and the last of these
HOT_ROWS_CONF = "claimtrace.hotRows"
SAMPLE_CONF = "claimtrace.hotSample"


def hot_keys(df: DataFrame, keys: Sequence[str], at_most: int = MAX_HOT) -> DataFrame | None:
    """Keys of the hot groups, or None if there are none; runs one counting job.

    ``__rows`` is the estimated size of a group. ``__salts`` is the number of tasks it
    should be spread over, in proportion to its size; all salts add up to at most
    ``2 * at_most``.
    """
    spark = df.sparkSession
    sample = float(spark.conf.get(SAMPLE_CONF, str(SAMPLE)))
    at_least = float(spark.conf.get(HOT_ROWS_CONF, str(HOT_ROWS))) * sample
    seen = df.select(*keys)
    if sample < 1:
        seen = seen.sample(sample, seed=1)
    largest = (
        seen.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") > at_least)
        .orderBy(F.col("__n").desc())
        .limit(at_most)
        .toArrow()
    )
    if not largest.num_rows:
        return None
    sizes = largest.column("__n").to_pylist()
    one_task = max(at_least, sum(sizes) / at_most)
    salts = pa.array([math.ceil(n / one_task) for n in sizes], pa.int32())
    rows = pa.array([n / sample for n in sizes], pa.float64())
    table = largest.select(list(keys)).append_column("__rows", rows).append_column("__salts", salts)
    schema = seen.select(*keys, F.lit(0.0).alias("__rows"), F.lit(0).alias("__salts")).schema
    return spark.createDataFrame(table, schema)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[float, float]:
    """Estimated rows in all and of the largest group, by one counting job over the sample."""
    sample = float(df.sparkSession.conf.get(SAMPLE_CONF, str(SAMPLE)))
    seen = df.select(*keys)
    if sample < 1:
        seen = seen.sample(sample, seed=1)
    counts = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total, largest = counts.agg(F.sum("__n"), F.max("__n")).first()
    return (total or 0) / sample, (largest or 0) / sample


def join_bounded(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Broadcast join to ``right``, which holds a bounded number of rows per hot key.

    Null equals null here, so that a null key behaves as a group like any other.
    """
    renamed = F.broadcast(
        right.select(
            *[F.col(k).alias(f"__r_{k}") for k in keys],
            *[c for c in right.columns if c not in keys],
        )
    )
    on = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])
