"""Alerts on claim amounts as they arrive."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def stream_alerts(
    stream: DataFrame, baseline: DataFrame, entity: Sequence[str], value: str, k: float, salts: int = 1
) -> DataFrame:
    """Arriving rows whose z-score against the batch ``baseline`` is at least ``k`` away from 0.

    ``baseline`` has one row per entity with ``mean`` and ``dev``. ``salts`` > 1 spreads each
    entity's rows over that many tasks, for streams in which one entity dominates.
    """
    keys = list(entity)
    if salts > 1:
        stream = stream.withColumn("__salt", F.pmod(F.xxhash64(*stream.columns), F.lit(salts)).cast("int"))
        copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
        baseline = baseline.select("*", copies.alias("__salt"))
        keys.append("__salt")
    z = F.round((F.col(value).cast("double") - F.col("mean")) / F.col("dev"), 4)
    return (
        stream.join(baseline, keys)
        .withColumn("zscore", F.when(F.col("dev") > 0, z))
        .where(F.abs("zscore") >= k)
        .drop("__salt", "mean", "dev")
    )
