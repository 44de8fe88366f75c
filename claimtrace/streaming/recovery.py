"""Recoveries on streams of obligations and recoveries (party, entry_id, ts, amount)."""

from pyspark.sql import DataFrame, functions as F


def stream_recovery_match(
    obligations: DataFrame, recoveries: DataFrame, within_days: int, delay: str
) -> DataFrame:
    """Each party's recoveries of a day with its demands of that day and the ``within_days`` before.

    Both sides are added up per party and day before they are joined, so a party with very
    many entries contributes at most ``within_days`` + 1 rows per day.
    """

    def daily(entries: DataFrame, name: str) -> DataFrame:
        return (
            entries.withWatermark("ts", delay)
            .groupBy("party", F.window("ts", "1 day").alias("window"))
            .agg(F.sum("amount").cast("decimal(28,2)").alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
            .select(
                F.col("party").alias(f"{name}_party"),
                F.window_time("window").alias(f"{name}_time"),
                F.col("window.start").alias(f"{name}_day"),
                name,
                f"n_{name}",
            )
        )

    demanded, recovered = daily(obligations, "demanded"), daily(recoveries, "recovered")
    soon = (F.col("recovered_time") >= F.col("demanded_time")) & (
        F.col("recovered_time") <= F.col("demanded_time") + F.expr(f"interval {within_days} days")
    )
    same = F.col("demanded_party") == F.col("recovered_party")
    return demanded.join(recovered, same & soon).select(
        F.col("demanded_party").alias("party"),
        "demanded_day",
        "recovered_day",
        "demanded",
        "n_demanded",
        "recovered",
        "n_recovered",
    )
