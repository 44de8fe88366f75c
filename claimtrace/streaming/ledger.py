"""A ledger of recovery entries kept as snapshots: what a reader sees is one committed list of files.

A micro-batch writes its entries into a folder nobody reads yet and then commits a manifest,
the next number in ``snapshots``, that names all live folders and the last batch of each
stream. A manifest is put in place by a rename that fails if the number is taken; the
loser reads the winner's manifest and tries the next number, so several writers lose nothing of
each other's. A batch that is run again finds itself in the manifest and adds nothing.

Folders are merged in tiers, as in a log-structured merge tree: FAN folders of one tier become one of
the next, with one row per entry. Superseded rows are then read no more, an entry is
rewritten once per tier, and a compaction leaves one row per entry. Old
manifests stay readable until they are expired.
"""

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from claimtrace.sources import manifests
from claimtrace.sources.storage import scratch_path
from claimtrace.streaming.run import run_batches

FAN = 8
ROWS = (
    "row_key string, party bigint, entry_id bigint, ts timestamp, signed decimal(18,2), version bigint, deleted boolean"
)
_OLDEST = -(1 << 63)


def stream_ledger_upsert(
    stream: DataFrame, path: str, checkpoint: str | None = None, version: str = "ts", deleted: str | None = None
) -> None:
    """Adds signed entries (party, entry_id, ts, signed) to the ledger at ``path``.

    Of rows with one entry_id the greatest ``version`` counts (a whole number or a time, null is oldest), whatever
    came first; at equal versions a deletion, then the later ts, the greater amount and party. A row whose
    ``deleted`` column is true takes its entry away. A row without entry_id is an entry of its own,
    which nothing replaces.

    With the ``checkpoint`` of an earlier call the stream goes on where that one stopped; without
    one it starts anew. A batch counts once however often it is run.
    """
    spark = stream.sparkSession
    checkpoint = checkpoint or scratch_path(spark, "ledger-state")
    run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:32]
    rank = F.col(version)
    if isinstance(stream.schema[version].dataType, (TimestampType, TimestampNTZType)):
        rank = F.unix_micros(rank.cast("timestamp"))
    gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)

    def write(batch: DataFrame, batch_id: int) -> None:
        if _latest(spark, path)["runs"].get(run, -1) >= batch_id:
            return
        own = F.concat(F.lit(f"{run}:{batch_id}:"), F.monotonically_increasing_id().cast("string"))
        rows = batch.select(
            F.coalesce(F.col("entry_id").cast("string"), own).alias("row_key"),
            "party",
            "entry_id",
            "ts",
            "signed",
            F.coalesce(rank.cast("bigint"), F.lit(_OLDEST)).alias("version"),
            gone.alias("deleted"),
        )
        folder = f"data/{run}-{batch_id}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/{folder}")
        _commit(spark, path, added=[(folder, 0)], run=(run, batch_id))
        _merge_tiers(spark, path)

    run_batches(stream, checkpoint, write)


def ledger_entries(spark: SparkSession, path: str, snapshot: int | None = None) -> DataFrame:
    """One row per live entry: party, entry_id, ts, signed, version; of an earlier snapshot if its number is given."""
    manifest = _latest(spark, path) if snapshot is None else manifests.read(spark, path, snapshot)
    live = _live(_rows(spark, path, [f for f, _ in manifest["folders"]]))
    return live.where(~F.col("deleted")).select("party", "entry_id", "ts", "signed", "version")


def ledger_balances(spark: SparkSession, path: str, snapshot: int | None = None) -> DataFrame:
    """The balance of each party."""
    return (
        ledger_entries(spark, path, snapshot)
        .groupBy("party")
        .agg(F.sum("signed").alias("balance"), F.count(F.lit(1)).alias("n_entries"))
    )


def compact_ledger(spark: SparkSession, path: str, forget_deleted: bool = False) -> None:
    """All folders into one, without superseded rows.

    Deletions stay as marks, so that a late delivery of an older version stays hidden;
    ``forget_deleted`` drops them, for a ledger that gets no such deliveries any more.
    """
    folders = _latest(spark, path)["folders"]
    if folders:
        _merge(spark, path, folders, 1 + max(tier for _, tier in folders), forget_deleted)


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the snapshots that can be read, in order."""
    return manifests.numbers(spark, path)


def expire_snapshots(spark: SparkSession, path: str, keep: int = 10) -> None:
    """Removes all but the last ``keep`` snapshots, and the folders that no other names."""
    manifests.expire(spark, path, keep, lambda m: {f for f, _ in m["folders"]})


# --- rows --------------------------------------------------------------------------------------


def _rows(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], ROWS)
    return spark.read.schema(ROWS).parquet(*[f"{path}/{f}" for f in folders])


def _live(rows: DataFrame) -> DataFrame:
    """The row of each key that counts, by a sum on the map side first: a key repeated very often is thin by then."""
    order: list[Column] = [F.col(c) for c in ("version", "deleted", "ts", "signed", "party", "entry_id")]
    latest = rows.groupBy("row_key").agg(F.max(F.struct(*order)).alias("__row"))
    return latest.select("row_key", "__row.*")


def _merge(spark: SparkSession, path: str, folders: list, tier: int, forget_deleted: bool = False) -> None:
    merged = _live(_rows(spark, path, [f for f, _ in folders]))
    if forget_deleted:
        merged = merged.where(~F.col("deleted"))
    folder = f"data/tier{tier}-{uuid.uuid4().hex}"
    merged.select(*[f.split()[0] for f in ROWS.split(", ")]).write.parquet(f"{path}/{folder}")
    _commit(spark, path, added=[(folder, tier)], removed=[f for f, _ in folders])


def _merge_tiers(spark: SparkSession, path: str) -> None:
    tier = 0
    while True:
        folders = _latest(spark, path)["folders"]
        own = [f for f in folders if f[1] == tier]
        if len(own) < FAN:
            return
        _merge(spark, path, own, tier + 1)
        tier += 1


# --- manifests ---------------------------------------------------------------------------------


def _latest(spark: SparkSession, path: str) -> dict:
    return {"folders": [], "runs": {}} | manifests.latest(spark, path)


def _commit(spark: SparkSession, path: str, added: list, removed: Sequence[str] = (), run: tuple[str, int] | None = None) -> None:
    """Puts the next manifest in place; a merge whose folders another merge took is given up."""

    def change(now: dict) -> dict | None:
        now = {"folders": [], "runs": {}} | now
        names = {f for f, _ in now["folders"]}
        if not names.issuperset(removed) or (run and now["runs"].get(run[0], -1) >= run[1]):
            return None
        folders = [f for f in now["folders"] if f[0] not in set(removed)] + [list(f) for f in added]
        return {"folders": folders, "runs": now["runs"] | ({run[0]: run[1]} if run else {})}

    manifests.commit(spark, path, change)
