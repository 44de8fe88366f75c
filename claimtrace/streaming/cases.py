"""Cases on a stream of case events, with ``ts`` as a timestamp."""

from collections.abc import Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TOTAL = "decimal(28,2)"


def stream_build_cases(stream: DataFrame, gap: str, delay: str) -> DataFrame:
    """Cases by inactivity gap, each emitted once it can no longer grow.

    Filter the result only after it has been written: a condition on the end of a
    session, placed directly on the aggregation, is moved below it and cuts sessions.
    """
    return (
        stream.withWatermark("ts", delay)
        .groupBy("case_id", F.session_window("ts", gap).alias("session"))
        .agg(
            F.max("ts").alias("last_ts"),
            F.count(F.lit(1)).alias("n_flags"),
            F.sum("amount").cast(TOTAL).alias("amount"),
        )
        .select(
            "case_id",
            F.col("session.start").alias("first_ts"),
            "last_ts",
            F.col("session.end").alias("case_end"),
            "n_flags",
            "amount",
        )
    )


def stream_event_counts(
    stream: DataFrame, by: Sequence[str], width: str, delay: str, slide: str | None = None
) -> DataFrame:
    """Event counts and amounts per window, tumbling or (with ``slide``) overlapping."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(*by, F.window("ts", width, slide).alias("window"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount").cast(TOTAL).alias("amount"))
        .select(
            *by,
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "n",
            "amount",
        )
    )


def stream_dedup(stream: DataFrame, key: Sequence[str], delay: str, salts: int = 1) -> DataFrame:
    """Drops events that were delivered before within ``delay``.

    ``salts`` > 1 first removes copies within that many slices of the input, so that an
    event delivered very often is thin by the time its copies meet.
    """
    marked = stream.withWatermark("ts", delay)
    if salts > 1:
        slice_no = F.floor(F.rand(seed=1) * salts).alias("__slice")
        marked = (
            marked.select("*", slice_no).dropDuplicatesWithinWatermark([*key, "__slice"]).drop("__slice")
        )
    return marked.dropDuplicatesWithinWatermark(list(key))


CASE_STATE = (
    "case_id bigint, state string, since timestamp, n_events bigint, amount_cents bigint, "
    "observed_at timestamp, stale boolean"
)

_PARTIAL = "case_id bigint, ts timestamp, event_id bigint, state string, n_events bigint, amount_cents bigint"


#: how long the state of a case that went stale is kept
KEEP_FOR = timedelta(days=365)


def stream_case_state(
    stream: DataFrame, delay: str, stale_after: timedelta, keep_for: timedelta | None = KEEP_FOR, initial: DataFrame | None = None
) -> DataFrame:
    """A log of each case's latest state, with a ``stale`` row when it has been still for too long.

    Each input block is reduced to one row per case before the shuffle. The state held per
    case is one row, and one timer. Needs the RocksDB state store. The state of a
    case ends ``keep_for`` after it went stale, or never if that is None; a later event then begins the case anew.

    ``initial`` (as ``case_totals`` makes it) is what batches have seen of the cases before the stream starts: the stream
    goes on from there instead of reading old events. It is taken over once, when a checkpoint is new.
    """
    cents = (F.col("amount") * 100).cast("bigint").alias("amount_cents")
    partial = (
        stream.select("case_id", "ts", "event_id", "state", F.lit(1).cast("bigint").alias("n_events"), cents)
        .mapInPandas(_latest_per_case, _PARTIAL)
        .withWatermark("ts", delay)
    )
    return partial.groupBy("case_id").transformWithStateInPandas(
        statefulProcessor=CaseState(stale_after, keep_for),
        outputStructType=CASE_STATE,
        outputMode="Append",
        timeMode="EventTime",
        initialState=None if initial is None else initial.select(_columns(_PARTIAL)).groupBy("case_id"),
    )


def case_totals(events: DataFrame) -> DataFrame:
    """The latest event of each case and its totals, from a batch of case events: case_id, ts, event_id, state, n_events, amount_cents."""
    latest = F.max_by(F.struct("ts", "event_id", "state"), F.struct("ts", "event_id"))
    totals = events.groupBy("case_id").agg(
        latest.alias("__e"), F.count(F.lit(1)).alias("n_events"), F.sum((F.col("amount") * 100).cast("bigint")).alias("amount_cents")
    )
    return totals.select("case_id", F.col("__e.ts").cast("timestamp").alias("ts"), "__e.event_id", "__e.state", "n_events", "amount_cents")


def held_case_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a stopped stream holds of each case, read from its checkpoint; the columns of ``case_totals``."""
    rows = spark.read.format("statestore").option("stateVarName", "latest").load(checkpoint)
    return rows.select("value.*").select(_columns(_PARTIAL))


def _latest_per_case(blocks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for block in blocks:
        yield _collapsed(block)


def _collapsed(rows: pd.DataFrame) -> pd.DataFrame:
    """One row per case: its latest state, with counts and amounts added up."""
    ordered = rows.sort_values(["ts", "event_id"])
    # the latest event as a whole, nulls included; the null case is a case
    latest = ordered.drop_duplicates("case_id", keep="last").drop(columns=["n_events", "amount_cents"])
    totals = ordered.groupby("case_id", as_index=False, dropna=False)[["n_events", "amount_cents"]].sum()
    return latest.merge(totals, on="case_id", how="left")[rows.columns.tolist()]


class CaseState(StatefulProcessor):
    """Keeps the latest event and the totals of one case."""

    def __init__(self, stale_after: timedelta, keep_for: timedelta | None = None):
        self._stale_ms = int(stale_after / timedelta(milliseconds=1))
        self._keep_ms = None if keep_for is None else int(keep_for / timedelta(milliseconds=1))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("latest", _PARTIAL)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._keep(_folded(key, None, initialState))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a tuple of _PARTIAL, or None for a new case, which has no timer either
        latest = known = self._state.get()
        for block in rows:
            latest = _folded(key, latest, block)
        if known is not None:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
        self._keep(latest)
        row = dict(zip(_columns(_PARTIAL), latest, strict=True))
        yield self._logged(row, row["ts"], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        row = dict(zip(_columns(_PARTIAL), self._state.get(), strict=True))
        expired = expiredTimerInfo.getExpiryTimeInMs()
        if expired > _millis(row["ts"]) + self._stale_ms:
            self._state.clear()
            return
        if self._keep_ms is not None:
            self._handle.registerTimer(expired + max(1, self._keep_ms))
        yield self._logged(row, pd.Timestamp(expired, unit="ms"), True)

    def close(self) -> None:
        pass

    def _keep(self, row: tuple) -> None:
        self._state.update(row)
        self._handle.registerTimer(_millis(row[1]) + self._stale_ms)

    def _logged(self, row, at, stale: bool) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "case_id": [row["case_id"]],
                "state": [row["state"]],
                "since": [row["ts"]],
                "n_events": [row["n_events"]],
                "amount_cents": [row["amount_cents"]],
                "observed_at": [at],
                "stale": [stale],
            }
        )


def _folded(key, latest: tuple | None, rows: pd.DataFrame) -> tuple:
    """``_collapsed`` of one case, as a tuple of _PARTIAL, without frames: there is a call per case, mostly on a row or two.

    ``latest`` is what was known before. The id is the key's, as the null id has two forms, from state and from input.
    """
    known = [] if latest is None else [latest[1:]]
    given = zip(*[[None if pd.isna(v) else v for v in rows[c].tolist()] for c in _columns(_PARTIAL)[1:]], strict=True)
    parts = [*known, *given]
    # of equal times and ids the last one; nulls come after all others
    place = lambda p: tuple((v is None, 0 if v is None else v) for v in (None if p[0] is None else pd.Timestamp(p[0]), p[1]))
    ts, event_id, state, _, _ = parts[0] if len(parts) == 1 else max(reversed(parts), key=place)
    n_events, cents = (sum(int(p[i]) for p in parts if p[i] is not None) for i in (3, 4))
    return None if pd.isna(key[0]) else key[0], ts, None if event_id is None else int(event_id), state, n_events, cents


def _columns(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _millis(ts) -> int:
    return pd.Timestamp(ts).value // 1_000_000
