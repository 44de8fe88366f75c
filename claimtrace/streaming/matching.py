"""Recoveries matched with the demands they pay, entry by entry, on one stream of both.

A party's entries wait until the watermark has passed them and are then taken in order of time. A
recovery pays the oldest open demands first; what no demand was open for stays unmatched, so
money that came back before it was demanded, on the same day too, never matches. The state of a
party is its queue of open demands and the entries that still wait; an allocation uses
up a demand, a recovery or both, so there are never more of them than entries.
"""

from collections import deque
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

MATCHES = (
    "party bigint, obligation_id bigint, recovery_id bigint, demanded_at timestamp, recovered_at timestamp, amount_cents bigint"
)
_WAITING = "ts timestamp, entry_id bigint, cents bigint"
_COLUMNS = ["ts", "entry_id", "cents"]


def stream_entry_match(entries: DataFrame, delay: str, expire: timedelta | None = None) -> DataFrame:
    """Allocations of recoveries to demands: who paid what, when, and how much.

    ``entries`` has party, entry_id, ts and signed, positive for a demand and negative for a recovery; zero and null
    amounts and entries without time are left out, a null party is a party. Entries of one time go by
    demands first, then by id. With ``expire`` a demand that old is closed, and the state that held it ends.
    Needs the RocksDB state store.
    """
    cents = (F.col("signed") * 100).cast("bigint")
    rows = entries.where(F.col("ts").isNotNull()).select("party", "ts", "entry_id", cents.alias("cents")).where(F.col("cents") != 0)
    return (
        rows.withWatermark("ts", delay)
        .groupBy("party")
        .transformWithStateInPandas(
            statefulProcessor=PartyQueue(expire), outputStructType=MATCHES, outputMode="Append", timeMode="EventTime"
        )
    )


class PartyQueue(StatefulProcessor):
    """Open demands of one party, oldest first, and entries that the watermark has not passed."""

    def __init__(self, expire: timedelta | None = None):
        self._expire = None if expire is None else pd.Timedelta(expire)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getListState("open", _WAITING)
        self._waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for block in rows:
            values = [_plain(r) for r in block[_COLUMNS].itertuples(index=False)]
            self._waiting.appendList(values)
            earliest = min(_millis(v[0]) for v in values)
            first = earliest if first is None else min(first, earliest)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        waiting = [tuple(v) for v in self._waiting.get()]
        due = sorted((v for v in waiting if _millis(v[0]) <= passed), key=_place)
        rest = [v for v in waiting if _millis(v[0]) > passed]
        queue = deque(tuple(v) for v in self._open.get()) if self._open.exists() else deque()
        found = list(self._paid(key[0], queue, due))
        if self._expire is not None:
            self._close(queue, pd.Timestamp(passed, unit="ms"))
        _keep(self._open, list(queue))
        _keep(self._waiting, rest)
        # a queue that may expire wakes its party once more, to end its state
        times = [_millis(v[0]) for v in rest]
        if queue and self._expire is not None:
            times.append(_millis(queue[0][0] + self._expire))
        if times:
            self._wake(min(times))
        if found:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in MATCHES.split(", ")])

    def close(self) -> None:
        pass

    def _wake(self, millis: int) -> None:
        """One timer at a time, the earliest."""
        timers = list(self._handle.listTimers())
        if not timers or millis < min(timers):
            for timer in timers:
                self._handle.deleteTimer(timer)
            self._handle.registerTimer(millis)

    def _close(self, queue: deque, now) -> None:
        while queue and queue[0][0] + self._expire <= now:
            queue.popleft()

    def _paid(self, party, queue: deque, due: list) -> Iterator[tuple]:
        for ts, entry, cents in due:
            if cents > 0:
                queue.append((ts, entry, cents))
                continue
            if self._expire is not None:
                self._close(queue, ts)
            left = -cents
            while left and queue:
                since, demand, owed = queue.popleft()
                paid = min(left, owed)
                left -= paid
                if owed > paid:
                    queue.appendleft((since, demand, owed - paid))
                yield party, demand, entry, since, ts, paid


def _plain(row) -> tuple:
    return pd.Timestamp(row[0]).to_pydatetime(), None if pd.isna(row[1]) else int(row[1]), int(row[2])


def _place(entry) -> tuple:
    ts, number, cents = entry
    return ts, cents < 0, number is not None, number or 0


def _keep(state, values: list) -> None:
    if values:
        state.put(values)
    else:
        state.clear()


def _millis(ts) -> int:
    return pd.Timestamp(ts).value // 1_000_000
