"""Small frames for hand-computed cases."""

import datetime
from decimal import Decimal

from pyspark.sql import DataFrame


def at(text: str) -> datetime.datetime:
    return datetime.datetime.fromisoformat(text)


def cents(amount) -> Decimal | None:
    return None if amount is None else Decimal(str(amount)).quantize(Decimal("0.01"))


def entries(spark, rows) -> DataFrame:
    """(party, entry_id, ts, amount)"""
    data = [(p, e, at(ts), cents(a)) for p, e, ts, a in rows]
    return spark.createDataFrame(data, "party bigint, entry_id bigint, ts timestamp_ntz, amount decimal(18,2)")


def events(spark, rows) -> DataFrame:
    """(case_id, event_id, ts, state, amount)"""
    data = [(c, e, at(ts), s, cents(a)) for c, e, ts, s, a in rows]
    return spark.createDataFrame(
        data, "case_id bigint, event_id bigint, ts timestamp_ntz, state string, amount decimal(18,2)"
    )


def ordered(rows) -> list[tuple]:
    """Rows in order, nulls first."""
    return sorted(rows, key=lambda row: [(v is not None, v) if v is not None else (False,) for v in row])


def tuples(df: DataFrame, *columns) -> list[tuple]:
    return ordered(tuple(r) for r in df.select(*columns).collect())
