"""Compares a named query with its SQL as multisets of rows.

Run as ``python -m tests.oracle [--sf DIR] [--hot ROWS] [names...]`` to check and time queries.
"""

import collections
import datetime
import decimal
import math
import sys
import time

import duckdb

from claimtrace.sources import SCHEMAS


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """One form per value, whichever engine it came from."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def multiset(columns, rows) -> collections.Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return collections.Counter(tuple(plain(row[i]) for i in order) for row in rows)


def spark_rows(df) -> collections.Counter:
    return multiset(df.columns, df.collect())


def duck_rows(con, sql) -> tuple[list[str], collections.Counter]:
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    return sorted(columns), multiset(columns, result.fetchall())


def main(argv):
    import __spark_entry__ as entry
    from tests.conftest import make_session

    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    spark, con, sqls, bad = make_session(), duck(sf_dir), entry.oracle_sql(), []
    if argv[:1] == ["--hot"]:
        # every group above this many rows takes the path for very large groups
        spark.conf.set("claimtrace.hotRows", argv[1])
        spark.conf.set("claimtrace.hotSample", "1")
        argv = argv[2:]
    for name in argv or entry.queries():
        start = time.time()
        df = entry.queries()[name](spark, sf_dir)
        ours = spark_rows(df)
        took = time.time() - start
        if name not in sqls:
            print(f"{name:26s} rows={sum(ours.values()):7d} {took:6.2f}s (no SQL)", flush=True)
            continue
        columns, theirs = duck_rows(con, sqls[name])
        same = columns == sorted(df.columns) and ours == theirs
        print(f"{name:26s} rows={sum(ours.values()):7d} {took:6.2f}s {'ok' if same else 'DIFFERS'}", flush=True)
        if not same:
            bad.append(name)
            print(sorted(df.columns), columns, sum(theirs.values()))
            print("spark only", list((ours - theirs).items())[:4])
            print("sql only  ", list((theirs - ours).items())[:4])
    print("differing:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
