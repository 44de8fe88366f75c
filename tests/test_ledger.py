"""The ledger's snapshots: what is committed, by whom, in which order, and what is read again."""

import threading

import pytest

from claimtrace.streaming import ledger
from tests.frames import at, cents, tuples

SCHEMA = "party bigint, entry_id bigint, ts timestamp, signed decimal(18,2), version bigint, gone boolean"


def _row(party, entry, signed, version=1, gone=False, ts="2024-01-01T00:00"):
    return (party, entry, at(ts), cents(signed), version, gone)


def _stream(spark, path, *files):
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/part{i}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/part*")


def _put(spark, stream, path, checkpoint=None):
    ledger.stream_ledger_upsert(stream, path, checkpoint, version="version", deleted="gone")


def _balances(spark, path, snapshot=None):
    return tuples(ledger.ledger_balances(spark, path, snapshot), "party", "balance", "n_entries")


def _entries(spark, path):
    return tuples(ledger.ledger_entries(spark, path), "party", "entry_id", "signed")


def test_every_entry_counts_once(spark, tmp_path):
    first = [_row(1, 1, 10), _row(1, 2, -4)]
    stream = _stream(spark, f"{tmp_path}/in", first, [_row(1, 2, -4), _row(2, 3, 7)])
    path = f"{tmp_path}/ledger"
    _put(spark, stream, path)
    # a second run from the start repeats the same batches
    _put(spark, stream, path)
    assert _balances(spark, path) == [(1, cents(6), 2), (2, cents(7), 1)]


def test_entries_without_an_id_are_entries_of_their_own(spark, tmp_path):
    rows = [_row(1, None, 10), _row(2, None, 20), _row(3, None, 30), _row(3, None, 30), _row(None, 5, 1)]
    path = f"{tmp_path}/ledger"
    _put(spark, _stream(spark, f"{tmp_path}/in", rows), path, f"{tmp_path}/state")
    wanted = [(None, cents(1), 1), (1, cents(10), 1), (2, cents(20), 1), (3, cents(60), 2)]
    assert _balances(spark, path) == wanted
    ledger.compact_ledger(spark, path)
    assert _balances(spark, path) == wanted


def test_an_old_delivery_does_not_beat_a_correction(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    old = _stream(spark, f"{tmp_path}/old", [_row(1, 1, 10), _row(1, 2, 5), _row(1, 3, 1)])
    new = _stream(spark, f"{tmp_path}/new", [_row(1, 1, 99, 2), _row(1, 2, 0, 2, gone=True)])
    _put(spark, old, path)
    _put(spark, new, path)
    _put(spark, old, path)
    assert _entries(spark, path) == [(1, 1, cents(99)), (1, 3, cents(1))]
    ledger.compact_ledger(spark, path)
    _put(spark, old, path)
    assert _entries(spark, path) == [(1, 1, cents(99)), (1, 3, cents(1))]
    # a deletion that was forgotten hides nothing any more
    ledger.compact_ledger(spark, path, forget_deleted=True)
    _put(spark, old, path)
    assert _entries(spark, path) == [(1, 1, cents(99)), (1, 2, cents(5)), (1, 3, cents(1))]
    # ties of version have one result whatever came first
    ties = f"{tmp_path}/ties"
    for name, rows in (("a", [_row(1, 1, 3)]), ("b", [_row(1, 1, 8)]), ("a", [_row(1, 1, 3)])):
        _put(spark, _stream(spark, f"{tmp_path}/{name}", rows), ties)
    assert _entries(spark, ties) == [(1, 1, cents(8))]


def test_a_batch_that_is_run_again_adds_nothing(spark, tmp_path, monkeypatch):
    path, state = f"{tmp_path}/ledger", f"{tmp_path}/state"
    stream = _stream(spark, f"{tmp_path}/in", [_row(1, None, 10)])
    commit = ledger._commit

    def dies_after(*args, **kwargs):
        commit(*args, **kwargs)
        raise RuntimeError("lost")

    monkeypatch.setattr(ledger, "_commit", dies_after)
    with pytest.raises(Exception, match="lost"):
        _put(spark, stream, path, state)
    monkeypatch.undo()
    # the stream did not hear of its success and repeats the batch
    _put(spark, stream, path, state)
    assert _balances(spark, path) == [(1, cents(10), 1)]


def test_two_writers_lose_nothing(spark, tmp_path):
    path = f"{tmp_path}/ledger"
    streams = [_stream(spark, f"{tmp_path}/in{w}", *[[_row(w, w * 100 + i, 1)] for i in range(4)]) for w in (1, 2)]
    writers = [threading.Thread(target=_put, args=(spark, s, path)) for s in streams]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert _balances(spark, path) == [(1, cents(4), 4), (2, cents(4), 4)]
    assert ledger.snapshots(spark, path) == list(range(1, len(ledger.snapshots(spark, path)) + 1))


def test_merged_folders_are_read_instead_of_what_they_replace(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "FAN", 2)
    path = f"{tmp_path}/ledger"
    versions = [[_row(1, 1, v, v), _row(2, 10 + v, 1, v)] for v in range(1, 6)]
    _put(spark, _stream(spark, f"{tmp_path}/in", *versions), path)
    assert _balances(spark, path) == [(1, cents(5), 1), (2, cents(5), 5)]
    tiers = [tier for _, tier in ledger._latest(spark, path)["folders"]]
    assert sorted(tiers) == [0, 2]
    # five versions of one entry were written; two rows of it are left to read
    rows = ledger._rows(spark, path, [f for f, _ in ledger._latest(spark, path)["folders"]])
    assert rows.where("entry_id = 1").count() == 2
    ledger.compact_ledger(spark, path)
    folders = [f for f, _ in ledger._latest(spark, path)["folders"]]
    assert len(folders) == 1 and ledger._rows(spark, path, folders).count() == 6
    # earlier snapshots are as they were, until they are expired
    assert _balances(spark, path, 1) == [(1, cents(1), 1), (2, cents(1), 1)]
    ledger.expire_snapshots(spark, path, keep=1)
    assert len(ledger.snapshots(spark, path)) == 1
    assert len(list((tmp_path / "ledger" / "data").iterdir())) == 1
    assert _balances(spark, path) == [(1, cents(5), 1), (2, cents(5), 5)]


def test_a_ledger_of_nothing(spark, tmp_path):
    assert ledger.ledger_balances(spark, f"{tmp_path}/none").count() == 0
    ledger.compact_ledger(spark, f"{tmp_path}/none")
    assert ledger.snapshots(spark, f"{tmp_path}/none") == []
