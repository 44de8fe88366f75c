"""Packed token ids: exact round trips, damage, and tokens equal to the library's."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimtrace.llm import idfiles
from claimtrace.llm.queries import BYTE_TOKENIZER, QUERIES
from tests.llm.test_operators import odd_texts, prose

LIBRARY = Tokenizer.from_file(BYTE_TOKENIZER)


def wanted(text) -> list:
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 64, 65, 4097, 9000])
def test_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), np.full(n, 7), rng.integers(0, 2, n), rng.integers(0, 1 << 32, n), rng.zipf(1.3, n) % 70_000, np.arange(n) % 500):
        assert np.array_equal(idfiles.unpack(idfiles.pack(ids)), ids.astype(np.uint32))


def test_predictable_ids_are_small():
    again = np.tile(np.random.default_rng(1).integers(0, 50_000, 64), 64)
    assert len(idfiles.pack(again)) < len(again) * 2 * 0.2
    often = np.random.default_rng(2).zipf(1.5, 40_000) % 50_000
    assert len(idfiles.pack(often)) < len(often) * 2 * 0.6


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(3).zipf(1.4, 20_000) % 50_000
    payload = idfiles.pack(ids)
    # a block coded alone takes the words it takes beside others
    for at in range(0, len(ids), idfiles.BLOCK_IDS):
        alone = idfiles.pack(ids[at : at + idfiles.BLOCK_IDS])
        assert alone[28:] in payload
    for at in (0, 25, len(payload) // 2, len(payload) - 1):
        damaged = bytearray(payload)
        damaged[at] ^= 0x55
        with pytest.raises(ValueError):
            idfiles.unpack(bytes(damaged))
    with pytest.raises(ValueError):
        idfiles.unpack(payload[:-2])


def test_pieces_are_the_librarys():
    pieces = idfiles._Pieces(open(BYTE_TOKENIZER, encoding="utf-8").read())
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x2C2)]
    texts = [f"a{c}b {c} 1{c}2{c}{c} \n{c}'s" for c in letters]
    texts += ["".join(rng.choices([*letters[:128], " ", "\n", "'s", "1"], k=rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choices([*letters, " ", "  ", "漢", "　", "😀", "<|endoftext|>", "é"], k=rng.randint(1, 60))) for _ in range(3000)]
    texts += ["", "x" * 5000, " " * 5000, *filter(None, odd_texts())]
    ids, sizes = pieces.encode(texts)
    found = np.split(ids, np.cumsum(sizes)[:-1])
    for text, own, library in zip(texts, found, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.tolist() == library.ids, text


def written_and_read(spark, docs, tmp_path, end_id=2):
    path = str(tmp_path / "ids")
    idfiles.write_ids(idfiles.encode_ids(idfiles.in_id_order(docs), BYTE_TOKENIZER, end_id), path)
    return path


@pytest.mark.parametrize("chunk", [200, idfiles.CHUNK_IDS])
def test_files(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(idfiles, "CHUNK_IDS", chunk)
    texts = odd_texts() + [prose(i, 1 + i * 7) for i in range(60)]
    rows = [(1000 - 3 * i, t, b"clash", -1) for i, t in enumerate(texts)] + [(None, "no id", None, 0), (1000, "again", None, 0), (1000, "again", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids binary, first int")
    path = written_and_read(spark, docs.repartition(5), tmp_path)
    found = sorted(((r.doc_id, r.start, list(r.ids)) for r in idfiles.read_ids(spark, path).collect()), key=lambda r: r[1])
    assert sorted(map(str, ((d, ids) for d, _, ids in found))) == sorted(str((d, wanted(t) + [2])) for d, t, *_ in rows)
    # nulls first, then ascending; every document starts where the one before ends
    assert [d is not None and d for d, *_ in found] == sorted((d is not None and d for d, *_ in rows), key=lambda d: (d is not False, d))
    assert [s for _, s, _ in found] == np.cumsum([0, *(len(ids) for *_, ids in found)])[:-1].tolist()
    crc = {(r.start, r.crc) for r in idfiles.read_binary(spark, path).select("start", F.crc32("data").alias("crc")).collect()}
    assert crc == {(s, zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for _, s, ids in found}


def test_files_of_nothing_and_of_wrong_ids(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert idfiles.read_ids(spark, written_and_read(spark, docs, tmp_path)).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [5])], "doc_id bigint, ids array<bigint>").coalesce(1)
    idfiles.write_ids(nulls, str(tmp_path / "nulls"))
    assert sorted((r.doc_id, r.start, r.ids) for r in idfiles.read_ids(spark, str(tmp_path / "nulls")).collect()) == [(1, 0, []), (2, 0, [5])]
    with pytest.raises(Exception, match="token id is not from"):
        idfiles.write_ids(spark.createDataFrame([(1, [-1])], "doc_id bigint, ids array<bigint>"), str(tmp_path / "wrong"))


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    start, want = 0, []
    for r in docs:
        ids = wanted(r.text) + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op13_token_files"](spark, sf).collect()) == want
