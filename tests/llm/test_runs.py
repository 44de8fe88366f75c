"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import regex

from claimtrace.llm import runs
from claimtrace.llm.queries import QUERIES
from tests.llm.test_operators import odd_texts, prose


def plain_runs(words: list, min_words: int = 24, min_repeats: int = 3) -> list:
    found = []
    for q in range(1, len(words) // min_repeats + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            start, length = i - q, j - i + q
            if j > i and length >= max(min_words, min_repeats * q):
                inside = words[start : start + length]
                if not any(all(inside[t] == inside[t - d] for t in range(d, length)) for d in range(1, q)):
                    found.append((start, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def split(text) -> list:
    return regex.findall(r"[^\x20\x09-\x0D]+", text or "")


def kept(words: list, found: list) -> str:
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def circles(rng) -> list:
    """Words with repeated blocks, runs inside runs, and stretches that come back later."""
    words: list = []
    for _ in range(rng.randint(0, 6)):
        block = [rng.randrange(rng.choice([1, 2, 3, 5, 50])) for _ in range(rng.randint(1, 40))]
        words += block * rng.choice([1, 1, 2, 3, 4, 6]) + block[: rng.randint(0, len(block))]
        if words and rng.random() < 0.3:
            words += words[-rng.randint(1, len(words)) :]
    return words[:400]


@pytest.mark.parametrize("limits", [(24, 3), (10, 3), (7, 4), (3, 3), (40, 5)])
def test_runs_of_random_words(limits):
    rng = random.Random(sum(limits))
    for _ in range(120):
        texts = [circles(rng) for _ in range(rng.randint(0, 4))]
        first = np.cumsum([0, *map(len, texts)])
        found = runs.find_runs(np.array(sum(texts, []), dtype=np.int64), first, *limits)
        assert [[tuple(map(int, r)) for r in rows] for rows in found] == [plain_runs(t, *limits) for t in texts]


def test_runs_of_one_repeated_word_in_a_very_long_text():
    found = runs.find_runs(np.zeros(300_000, dtype=np.int64), np.array([0, 300_000]))
    assert [r.tolist() for r in found] == [[[0, 300_000, 1]]]


def test_periodic_runs(spark, monkeypatch):
    monkeypatch.setattr(runs, "SPLIT_BYTES", 50)
    rng = random.Random(5)
    texts = odd_texts() + ["x " * 30, "y\tz\n" * 12 + "end", prose(3, 400) + " " + "lo  la " * 20]
    texts += [" ".join(f"w{w}" for w in circles(rng)) for _ in range(40)]
    rows = [(i, t, "runs", -1) for i, t in enumerate(texts)] + [(None, "a " * 24, "x", 0), (3, "b " * 23, "x", 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, runs string, n_words int")
    found = {(r.doc_id, r.n_words): ([tuple(x) for x in r.runs], r.text) for r in runs.periodic_runs(frame).collect()}
    for i, text, *_ in rows:
        words = split(text)
        want = plain_runs(words)
        assert found[i, len(words)] == (want, kept(words, want))
    assert runs.periodic_runs(frame.limit(0)).count() == 0
    twice = runs.periodic_runs(frame.union(frame)).count()
    assert twice == 2 * len(rows)
    with pytest.raises(ValueError):
        runs.periodic_runs(frame, min_repeats=2)


def test_query_on_odd_documents(spark, tmp_path):
    rng = random.Random(9)
    texts = odd_texts() + [prose(i, rng.randint(1, 300)) for i in range(120)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(None, "a " * 30, None, None, None)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(path)
    found = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()}
    for i, text, *_ in rows:
        words = split(text)
        h = None if i is None else zlib.crc32(str(i).encode())
        if words and h is not None and h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if j < a else words[a + (j - a) % p] for j, w in enumerate(words)]
        want, row = plain_runs(words), found[i]
        assert row.n_runs == len(want)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(kept(words, want).encode()).hexdigest()
        best = min(want, key=lambda r: (-r[1] / r[2], r[0], r[2])) if want else (None,) * 3
        assert (row.start, row.length, row.period) == best
        assert row.exponent_milli == (1000 * best[1] // best[2] if want else None)
