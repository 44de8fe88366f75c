"""The prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import regex

from claimtrace.llm import tries
from claimtrace.llm.queries import QUERIES

TURNS = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(convs: dict) -> list:
    """convs: id to its list of (role, text)."""
    members: dict = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda t: len(regex.findall(r"[^\x20\x09-\x0D]+", t))
    children: dict = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(own) - 1) * words(p[-1][1]) if p else 0
    rows = []
    for p, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        rows.append((min(own), len(p), parent, len(own), children[p], leaves[p], saved[p], digest))
    return sorted(rows, key=str)


def grown(rng, n: int) -> dict:
    """Conversations that branch off one another, with exact copies and one deep one."""
    convs: dict = {}
    for c in rng.sample(range(-50, 5 * n), n):
        base = convs[rng.choice(list(convs))] if convs and rng.random() < 0.7 else []
        turns = base[: rng.randint(0, len(base) + 1)]
        if rng.random() < 0.8:
            turns = turns + [(rng.choice("ua"), " ".join(["x"] * rng.randint(0, 4)) + rng.choice(["", "y"])) for _ in range(rng.randint(0, 3))]
        convs[c] = turns
    if n > 20:
        convs[10**12] = [("u", str(i)) for i in range(200)]
        convs[10**12 + 1] = convs[10**12][:150] + [("u", "other")]
    return convs


def found(df) -> list:
    return sorted((tuple(r) for r in df.select(tries.COLUMNS).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 40, 400])
def test_parentheses_find_their_partners(n):
    rng = random.Random(n)
    opens, depth = [], 0
    while len(opens) < 2 * n or depth:
        up = len(opens) + depth < 2 * n and (depth == 0 or rng.random() < rng.choice([0.3, 0.9]))
        opens.append(up)
        depth += 1 if up else -1
    stack, partner = [], {}
    for i, o in enumerate(opens):
        if o:
            stack.append(i)
        else:
            partner[stack.pop()] = i
    places = np.flatnonzero(opens)
    assert tries.Parentheses(np.array(opens)).close(places).tolist() == [partner[i] for i in places]


@pytest.mark.parametrize(("n", "shard_rows"), [(1, 500_000), (120, 500_000), (120, 1), (120, 60)])
def test_trie_of_paths(spark, monkeypatch, n, shard_rows):
    monkeypatch.setattr(tries, "SHARD_ROWS", shard_rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        convs = grown(random.Random(n + shard_rows), n)
        rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
        paths = tries.turn_paths(spark.createDataFrame(rows, TURNS))
        ids = spark.createDataFrame([(c,) for c in convs], "conv_id bigint")
        # conversations without a turn have a null path
        assert found(tries.prefix_trie(ids.join(paths, "conv_id", "left"))) == plain_trie(convs)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_first_turn_and_copies(spark, monkeypatch):
    monkeypatch.setattr(tries, "SHARD_ROWS", 30)
    convs = {c: [("u", "hello there")] + ([("a", "same answer")] if c % 3 else [("a", f"answer {c}")]) for c in range(300)}
    rows = [(c, i, *t) for c, turns in convs.items() for i, t in enumerate(turns)]
    assert found(tries.prefix_trie(tries.turn_paths(spark.createDataFrame(rows, TURNS)))) == plain_trie(convs)


def test_odd_turns(spark):
    rows = [(1, None, None, "first"), (1, 1, "u", None), (1, 1, "u", None), (None, 0, "u", "lost"), (2, 5, "", "first"), (3, 0, "u", "x " * 100_000)]
    frame = spark.createDataFrame([(*r, "clash", 0) for r in rows], TURNS + ", key string, depth int")
    convs = {1: [("", "first"), ("u", ""), ("u", "")], 2: [("", "first")], 3: [("u", "x " * 100_000)]}
    assert found(tries.prefix_trie(tries.turn_paths(frame))) == plain_trie(convs)
    assert tries.prefix_trie(tries.turn_paths(frame.limit(0))).count() == 0


def test_query_on_rebuilt_conversations(spark, tmp_path):
    rng = random.Random(4)
    convs = {c: t for c, t in grown(rng, 90).items() if t}
    rows = [(c, i, role, text) for c, turns in convs.items() for i, (role, text) in enumerate(turns)]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        # the remainder takes the sign of the id
        base = c - int(abs(c) % 20) * (1 if c > 0 else -1)
        rebuilt[c] = convs.get(base, [])[:h] + turns[h:]
    assert found(QUERIES["op12_prefix_trie"](spark, str(tmp_path))) == plain_trie(rebuilt)
