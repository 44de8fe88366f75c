"""Document fingerprints by a randomised edit embedding.

A walk over the characters of a text repeats each character at random: at step j the walk stays or
moves on as a shared random bit of (j, character) says (Chakraborty, Goldenberg, Koucky 2016). Walks
over texts with few edits meet again after each edit, so edit distance becomes Hamming distance of
what the walks emit. Texts are cut at content-defined places and each piece is walked from its start;
bits of a fingerprint are majorities over sampled steps of all walks.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from claimtrace.llm.graph import components
from claimtrace.llm.text import cut, mix, randoms
from claimtrace.sources import written

BITS = 256
BLOCKS = BITS // 8
MASK = 127
LEAST, MOST = 32, 768
CONTEXT = 6
SLICE = 2 << 20
MORE = 0.05
_U = np.uint64

_STEP = randoms(211, 2 * MOST + 1024)
_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int16) * 2 - 1


def _pieces(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of pieces: after places that the CONTEXT code points there choose, and each MOST at the latest."""
    n = len(points)
    state = np.zeros(n, dtype=_U)
    for j, factor in enumerate(randoms(223, CONTEXT) | _U(1)):
        state[j:] += points[: n - j] * factor
    chosen = np.flatnonzero((mix(state) & _U(MASK)) == 0) + 1
    owner = np.searchsorted(first, chosen, side="right") - 1
    # none within the first code points of a text: what is before them is not its own
    chosen = chosen[(chosen - first[owner] >= LEAST) & (chosen < n)]
    starts = np.unique(np.concatenate([first[:-1][first[:-1] < first[1:]], chosen]))
    sizes = np.diff(np.append(starts, n))
    if (sizes > MOST).any():
        parts = -(-sizes // MOST)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + inner * MOST
    return starts


def fingerprints(texts: list[str]) -> np.ndarray:
    """BITS bits of each text, one row of bytes each; equal texts have equal rows.

    A piece that several places have, as an edited text shares most with its first form, is walked once.
    """
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first = np.concatenate([[0], np.cumsum(lengths)])
    raw = "".join(texts).encode("utf-32-le")
    points = np.frombuffer(raw, dtype=np.uint32).astype(_U)
    votes = np.zeros((len(texts), BITS), dtype=np.int64)
    left = np.zeros(len(texts), dtype=_U)
    if len(points):
        starts = _pieces(points, first)
        ends = np.append(starts[1:], len(points))
        number: dict[bytes, int] = {}
        which = np.fromiter((number.setdefault(raw[4 * a : 4 * b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.int64, count=len(starts))
        once = np.unique(which, return_index=True)[1]
        own_votes, state = _walk(mix(points), starts[once], ends[once])
        own_votes, state = own_votes[which], state[which]
        owner = np.searchsorted(first, starts, side="right") - 1
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        votes[owner[begin]] = np.add.reduceat(own_votes, begin, axis=0, dtype=np.int64)
        left[owner[begin]] = np.add.reduceat(state, begin)
    # ties, as in very short texts, go by the letters and not all the same way
    ties = np.unpackbits(mix(left[:, None] + randoms(227, BITS // 64)[None, :]).view(np.uint8), axis=1)
    return np.packbits(np.where(votes == 0, ties, votes > 0).astype(np.uint8), axis=1)


def _walk(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Walks all pieces at once: votes of each for the bits, and a hash of what it emitted.

    A step votes on the eight bits of its block, by a hash of the last letters emitted; so that bits
    tell texts of the same letters apart. Pieces that have ended leave the walk now and then.
    """
    order = np.argsort(starts - ends, kind="stable")
    votes = np.zeros((len(starts), BLOCKS, 8), dtype=np.int16)
    final = np.zeros(len(starts), dtype=_U)
    piece, at, end = order, starts[order].copy(), ends[order]
    state = np.zeros(len(order), dtype=_U)
    step = 0
    while len(piece):
        here = letters[at]
        state = (state << _U(7)) ^ (here >> _U(3))
        mixed = (state ^ _STEP[step]) * _U(0x9E3779B97F4A7C15)
        votes[piece, step % BLOCKS] += _SIGNS[(mixed >> _U(56)).astype(np.intp)]
        at = at + (((here * (_STEP[step] | _U(1))) >> _U(63)).astype(np.int64) | (step & 3 == 3))
        step += 1
        on = at < end
        if not on.all():
            final[piece[~on]] = mix(state[~on])
            piece, at, end, state = piece[on], at[on], end[on], state[on]
    return votes.reshape(len(starts), BITS), final


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 for fingerprints that differ in half their bits or more, 1 for equal ones."""
    differ = np.bitwise_count(a ^ b).sum(axis=1)
    return np.round(np.maximum(0.0, np.cos(np.pi * differ / BITS)), 6)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint (hex) of every whole text; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cut(batches, "text", SLICE):
            texts = [t or "" for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, texts), pa.int64()), _hex(fingerprints(texts))], ["doc_id", "n_chars", "fingerprint"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars bigint, fingerprint string")


def _hex(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes().hex() for r in rows], pa.string())


def near_links(prints: DataFrame, differ: int = 32) -> DataFrame:
    """Links (a, b, differ) between fingerprints that differ in at most ``differ`` bits.

    ``prints`` has doc_id and fingerprint. Equal fingerprints are one first. The bits are dealt over
    ``differ`` // 3 + 1 bands, so a pair to be linked differs in at most two bits of some band; a row is
    in the bucket of its band and of each band one bit from it, where such a pair meets. In rounds, rows of a
    band's bucket meet one pivot each, another one every round, which is linear in the bucket; what is linked
    becomes a component, and once hardly any component grows, rows of a bucket that are in
    different components all meet. Links are thus not all pairs of a group, but lead to all its
    members: the components are those of all pairs. Null ids and fingerprints are left out; of a
    repeated id all fingerprints count.
    """
    one = written(prints.where("doc_id is not null and fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id")), "prints")
    places = np.array_split(np.argsort(randoms(229, BITS)), differ // 3 + 1)
    exact = F.array(*[_sampled("fingerprint", band) for band in (p.tolist() for p in places)])
    around = F.array(F.col("own"), *[F.col("own").bitwiseXOR(F.lit(1 << i).cast("bigint")) for i in range(len(places[0]))])
    banded = one.select(F.col("fingerprint").alias("node"), F.posexplode(exact).alias("band", "own"))
    # a node is a fingerprint: a repeated id has several
    rows = written(banded.select("node", "band", F.explode(around).alias("key")), "print-bands")
    links, labels, grown, number = None, None, 1.0, 0
    while grown > MORE:
        marked = _labelled(rows, labels)
        turn = F.struct(F.xxhash64("node", "band", F.lit(number)).alias("turn"), "node", "label")
        pivots = marked.groupBy("band", "key").agg(F.min(turn).alias("p"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
        met = marked.join(pivots, ["band", "key"]).where("label <> p.label").select("node", F.col("p.node").alias("other"))
        found = _near(met, differ)
        links = found if links is None else links.union(found)
        before, labels, number = labels, written(components(links.select("a", "b")), "print-labels"), number + 1
        merges = [0 if x is None else x.where("node <> label").count() for x in (before, labels)]
        grown = (merges[1] - merges[0]) / max(1, merges[1])
    marked = _labelled(rows, labels)
    mixed = marked.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    left = marked.join(mixed.select("band", "key"), ["band", "key"])
    other = left.select("band", "key", F.col("node").alias("other"), F.col("label").alias("o_label"))
    met = left.join(other, ["band", "key"]).where("label <> o_label and node < other").select("node", "other")
    links = links.union(_near(met, differ))
    for side in "ab":
        named = one.select(F.col("fingerprint").alias(side), F.col("doc_id").alias(f"{side}_id"))
        links = links.join(named, side)
    pairs = links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "differ").where("a <> b").distinct()
    copies = prints.join(one.select(F.col("doc_id").alias("a"), "fingerprint"), "fingerprint").where("doc_id <> a")
    return pairs.union(copies.select("a", F.col("doc_id").alias("b"), F.lit(0).alias("differ")))


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows with the component of their node, the node itself where it has no links."""
    if labels is None:
        return rows.withColumn("label", F.col("node"))
    named = labels.select(F.col("node").alias("n_"), "label")
    return rows.join(named, rows["node"] == named["n_"], "left").select(*rows.columns, F.coalesce("label", "node").alias("label"))


def _near(met: DataFrame, differ: int) -> DataFrame:
    """(a, b, differ) of the pairs that are near enough, each once, a the lesser."""
    near = met.withColumn("differ", _distance("node", "other")).where(F.col("differ") <= differ)
    return written(near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "differ").distinct(), "print-links")


def _word(column: str, i: int) -> Column:
    """Eight hex digits of a fingerprint as a number."""
    return F.conv(F.substring(column, 8 * i + 1, 8), 16, 10).cast("bigint")


def _sampled(column: str, places: list[int]) -> Column:
    out = F.lit(0).cast("bigint")
    for p in places:
        bit = F.shiftright(_word(column, p // 32), 31 - p % 32).bitwiseAND(F.lit(1))
        out = F.shiftleft(out, 1).bitwiseOR(bit)
    return out


def _distance(a: str, b: str) -> Column:
    return sum((F.bit_count(_word(a, i).bitwiseXOR(_word(b, i))) for i in range(BITS // 32)), F.lit(0))


def with_edits(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they are.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document by ascending doc_id, after the last the first. Rows that repeat an id
    follow each other by a hash of the text; null ids come first. A null text is empty; without
    rows there is no result, and a single row is its own next.

    Texts move once, dealt by ranges of ids into ``parts`` (by default the shuffle partitions); the first row
    of each range goes to the range before it as well, so each task finds its last next row.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)).cast("bigint"))
    rows = docs.select("doc_id", "text", key.alias("k"), F.xxhash64("text").alias("h"))
    steps = [i / parts for i in range(1, parts)]
    bounds = sorted({int(b) for b in rows.agg(F.percentile_approx("k", steps, 10_000).alias("b")).first().b or []}) if steps else []
    # a range starts after its bound; ranges without rows have no first row
    dealt = rows.withColumn("range", _between(bounds).cast("int"))
    firsts = dealt.groupBy("range").agg(F.min(F.struct("k", "h")).alias("m")).select("range", "m.k", "m.h")
    heads = sorted((r.range, r.k, r.h) for r in firsts.collect())  # a row for each range
    if not heads:
        return docs.sparkSession.createDataFrame([], _schema(kind))
    before = {(k, h): heads[i - 1][0] for i, (_, k, h) in enumerate(heads)}
    table = docs.sparkSession.createDataFrame([(k, h, r) for (k, h), r in before.items()], "k bigint, h bigint, previous int")
    marked = dealt.join(F.broadcast(table), ["k", "h"], "left")
    twice = F.when(
        F.col("previous").isNotNull(),
        F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("tail")), F.struct(F.col("previous").alias("range"), F.lit(True).alias("tail"))),
    ).otherwise(F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("tail"))))
    sent = marked.select("doc_id", "text", "k", "h", F.explode(twice).alias("to")).select("doc_id", "text", "k", "h", "to.range", "to.tail")
    ordered = sent.repartition(parts, "range").sortWithinPartitions("range", "tail", "k", "h").select("doc_id", "text", "range", "tail")
    return ordered.mapInArrow(_edited, _schema(kind))


def _between(bounds: list[int]) -> Column:
    """Number of bounds below k, by halving."""
    if not bounds:
        return F.lit(0)
    mid = len(bounds) // 2
    return F.when(F.col("k") > bounds[mid], F.lit(mid + 1) + _between(bounds[mid + 1 :])).otherwise(_between(bounds[:mid]))


def _schema(kind: str) -> str:
    return (
        f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order, each range ended by its tail; a row waits for the one after it."""
    rest: pa.Table | None = None
    for part in cut(batches, "text", SLICE):
        table = pa.Table.from_batches([part]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([part])])
        yield from _finished(table)
        rest = table.slice(table.num_rows - 1)


def _finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Results of all rows of the table but the last; tails and rows after another tail give none."""
    texts = [t or "" for t in table.column("text").to_pylist()]
    tail = table.column("tail").to_pylist()
    rows = [i for i in range(len(texts) - 1) if not tail[i]]
    if not rows:
        return
    edited = []
    for i in rows:
        n = len(texts[i]) // 4
        edited.append(texts[i][: len(texts[i]) - n] + texts[i + 1][:n])
    both = fingerprints(texts + edited)
    own, changed, at = both[: len(texts)], both[len(texts) :], np.array(rows)
    yield pa.RecordBatch.from_arrays(
        [
            table.column("doc_id").take(pa.array(rows)).combine_chunks(),
            pa.array([len(texts[i]) for i in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            _hex(own[at]),
            _hex(changed),
            pa.array(likeness(own[at], changed)),
            pa.array(likeness(own[at], own[at + 1])),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )
