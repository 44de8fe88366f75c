"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is the sequence of its lower-cased words, a blank after each and an end instead of the last
blank. Its symbols are bytes, coded by a binary (Huffman) code of the training bytes, so that a
frequent byte takes few decisions. Each decision is predicted in several contexts: the last one, two
and three bytes, and the word so far. A predictor is the counts of zeros and ones in a slot, one for each
context and code node, known by a 32-bit hash; the slots are a table that grows with the input. Its log-odds, kept in LEVELS steps, are mixed by weights that are
gated by which contexts have been seen; the weights are learned online, and a table of what really
followed each combination refines the mixed probability (Mahoney 2005).

Training documents are split by crc32: one in seven trains weights and refinement, the others the
counts, so that no predictor is judged on what it counted. Scoring changes nothing in the model, so a
document's score does not depend on where or with what it is scored.
"""

import heapq
import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from claimtrace.llm.text import LOWER, NOT_SPACE, Slice, Words, give_back, mix, randoms, slices, small_batches
from claimtrace.sources import written

FOLDS, HELD_OUT, GATES = 7, 2, 5
CONTEXTS = 4
LEVELS = 16
WIDEST = 8.0
END = 10
BLANK = 32
MIN_CHUNK_BITS = 8
BYTES_PER_CHUNK = 1 << 24
SLICE = 1 << 21
PIECES_SLICE = 1 << 19
BLOCK = 1 << 16
HELD = 1 << 21
LAST = 1 << 62
BLOBS = ("slots", "counts", "levels", "data", "first", "keys")
HEAD = 1 << 18
#: kinds of counted rows; words that open or close a text have kinds of their own (4 + 1 and 4 + 2)
WORDS, ENDS, BYTES, HEADS = range(4)
#: what a lookup is for: count and score of a piece, or one of them
BOTH, COUNT, SCORE = range(3)
#: an empty text as HEADS have it
EMPTY = END + 1 << 9
ROUNDS = 3
START, RATE = 0.3, 0.02
LANE, LANES = 256, 1024
FIXED = 1 << 16
_U = np.uint64


# --- text as symbols -----------------------------------------------------------------------


def symbols(part: Slice, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts as they are coded, and where each text starts (one more at the end)."""
    counts = words.counts()
    sizes = words.end - words.start
    empty = counts == 0
    # an empty text is an end alone
    before = np.concatenate([[0], np.cumsum(empty)])
    owner = words.text_of()
    to = np.cumsum(sizes + 1) + before[owner]
    out = np.full(int((sizes + 1).sum() + empty.sum()), END, dtype=np.uint8)
    inside = np.ones(len(out), dtype=bool)
    inside[to - 1] = False
    lengths = np.concatenate([[0], np.cumsum(sizes + 1)])
    first = lengths[words.first] + before
    inside[first[:-1][empty]] = False
    out[inside] = LOWER[part.data[NOT_SPACE[part.data]]]
    out[to - 1] = BLANK
    out[first[1:] - 1] = END
    return out, first


def _contexts(data: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash of each context at each symbol; contexts don't reach before a text's start."""
    n = len(data)
    # three symbols that are none before each text
    at = np.arange(n) + 3 * np.repeat(np.arange(1, len(first)), np.diff(first))
    padded = np.zeros(n + 3 * (len(first) - 1), dtype=_U)
    padded[at] = data.astype(_U) + _U(1)
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (data[:-1] == BLANK) | (data[:-1] == END)
    start = np.zeros(len(padded), dtype=np.int64)
    start[at] = at
    start[at[~fresh]] = 0
    return _hashes(padded, np.maximum.accumulate(start), at)


def _hashes(padded: np.ndarray, word: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Contexts at the places ``at`` of symbols plus one (0 is none); ``word`` is where the word of each place starts."""
    grown, out = np.zeros(len(at), dtype=_U), []
    for j in range(3):
        grown = grown | (padded[at - (j + 1)] << _U(9 * j))
        out.append((mix(grown + _U(j << 60)) >> _U(32)).astype(np.uint32))
    # the word so far: sums of bytes times powers since the last blank or start
    depth = np.clip(np.arange(len(padded)) - word, 0, 63)
    power = randoms(307, 64)[depth] | _U(1)
    sums = np.concatenate([[_U(0)], np.cumsum(mix(padded * power))])
    out.append((mix(sums[at] - sums[word[at]] + _U(77)) >> _U(32)).astype(np.uint32))
    return out


# --- pieces of texts ---------------------------------------------------------------------------


class Pieces:
    """Pieces by kind with their bytes; every piece is some symbols after three that they depend on.

    Contexts of a symbol don't reach further back than three symbols or the start of its word. So the first
    two symbols of a word with the three before them are one piece (HEADS: five times nine bits, symbols plus one,
    0 is none; an empty text is an end alone), and the others of the word, with what ends it, another (WORDS; plus
    4, and 1 if it is the first of its text and 2 if it is the last). Equal pieces have equal decisions.
    """

    def __init__(self, kind: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        head, size = kind == HEADS, np.diff(offsets)
        pattern = data[np.repeat(head, size)].view("<u8")
        length = size + 2
        length[head] = np.where(pattern & _U(511), 5, 4)
        ends = np.cumsum(length)
        begin = ends - length
        padded = np.zeros(int(length.sum()), dtype=_U)
        for j in range(5):
            there = slice(None) if j < 4 else pattern & _U(511) > 0
            padded[begin[head][there] + j] = (pattern >> _U(9 * (4 - j)) & _U(511))[there]
        own, size = kind[~head], size[~head]
        put = np.arange(size.sum()) + np.repeat(begin[~head] + 1 - (np.cumsum(size) - size), size)
        padded[put] = data[np.repeat(~head, np.diff(offsets))].astype(_U) + _U(1)
        padded[begin[~head]] = np.where(own & 1, 0, BLANK + 1)
        padded[ends[~head] - 1] = np.where(own & 2, END + 1, BLANK + 1)
        self.size = length - 3
        self.first = np.cumsum(self.size) - self.size
        at = np.arange(self.size.sum()) + np.repeat(begin + 3 - self.first, self.size)
        self.symbols = (padded[at] - _U(1)).astype(np.uint8)
        self.contexts = _hashes(padded, np.repeat(begin + np.where(head, 3, 1), length), at)


class Parted:
    """The pieces that words are made of: ``head`` (as HEADS has it), ``key`` and ``kind`` of the rest, by word; ``empty`` texts."""

    def __init__(self, part: Slice, words: Words):
        data, counts = part.data, words.counts()
        some = counts > 0
        opens, closes = np.zeros(len(words.hash), dtype=bool), np.zeros(len(words.hash), dtype=bool)
        opens[words.first[:-1][some]] = True
        closes[words.first[1:][some] - 1] = True
        one = words.end - words.start == 1
        blank = np.where(opens, 0, BLANK + 1)

        def byte(at):
            return LOWER[data[at]].astype(np.int64) + 1

        last = byte(words.end - 1)
        before = np.where(one, blank, byte(np.maximum(words.end - 2, 0)))
        second = np.where(one, np.where(closes, END, BLANK) + 1, byte(np.minimum(words.start + 1, max(0, len(data) - 1))))
        pattern = byte(words.start) << 9 | second | blank << 18
        pattern[1:] |= np.where(opens[1:], 0, last[:-1] << 27 | before[:-1] << 36)
        self.head = pattern.astype(_U)
        edge = opens + 2 * closes
        self.kind = np.where(edge > 0, edge + 4, WORDS)
        self.key = np.where(edge > 0, mix(words.hash + edge.astype(_U) * _U(0x9E3779B97F4A7C15)), words.hash)
        self.empty = np.flatnonzero(~some)


def _head_key(pattern: np.ndarray) -> np.ndarray:
    return mix(pattern + _U(HEADS << 60))


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and where in it each distinct one starts."""
    order = np.argsort(keys)
    own = keys[order]
    return order, np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, dtype=np.int64)


def _bytes_of(part: Slice, words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of some words, one after the other, and where each starts (and the last ends)."""
    size = (words.end - words.start)[which]
    offsets = np.concatenate([[0], np.cumsum(size)])
    return LOWER[part.data[np.arange(offsets[-1]) + np.repeat(words.start[which] - offsets[:-1], size)]], offsets


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])


@dataclass
class Code:
    """Binary code of all bytes: for byte b, nodes and bits at start[b]:start[b] + size[b]."""

    size: np.ndarray
    start: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    """The Huffman code of counts + 1; every byte has a code, seen or not."""
    heap = [(int(c) + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    paths: dict[int, list[tuple[int, int]]] = {b: [] for b in range(256)}
    leaves = {b: [b] for b in range(256)}
    node = 256
    while len(heap) > 1:
        (a, x, i), (b, y, j) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, k in ((0, i), (1, j)):
            for leaf in leaves[k]:
                paths[leaf].append((node - 256, bit))
        leaves[node] = leaves.pop(i) + leaves.pop(j)
        heapq.heappush(heap, (a + b, min(x, y), node))
        node += 1
    size = np.array([len(paths[b]) for b in range(256)])
    flat = [p for b in range(256) for p in reversed(paths[b])]
    marks = (randoms(311, 256) >> _U(32)).astype(np.uint32)
    return Code(size, np.cumsum(size) - size, marks[[n for n, _ in flat]], np.array([b for _, b in flat], dtype=np.int64))


@dataclass
class Decisions:
    """The binary decisions of some pieces and the slots that they ask for.

    ``slots`` are sorted keys (context << 32 | hash of context and node), each once; ``n`` how often
    a zero and a one followed each. ``first`` and ``size`` are decisions by symbol; ``bit`` is by decision.
    """

    slots: np.ndarray
    n: np.ndarray
    first: np.ndarray
    size: np.ndarray
    bit: np.ndarray
    _place: list[np.ndarray]
    _begin: list[np.ndarray]

    def cells(self, levels: np.ndarray) -> np.ndarray:
        """The cell of each decision; ``levels`` of the slots, in their order."""
        inner = np.arange(len(self.bit)) - np.repeat(self.first, self.size)
        cell = np.zeros(len(inner), dtype=np.int32)
        for place, begin in zip(self._place, self._begin, strict=True):
            cell = cell * LEVELS + levels[place[np.repeat(begin, self.size) + inner]]
        return cell


def decisions(pieces: Pieces, often: np.ndarray, code: Code) -> Decisions:
    """Decisions by symbol, each counted as ``often`` as its piece; equal symbols in an equal context are worked out once."""
    weight = np.repeat(often, pieces.size)
    slots, n, places, begins, before = [], [], [], [], 0
    for k, context in enumerate(pieces.contexts):
        pair, inverse = np.unique(context.astype(_U) << _U(8) | pieces.symbols, return_inverse=True)
        times = np.bincount(inverse, weight, minlength=len(pair))
        byte = (pair & _U(255)).astype(np.int64)
        size = code.size[byte]
        begin = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(code.start[byte] - begin, size)
        own, place = np.unique(np.repeat((pair >> _U(8)).astype(np.uint32), size) ^ code.node[at], return_inverse=True)
        n.append(np.bincount(place * 2 + code.bit[at], np.repeat(times, size), minlength=2 * len(own)).astype(np.int64).reshape(-1, 2))
        slots.append(own.astype(_U) | _U(k << 32))
        places.append((place + before).astype(np.int32))
        begins.append(begin[inverse].astype(np.int32))
        before += len(own)
    size = code.size[pieces.symbols]
    first = np.cumsum(size) - size
    bit = code.bit[np.arange(size.sum()) + np.repeat(code.start[pieces.symbols] - first, size)]
    return Decisions(np.concatenate(slots), np.concatenate(n), first, size, bit, places, begins)


# --- model -----------------------------------------------------------------------------------


@dataclass
class Model:
    code: Code
    chunk_bits: int
    pieces: DataFrame  # slices of distinct pieces and the levels of the slots that they ask for
    slots: DataFrame  # chunk, slots, levels: the sorted slots of a chunk and a level of each
    log_p: np.ndarray = field(default_factory=lambda: np.zeros(0))  # cells x 2: log10 probability of each bit


def _level(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log-odds of a slot in LEVELS - 1 steps from 1 on; 0 without counts."""
    odds = np.log((ones + 0.4) / (zeros + 0.4))
    steps = np.rint((np.clip(odds, -WIDEST, WIDEST) / WIDEST + 1) / 2 * (LEVELS - 2)).astype(np.uint8) + 1
    return np.where(zeros + ones > 0, steps, 0).astype(np.uint8)


def _odds_of_level(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, ((level - 1) / (LEVELS - 2) * 2 - 1) * WIDEST, 0.0)


def _fold(docs: DataFrame) -> DataFrame:
    """doc_id, text and fold; a null id is in fold -1, which trains counts."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    return docs.select("doc_id", "text", F.coalesce(crc, F.lit(-1)).cast("int").alias("fold"))


def _counted(docs: DataFrame) -> DataFrame:
    """(kind, key, data, n, counted, often) of all pieces of ``docs`` (text, fold), ends of texts and bytes.

    ``n`` is how often a word, an end or a byte is there in training documents, ``counted`` how often a piece is
    there in those that train counts, ``often`` how often it is looked up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, letters = 0, np.zeros(256, dtype=np.int64)
        for part in slices(batches, "text", SLICE):
            words = Words(part, NOT_SPACE)
            fold = part.rows.column("fold").to_numpy()
            train = fold != HELD_OUT
            counting = train & (fold != GATES)
            some = train & (words.counts() > 0)
            texts += int(train.sum())
            seen = np.bincount(part.data[np.repeat(train, np.diff(part.offsets))], minlength=256)
            seen[~NOT_SPACE] = 0
            letters += np.bincount(LOWER, seen, minlength=256).astype(np.int64)
            letters[BLANK] += int(words.counts()[train].sum() - some.sum())
            yield from _counted_pieces(part, words, Parted(part, words), train, counting)
        letters[END] += texts
        at = np.flatnonzero(letters)
        n = np.append(letters[at], texts)
        yield _pieces_batch(np.append(np.full(len(at), BYTES), ENDS), np.append(at, 0), pa.array([b""] * len(n), pa.binary()), n, n * 0, n * 0)

    found = docs.select("text", "fold").mapInArrow(run, "kind int, key bigint, data binary, n bigint, counted bigint, often bigint")
    return found.groupBy("kind", "key", "data").agg(*[F.sum(c).alias(c) for c in ("n", "counted", "often")])


def _counted_pieces(part: Slice, words: Words, own: Parted, train: np.ndarray, counting: np.ndarray) -> Iterator[pa.RecordBatch]:
    text_of = words.text_of()
    in_train, in_counting = train[text_of].astype(np.int64), counting[text_of].astype(np.int64)
    inner = own.kind == WORDS
    order, edge = _distinct(words.hash)
    if len(edge):
        which = order[edge]
        n, counted = np.add.reduceat(in_train[order], edge), np.add.reduceat((in_counting * inner)[order], edge)
        often = np.diff(np.append(edge, len(order)))
        yield _pieces_batch(np.full(len(which), WORDS), words.hash[which], _binary(*_bytes_of(part, words, which)), n, counted, often)
    outer = np.flatnonzero(~inner)
    order, edge = _distinct(own.key[outer])
    if len(edge):
        which, order = outer[order[edge]], outer[order]
        counted, often = np.add.reduceat(in_counting[order], edge), np.diff(np.append(edge, len(order)))
        yield _pieces_batch(own.kind[which], own.key[which], _binary(*_bytes_of(part, words, which)), often * 0, counted, often)
    pattern = np.append(own.head, np.full(len(own.empty), EMPTY, dtype=_U))
    order, edge = _distinct(pattern)
    if len(edge):
        heads = pattern[order[edge]]
        counted = np.add.reduceat(np.append(in_counting, counting[own.empty])[order], edge)
        often = np.diff(np.append(edge, len(order)))
        data = _binary(heads.view(np.uint8), np.arange(len(heads) + 1) * 8)
        yield _pieces_batch(np.full(len(heads), HEADS), _head_key(heads), data, often * 0, counted, often)


def _pieces_batch(kind: np.ndarray, key: np.ndarray, data: pa.Array, *counts: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(kind.astype(np.int32)), pa.array(key.astype(_U).view(np.int64)), data, *(pa.array(c.astype(np.int64)) for c in counts)]
    return pa.RecordBatch.from_arrays(columns, ["kind", "key", "data", "n", "counted", "often"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n) of training documents: kind 0 words by hash, 1 ends of texts, 2 bytes as coded."""
    return _counted(docs).where(F.col("kind") < HEADS).select("kind", "key", "n")


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all parts, sorted and each once, and their counts added up."""
    slots = np.concatenate([p[0] for p in parts])
    order = np.argsort(slots)
    slots = slots[order]
    edge = np.flatnonzero(np.append(True, slots[1:] != slots[:-1])) if len(slots) else np.zeros(0, dtype=np.int64)
    n = np.concatenate([p[1] for p in parts])[order]
    return slots[edge], np.add.reduceat(n, edge) if len(edge) else n


def _chunks(slots: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Chunks of sorted slots: a range of each context's hashes."""
    chunk = slots >> _U(32 - bits)
    edge = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else np.zeros(0, dtype=np.int64)
    for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(chunk)], strict=False):
        yield int(chunk[a]), slice(a, b)


def _table(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k in BLOBS else pa.int64()) for k, v in columns.items()})


_ASKED = "slice bigint, chunk bigint, slots binary, counts binary, data binary, first binary, keys binary"
_ANSWERED = "slice bigint, chunk bigint, slots binary, levels binary, data binary, first binary, keys binary"
TABLE = -1


def _planes(values: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second ones and so on, as most are zero or rise slowly; Spark compresses these."""
    return np.ascontiguousarray(values.astype("<u4").ravel().view(np.uint8).reshape(-1, 4).T).tobytes()


def _of_planes(data: pa.BinaryScalar) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data.as_buffer(), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _asking(number: int, found: Decisions, bits: int, counted: bool, data: np.ndarray, first: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """Rows of a slice: the slots that it asks for, by chunk, each once, and what it is made of."""
    rows = [(c, _planes(found.slots[at]), _planes(found.n[at]) if counted else None) for c, at in _chunks(found.slots, bits)]
    columns = {"slice": [number] * (len(rows) + 1), "chunk": [*(c for c, _, _ in rows), LAST]}
    columns |= {"slots": [*(s for _, s, _ in rows), None], "counts": [*(n for *_, n in rows), None]}
    for name, values in (("data", data), ("first", first.astype(np.int64)), ("keys", keys)):
        columns[name] = [None] * len(rows) + [values.tobytes()]
    return _table(columns)


def _answered(asked: DataFrame, table: DataFrame | None, name: str) -> DataFrame:
    """Levels of the slots that slices ask for (slice, chunk, levels) and what slices are made of (slice, LAST, data, first, keys).

    Slots and their levels are those of ``table``. Without one they are what ``asked`` has counted, and come along as rows of
    the slice TABLE. A chunk meets all who ask for it in one task; the number of chunks grows with the training bytes, so that
    a chunk stays bounded.
    """

    counting = table is None

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(chunk):
            if known is None:
                slots, n = _summed(counted)
                seen = n.any(axis=1)
                slots, level = slots[seen], _level(n[seen, 0], n[seen, 1])
                out = [(TABLE, chunk, slots.tobytes(), level.tobytes())]
            else:
                (slots, level), out = known, []
            for number, own in asking:
                found = np.zeros(len(own), dtype=np.uint8)
                if len(slots):
                    place = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
                    found = np.where(slots[place] == own, level[place], 0).astype(np.uint8)
                out.append((number, chunk, None, found.tobytes()))
            columns = dict(zip(("slice", "chunk", "slots", "levels"), map(list, zip(*out, strict=True)), strict=True))
            return _table(columns | {c: [None] * len(out) for c in ("data", "first", "keys")})

        last, known, asking, counted, size = None, None, [], [], 0
        for batch in batches:
            chunks = batch.column("chunk").to_numpy()
            whole = batch.filter(pa.array(chunks == LAST))
            if whole.num_rows:
                yield whole.select(["slice", "chunk", "slots", "levels", "data", "first", "keys"])
            for i in np.flatnonzero(chunks < LAST).tolist():
                if chunks[i] != last and asking:
                    yield done(last)
                if chunks[i] != last:
                    last, known, asking, counted, size = int(chunks[i]), None if counting else (np.zeros(0, np.uint32), np.zeros(0, np.uint8)), [], [], 0
                number, slots, levels, n = batch.column("slice")[i].as_py(), batch.column("slots")[i], batch.column("levels")[i], batch.column("counts")[i]
                if number == TABLE:
                    known = np.frombuffer(slots.as_py(), np.uint32), np.frombuffer(levels.as_py(), np.uint8)
                    continue
                asking.append((number, _of_planes(slots)))
                if n.is_valid:
                    counted.append((asking[-1][1], _of_planes(n).astype(np.int64).reshape(-1, 2)))
                    size += len(counted[-1][0])
                    if size > 2 * HELD:
                        counted, size = [_summed(counted)], 0
        if asking:
            yield done(last)
        give_back()

    nothing = F.lit(None).cast("binary")
    rows = asked.withColumn("levels", nothing)
    if table is not None:
        names = {"slice": F.lit(TABLE).cast("bigint"), "chunk": F.col("chunk"), "slots": F.col("slots"), "levels": F.col("levels")}
        rows = rows.unionByName(table.select(*[names.get(c, nothing).alias(c) for c in rows.columns]))
    place = F.when(F.col("chunk") < LAST, F.col("chunk")).otherwise(F.xxhash64("slice"))
    return written(rows.repartition(place).sortWithinPartitions("chunk", "slice").mapInArrow(answer, _ANSWERED), name, compression="zstd")


def _slice_numbers() -> Iterator[int]:
    """Names for the slices of a task that no other task gives."""
    return itertools.count(TaskContext.get().partitionId() << 32)


def _asked_by_pieces(pieces: DataFrame, code, bits: int) -> DataFrame:
    """Slices of distinct pieces and, by chunk, the slots that they ask for and how often they were counted.

    A slice asks for each slot once, so that no slot is a hot key.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in zip(_slice_numbers(), _gathered(batches, PIECES_SLICE)):  # noqa: B905
            kind = rows.column("kind").to_numpy()
            data, offsets = _flat(rows.column("data"))
            found = decisions(Pieces(kind, data, offsets), rows.column("counted").to_numpy(), code.value)
            keys = np.stack([rows.column("key").to_numpy(), kind.astype(np.int64)])
            yield _asking(number, found, bits, True, data, offsets, keys)

    used = pieces.where(~F.col("kind").isin(ENDS, BYTES)).select("kind", "key", "data", "counted")
    return used.mapInArrow(ask, _ASKED)


def _asked_by_texts(docs: DataFrame, code, bits: int) -> DataFrame:
    """The same of slices of texts, for each of which a slice asks as for its distinct pieces."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part in zip(_slice_numbers(), slices(batches, "text", SLICE)):  # noqa: B905
            pieces, _, _ = _in_text(part)
            found = decisions(pieces, np.zeros(len(pieces.size)), code.value)
            yield _asking(number, found, bits, False, part.data, part.offsets, np.zeros(0, dtype=np.int64))

    return docs.select("text").mapInArrow(ask, _ASKED)


def _in_text(part: Slice) -> tuple[Pieces, np.ndarray, np.ndarray]:
    """Distinct pieces of texts; first symbol (among those of the pieces) and number of symbols of each piece in text order."""
    words = Words(part, NOT_SPACE)
    own = Parted(part, words)
    # a head and a rest for each word; an empty text is a head
    pattern = np.insert(own.head, words.first[own.empty], _U(EMPTY))
    heads, head = np.unique(pattern, return_inverse=True)
    order, edge = _distinct(own.key)
    rest = np.zeros(len(order), dtype=np.int64)
    rest[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(order))))
    data, offsets = _bytes_of(part, words, order[edge])
    kind = np.append(np.full(len(heads), HEADS), own.kind[order[edge]])
    pieces = Pieces(kind, np.append(heads.view(np.uint8), data), np.append(np.arange(len(heads)) * 8, offsets + 8 * len(heads)))
    number = np.insert(rest + len(heads), words.first[own.empty], -1)
    both = np.stack([head, number], axis=1).ravel()
    both = both[both >= 0]
    return pieces, pieces.first[both], pieces.size[both]


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their pieces have about ``size`` bytes."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += int(pc.sum(pc.binary_length(batch.column("data"))).as_py() or 0)
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, total = [], 0
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    give_back()


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def _together(answered: DataFrame) -> DataFrame:
    """Slices with the levels of the slots they ask for: rows sorted by slice, levels by chunk and then what the slice is made of."""
    return answered.drop("slots").repartition("slice").sortWithinPartitions("slice", "chunk")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Levels, data, offsets and keys of each slice."""
    levels = []
    for batch in batches:
        for chunk, level, data, first, keys in zip(*(batch.column(c) for c in ("chunk", "levels", "data", "first", "keys")), strict=True):
            if chunk.as_py() < LAST:
                levels.append(np.frombuffer(level.as_py(), np.uint8))
                continue
            yield (
                np.concatenate([np.zeros(0, np.uint8), *levels]),
                np.frombuffer(data.as_buffer(), np.uint8),
                np.frombuffer(first.as_buffer(), np.int64),
                np.frombuffer(keys.as_buffer(), np.int64),
            )
            levels = []


def train(docs: DataFrame, counts: DataFrame, pieces: DataFrame | None = None) -> Model:
    """Counts, weights and refinement from documents with a fold; ``counts`` as from word_counts, ``pieces`` as from _counted.

    Slots and their levels stay a table, which grows with the contexts that training documents hold.
    """
    spark = docs.sparkSession
    letters = np.zeros(256, dtype=np.int64)
    for row in counts.where("kind = 2").collect():  # at most 256 rows
        letters[row.key] = row.n
    code = huffman(letters)
    bits = int(max(MIN_CHUNK_BITS, np.ceil(np.log2(max(1, letters.sum() / BYTES_PER_CHUNK)))))
    shared = spark.sparkContext.broadcast(code)
    found = _answered(_asked_by_pieces(_counted(docs) if pieces is None else pieces, shared, bits), None, "lm-slots")
    model = Model(code, bits, found.where(F.col("slice") != TABLE), found.where(F.col("slice") == TABLE).select("chunk", "slots", "levels"))

    texts = _answered(_asked_by_texts(docs.where(F.col("fold") == GATES), shared, bits), model.slots, "lm-slices")
    weights, seen = np.full((1 << CONTEXTS, CONTEXTS), START), np.zeros((LEVELS**CONTEXTS, 2))
    for number in range(ROUNDS):
        own = texts.where(F.pmod(F.xxhash64("slice"), F.lit(ROUNDS)) == number)
        weights, more = _round(_together(own), shared, weights)
        seen += more
    model.log_p = _mixed(seen, weights)
    return model


def _round(slices_: DataFrame, code, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights after the bits of all slices, and how often each bit followed each cell.

    Every slice starts from the same weights and moves its own online; Spark averages them, by the
    decisions of each gate. Weights are added up in fixed point, so that their order does not matter.
    """
    start = slices_.sparkSession.sparkContext.broadcast(weights)
    cells = 2 * LEVELS**CONTEXTS

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells, dtype=np.int64)
        moved = np.zeros((2, *weights.shape), dtype=np.int64)
        for levels, data, offsets, _ in _met(batches):
            text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            pieces, first, size = _in_text(Slice(pa.RecordBatch.from_arrays([text], ["text"]), "text"))
            found = decisions(pieces, np.zeros(len(pieces.size)), code.value)
            own, passed = start.value.copy(), np.zeros(1 << CONTEXTS, dtype=np.int64)
            for cell, bit in _in_text_order(found, levels, first, size):
                seen += np.bincount(cell.astype(np.int64) * 2 + bit, minlength=cells)
                passed += learn(own, cell, bit)
            moved[0] += np.rint(own * FIXED).astype(np.int64) * passed[:, None]
            moved[1] += passed[:, None]
        at = np.flatnonzero(seen)
        key = np.append(at, cells + np.arange(weights.size))
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.append(seen[at], moved[1])), pa.array(np.append(seen[at] * 0, moved[0]))], ["key", "n", "moved"])

    found = slices_.mapInArrow(follow, "key bigint, n bigint, moved bigint")
    rows = found.groupBy("key").agg(F.sum("n").alias("n"), F.sum("moved").alias("moved")).toArrow()
    n, moved = np.zeros(cells + weights.size), np.zeros(cells + weights.size)
    n[rows.column("key").to_numpy()] = rows.column("n").to_numpy()
    moved[rows.column("key").to_numpy()] = rows.column("moved").to_numpy()
    passed, moved = n[cells:].reshape(weights.shape), moved[cells:].reshape(weights.shape)
    return np.where(passed > 0, moved / FIXED / np.maximum(passed, 1), weights), n[:cells].reshape(-1, 2)


def _in_text_order(found: Decisions, levels: np.ndarray, first: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Cells and bits of a text, BLOCK symbols at a time, from those of its distinct pieces."""
    cells = found.cells(levels)
    symbol = np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)
    for at in range(0, len(symbol), BLOCK):
        own = symbol[at : at + BLOCK]
        n = found.size[own]
        which = np.arange(n.sum()) + np.repeat(found.first[own] - (np.cumsum(n) - n), n)
        yield cells[which], found.bit[which]


def _inputs(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each context in a cell, and its gate: which contexts have been seen."""
    level = np.stack([cells // LEVELS ** (CONTEXTS - 1 - k) % LEVELS for k in range(CONTEXTS)], axis=1)
    return _odds_of_level(level), (level > 0) @ (1 << np.arange(CONTEXTS))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@lru_cache(maxsize=1)
def _all_inputs() -> tuple[np.ndarray, np.ndarray]:
    return _inputs(np.arange(LEVELS**CONTEXTS))


def learn(weights: np.ndarray, cell: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Moves ``weights`` bit by bit along the gradient of the coding cost; decisions of each gate.

    Lanes, stretches of the text of equal length, are walked side by side: each step codes the next
    bit of every lane and then moves the weights of a gate by its lanes' mean.
    """
    inputs, gates = _all_inputs()
    each = np.eye(len(weights))
    lanes = int(np.clip(len(cell) // LANE, 1, LANES))
    steps = -(-len(cell) // lanes)
    for step in range(steps):
        own = cell[step::steps]
        g, x = gates[own], inputs[own]
        error = bit[step::steps] - _logistic(np.einsum("ij,ij->i", weights[g], x))
        move = each[g].T @ (error[:, None] * x)
        weights += RATE * move / np.maximum(np.bincount(g, minlength=len(weights)), 1)[:, None]
    return np.bincount(gates[cell], minlength=len(weights))


def _mixed(seen: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of zero and one in each cell: the gated mixture, blended with its refinement.

    The refinement moves from the mixture towards what followed the cell, by one part in n + 16 at
    its n-th bit; both have an equal share of the result, however much was seen.
    """
    inputs, gate = _inputs(np.arange(LEVELS**CONTEXTS))
    weights = np.full((1 << CONTEXTS, CONTEXTS), START) if weights is None else weights
    p = np.clip(_logistic((weights[gate] * inputs).sum(axis=1)), 1e-5, 1 - 1e-5)
    refined = (seen[:, 1] + 16 * p) / (seen.sum(axis=1) + 16)
    p = np.clip((p + refined) / 2, 1e-6, 1 - 1e-6)
    return np.log10(np.stack([1 - p, p], axis=1))


# --- scoring -----------------------------------------------------------------------------------


def score(docs: DataFrame) -> DataFrame:
    """Scores of all rows of ``docs`` (doc_id, text), learned from those not held out.

    doc_id, held_out (crc32 of the id as text modulo 7 is 2), n_tokens, n_known, train_tokens,
    base_score, score (log10 probability of the text under the model) and bits_per_byte. Tokens are
    words and one end. A null text is empty, an end alone; a null id trains and is not held out.
    Repeated rows count and are scored as often. Without training documents no token is known and
    every decision is even.

    The model scores each distinct piece once, and a text is the sum of its pieces. Counts and scores of pieces
    stay a table. The HEAD most frequent pieces, a list of fixed size, go to the tasks;
    each other piece occurs fewer times than any of them, so the join that looks the others up has
    no hot key.
    """
    with small_batches(docs.sparkSession):
        return _score(_fold(docs))


def _score(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    pieces = written(_counted(docs), "lm-words", compression="zstd")
    counts = pieces.where(F.col("kind") < HEADS).select("kind", "key", "n")
    facts = counts.where("kind < 2 and n > 0").agg(F.sum("n"), F.count("*")).first()
    tokens, distinct = int(facts[0] or 0), int(facts[1] or 0)
    ends = counts.where("kind = 1").agg(F.sum("n")).first()[0] or 0
    log_total = float(np.log10(tokens + distinct + 1))
    model = train(docs, counts, pieces)
    known = written(pieces.where(~F.col("kind").isin(ENDS, BYTES)).select("key", "n", "often").join(_scored(model), "key"), "lm-scores")
    top = known.orderBy(F.col("often").desc(), "key").limit(HEAD).select("key", "n", "score").toArrow()
    key, n, own = (top.column(c).to_numpy() for c in ("key", "n", "score"))
    order = np.argsort(key)
    head = spark.sparkContext.broadcast((key[order], n[order] > 0, np.log10(n[order] + 1.0), own[order]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", SLICE):
            words = Words(part, NOT_SPACE)
            own = Parted(part, words)
            text_of = words.text_of()
            inner = own.kind == WORDS
            outer = np.flatnonzero(~inner)
            row_no = part.rows.column("row_no").to_numpy()
            sums = np.zeros((3, len(part)))
            missed = []
            lookups = (
                (np.where(inner, BOTH, COUNT), words.hash, text_of),
                (np.full(len(outer), SCORE), own.key[outer], text_of[outer]),
                (np.full(len(text_of) + len(own.empty), SCORE), _head_key(np.append(own.head, np.full(len(own.empty), EMPTY, dtype=_U))), np.append(text_of, own.empty)),
            )
            for what, keys, text in lookups:
                hit, counted, logs, scores = _in_head(keys, head.value)
                for k, values in ((0, np.where(what != SCORE, counted, 0)), (1, np.where(what != SCORE, logs, 0)), (2, np.where(what != COUNT, scores, 0))):
                    sums[k] += np.bincount(text, values, minlength=len(part))
                rest = np.flatnonzero(~hit)
                missed.append((keys[rest], row_no[text[rest]], what[rest]))
            n_bytes = np.bincount(text_of, words.end - words.start + 1, minlength=len(part)).astype(np.int64)
            n_bytes[own.empty] = 1
            yield _measured(
                part.rows.num_rows,
                {"row_no": row_no, "doc_id": part.rows.column("doc_id"), "fold": part.rows.column("fold"), "n_tokens": words.counts() + 1}
                | {"head_known": sums[0].astype(np.int64), "head_log": sums[1], "head_score": sums[2], "n_bytes": n_bytes},
            )
            keys, rows, what = (np.concatenate(c) for c in zip(*missed, strict=True))
            yield _measured(len(keys), {"row_no": rows, "key": keys.view(np.int64), "what": what.astype(np.int32)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"row_no bigint, doc_id {kind}, fold int, n_tokens bigint, head_known bigint, head_log double, head_score double, n_bytes bigint, "
        "key bigint, what int"
    )
    doc_type = to_arrow_type(docs.schema["doc_id"].dataType)
    types = [pa.int64(), doc_type, pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()]
    named = dict(zip((c.split()[0] for c in schema.split(", ")), types, strict=True))

    def _measured(n: int, columns: dict) -> pa.RecordBatch:
        out = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in named.items()]
        return pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(out, named.values(), strict=True)], list(named))

    # rows and lookups are joined by numbers, so these are fixed first
    numbered = docs.withColumn("row_no", F.monotonically_increasing_id()).select("row_no", "doc_id", "text", "fold")
    measured = written(numbered.mapInArrow(measure, schema), "lm-rows")
    looked_up = (
        measured.where(F.col("what").isNotNull()).select("key", "row_no", "what")
        .join(known.select("key", "n", "score"), "key")
        .groupBy("row_no")
        .agg(
            F.sum(((F.col("what") != SCORE) & (F.col("n") > 0)).cast("bigint")).alias("known"),
            F.sum(F.when(F.col("what") != SCORE, F.log10(F.col("n") + 1)).otherwise(0.0)).alias("log"),
            F.sum(F.when(F.col("what") != COUNT, F.col("score")).otherwise(0.0)).alias("rest"),
        )
    )
    base = F.col("head_log") + F.coalesce("log", F.lit(0.0)) + F.lit(float(np.log10(ends + 1.0))) - F.col("n_tokens") * F.lit(log_total)
    total = F.col("head_score") + F.coalesce("rest", F.lit(0.0))
    return measured.where(F.col("what").isNull()).drop("key", "what").join(looked_up, "row_no", "left").select(
        "doc_id",
        (F.col("fold") == HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        base.alias("base_score"),
        total.alias("score"),
        (-total * F.lit(float(np.log2(10.0))) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _scored(model: Model) -> DataFrame:
    """key and score (log10 probability) of each distinct piece."""
    context = model.pieces.sparkSession.sparkContext
    code, log_p = context.broadcast(model.code), context.broadcast(model.log_p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for levels, data, offsets, keys in _met(batches):
            key, kind = keys.reshape(2, -1)
            pieces = Pieces(kind, data, offsets)
            found = decisions(pieces, np.zeros(len(kind)), code.value)
            gained = np.append(0.0, np.cumsum(log_p.value[found.cells(levels), found.bit]))
            edge = np.append(found.first, len(found.bit))
            own = gained[edge[pieces.first + pieces.size]] - gained[edge[pieces.first]]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own)], ["key", "score"])

    return _together(model.pieces).mapInArrow(run, "key bigint, score double")


def _in_head(keys: np.ndarray, head) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which pieces are in the head; of those that are, whether their count is above 0, the log10 of count + 1, and their scores."""
    key, *columns = head
    if not len(key):
        return (np.zeros(len(keys), dtype=bool), *(np.zeros(len(keys)) for _ in columns))
    own = keys.view(np.int64)
    place = np.minimum(np.searchsorted(key, own), len(key) - 1)
    hit = key[place] == own
    return (hit, *(np.where(hit, c[place], 0) for c in columns))
