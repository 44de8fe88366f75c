"""Files of token ids, in the order of the documents, packed by an adaptive context-mixing range coder.

A file is Parquet with one row per chunk: the ids of its documents, how many token ids each has,
and a payload. A payload cuts the chunk's token ids into blocks of BLOCK_IDS. Every block starts from
an empty model and carries a checksum of its ids, so it can be read, and found damaged, by itself.

Each id is coded under a mixture of three predictions: the id that followed the last two, the
id that followed the last one, and the frequencies of all ids of the block so far (order 2, 1
and 0). Weights of the mixture are gated by how often the two candidates have been right
and by which orders were right last, two gates that are averaged and move with every id.
Frequencies are counted anew when the block has doubled; an id that is not among them is
spelled out. All of it is in whole numbers, so that every machine reads what another wrote.

The blocks of a chunk go forward in step, one id of every block at a time, as numpy vectors.
"""

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from claimtrace.llm.bpe import BEYOND_LATIN, LATIN, NUMBERS, tokenizer_file
from claimtrace.llm.text import cut
from claimtrace.sources import read_rows, write_rows

BLOCK_IDS = 4096
#: token ids after which a chunk ends with its document
CHUNK_IDS = 2 << 20
MAGIC = b"IDB1"
CACHE_PIECES = 200_000
#: the piece pattern of byte-level BPE files (fixed values), its classes spelled out for characters up to U+02C1
BLANKS = r"\t-\r \x85\xa0"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[{NUMBERS}]+| ?[^{LATIN}{NUMBERS}{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"

FIRST_COUNT = 64
ZERO_BITS = 12
SLOTS = (2048, 4096)
_FULL = 1 << 16


# --- the model ---------------------------------------------------------------------------------


class _Zero:
    """Frequencies of the ids of blocks so far, out of 2^12 with a share for ids not among them."""

    def __init__(self, seen: np.ndarray):
        blocks, n = seen.shape
        own = np.sort(seen, axis=1, kind="stable")
        new = np.ones(own.shape, dtype=bool)
        new[:, 1:] = own[:, 1:] != own[:, :-1]
        place = np.flatnonzero(new)
        self.ids, self.block = own.ravel()[place].astype(np.int64), place // n
        count = np.diff(np.append(place, blocks * n))
        distinct = np.bincount(self.block, minlength=blocks)
        once = np.bincount(self.block[count == 1], minlength=blocks)
        room = (1 << ZERO_BITS) - distinct - 16 - (once << 10) // n
        self.freq = 1 + count * room[self.block] // n
        ends = np.cumsum(self.freq)
        self.first = np.cumsum(distinct) - distinct
        before = (ends - self.freq)[self.first]
        self.start = ends - self.freq - before[self.block]
        self.rest = np.bincount(self.block, self.freq, minlength=blocks).astype(np.int64)

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Entry of each id of each block, -1 where there is none."""
        out, own = np.full(ids.shape, -1, dtype=np.int32), self.ids
        if max(ids.max(initial=0), own.max(initial=0)) >= _FULL:
            # large ids are numbered first
            named = np.unique(np.concatenate([own, ids.ravel()]))
            own, ids = np.searchsorted(named, own), np.searchsorted(named, ids)
        width = int(max(ids.max(initial=0), own.max(initial=0))) + 1
        step = max(1, (1 << 22) // width)
        table = np.full((step, width), -1, dtype=np.int32)
        ends = np.append(self.first, len(self.ids))
        for at in range(0, len(ids), step):
            rows = ids[at : at + step]
            mine = slice(ends[at], ends[min(at + step, len(ids))])
            where = self.block[mine] - at, own[mine]
            table[where] = np.arange(mine.start, mine.stop)
            out[at : at + step] = table[np.arange(len(rows))[:, None], rows]
            table[where] = -1
        return out

    def slots(self) -> np.ndarray:
        """Entry of each of the 2^12 places of each block, -1 in the share of other ids."""
        table = np.full((len(self.rest), 1 << ZERO_BITS), -1, dtype=np.int32)
        inside = np.arange(1 << ZERO_BITS) < self.rest[:, None]
        table[inside] = np.repeat(np.arange(len(self.ids)), self.freq)
        return table.ravel()


class _Model:
    """Candidates of order 1 and 2 and the gates, for many blocks at once."""

    def __init__(self, blocks: int, wide: bool):
        # an id, one more, with three bits of confidence
        kind = np.int64 if wide else np.int32
        self.one, self.two = (np.zeros(blocks * size, dtype=kind) for size in SLOTS)
        self.base_one, self.base_two = (np.arange(blocks) * size for size in SLOTS)
        # chance that order 2 is right, and that order 1 is where order 2 is not
        self.sure = [np.full(blocks * 128, _FULL // 4) for _ in range(2)]
        self.lately = [np.full(blocks * 32, _FULL // 4) for _ in range(2)]
        self.base_sure, self.base_lately = np.arange(blocks) * 128, np.arange(blocks) * 32
        self.last = np.zeros(blocks, dtype=np.int64)
        self.before = np.zeros(blocks, dtype=np.int64)
        self.right = np.zeros(blocks, dtype=np.int64)

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights of order 2 and 1 for the next id of the first n blocks, out of 2^16."""
        last, before = self.last[:n], self.before[:n]
        self.at_one = self.base_one[:n] + ((last * 40503 >> 3) & SLOTS[0] - 1)
        self.at_two = self.base_two[:n] + ((last * 40503 + before * 25717 >> 3) & SLOTS[1] - 1)
        self.e1, self.e2 = self.one[self.at_one].astype(np.int64), self.two[self.at_two].astype(np.int64)
        self.c1, self.c2 = self.e1 >> 3, self.e2 >> 3
        self.at_sure = self.base_sure[:n] + ((self.e2 & 7) << 4 | (self.e1 & 7) << 1 | (self.c1 == self.c2))
        self.at_lately = self.base_lately[:n] + self.right[:n]
        self.two_sure, self.two_lately = self.sure[0][self.at_sure], self.lately[0][self.at_lately]
        self.one_sure, self.one_lately = self.sure[1][self.at_sure], self.lately[1][self.at_lately]
        two = 1 + (self.two_sure + self.two_lately >> 1)
        one = 1 + ((_FULL - 2 - two) * (self.one_sure + self.one_lately) >> 17)
        return two, one

    def learn(self, n: int, ids: np.ndarray, is_two: np.ndarray, is_one: np.ndarray) -> None:
        y = ids + 1
        for table, at, entry, candidate in ((self.one, self.at_one, self.e1, self.c1), (self.two, self.at_two, self.e2, self.c2)):
            conf = entry & 7
            hit = candidate == y
            # a wrong candidate stays while it has been right more than once
            kept = np.where(hit, entry + (conf < 7), np.where(conf > 1, entry - conf + (conf >> 1), y << 3 | 1))
            table[at] = kept
        target = is_two * (_FULL - 64)
        self.sure[0][self.at_sure] = self.two_sure + (target - self.two_sure >> 5)
        self.lately[0][self.at_lately] = self.two_lately + (target - self.two_lately >> 5)
        move = np.where(is_two, 0, 1)
        target = is_one * (_FULL - 64)
        self.sure[1][self.at_sure] = self.one_sure + (target - self.one_sure >> 5) * move
        self.lately[1][self.at_lately] = self.one_lately + (target - self.one_lately >> 5) * move
        self.right[:n] = (self.right[:n] * 3 + is_two * 2 + is_one) % 27
        self.before[:n], self.last[:n] = self.last[:n], y


def _refreshes(at: int) -> bool:
    """Whether frequencies are counted anew before id ``at`` of a block."""
    return at >= FIRST_COUNT and at & at - 1 == 0


def _spelled(ids: np.ndarray) -> list[tuple[np.ndarray | slice, np.ndarray, int]]:
    """Parts (of which ids, start, frequency out of 2^16) that spell ids: the low half, then the high one, mostly nothing."""
    high = ids >> 16
    large = np.flatnonzero(high)
    return [(slice(None), ids & 0xFFFF, 1), (slice(None), np.where(high > 0, _FULL - 1, 0), np.where(high > 0, 1, _FULL - 1)), (large, high[large], 1)]


# --- the range coder -----------------------------------------------------------------------------


class _Encoder:
    """Ranges of up to 2^48 that shed 16 bits at a time; carries are added up at the end."""

    def __init__(self, blocks: int, words: int):
        self.low, self.range = np.zeros(blocks, dtype=np.int64), np.full(blocks, 1 << 48)
        self.out, self.size = np.zeros((blocks, words), dtype=np.int32), np.zeros(blocks, dtype=np.int64)

    def put(self, who, start: np.ndarray, freq: np.ndarray, bits: int) -> None:
        step = self.range[who] >> bits
        low, span = self.low[who] + step * start, step * freq
        small = span < 1 << 32
        full = np.flatnonzero(small)
        rows = who[full] if isinstance(who, np.ndarray) else full
        self.out[rows, self.size[rows]] = low[full] >> 32
        self.size[rows] += 1
        self.low[who] = np.where(small, (low & 0xFFFFFFFF) << 16, low)
        self.range[who] = np.where(small, span << 16, span)

    def finish(self) -> np.ndarray:
        rows = np.arange(len(self.low))
        for shift in (32, 16, 0):
            self.out[rows, self.size] = self.low >> shift if shift == 32 else self.low >> shift & 0xFFFF
            self.size += 1
        for k in range(int(self.size.max(initial=0)) - 1, 0, -1):
            self.out[:, k - 1] += self.out[:, k] >> 16
        return (self.out & 0xFFFF).astype("<u2")


class _Decoder:
    def __init__(self, words: np.ndarray, first: np.ndarray):
        self.words = np.append(words, np.zeros(4, dtype=words.dtype))
        self.at = first + 3
        head = [self.words[first + i].astype(np.int64) for i in range(3)]
        self.code = head[0] << 32 | head[1] << 16 | head[2]
        self.range = np.full(len(first), 1 << 48)

    def step(self, who, bits: int) -> np.ndarray:
        self.unit = self.range[who] >> bits
        return self.unit

    def take(self, who, start: np.ndarray, freq: np.ndarray) -> None:
        code, span = self.code[who] - self.unit * start, self.unit * freq
        small = span < 1 << 32
        at = self.at[who]
        self.code[who] = np.where(small, code << 16 | self.words[at], code)
        self.range[who] = np.where(small, span << 16, span)
        self.at[who] = at + small


def _blocks_of(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(place, number of blocks that are longer), for blocks from the longest to the shortest."""
    for at in range(int(sizes[0]) if len(sizes) else 0):
        yield at, int(np.searchsorted(-sizes, -at, side="left"))


def pack(ids: np.ndarray) -> bytes:
    """A payload: magic, number of ids, twice the number of blocks (and one if an id needs more than 16 bits), then for all blocks their numbers of words and checksums, then words."""
    ids = np.ascontiguousarray(ids, dtype=np.int64)
    blocks = -(-len(ids) // BLOCK_IDS)
    sizes = np.full(blocks, BLOCK_IDS)
    if blocks:
        sizes[-1] = len(ids) - (blocks - 1) * BLOCK_IDS
    wide = bool(ids.max(initial=0) >= _FULL)
    table = np.zeros((blocks, BLOCK_IDS), dtype=np.int64 if wide else np.uint16)
    table.ravel()[: len(ids)] = ids
    # the ids of one step side by side
    steps = np.ascontiguousarray(table.T)
    coder, model = _Encoder(blocks, (5 if wide else 3) * BLOCK_IDS + 8), _Model(blocks, wide)
    entry = None
    for at, n in _blocks_of(sizes):
        if _refreshes(at):
            zero, since = _Zero(table[:n, :at]), at
            entry = np.ascontiguousarray(zero.find(table[:n, at : 2 * at]).T)
        x = steps[at, :n].astype(np.int64)
        two, one = model.predict(n)
        is_two = model.c2 == x + 1
        is_one = (model.c1 == x + 1) & ~is_two
        start = np.where(is_two, 0, np.where(is_one, two, two + one))
        freq = np.where(is_two, two, np.where(is_one, one, _FULL - two - one))
        coder.put(slice(0, n), start, freq, 16)
        rest = np.flatnonzero(~(is_two | is_one))
        if len(rest):
            if entry is not None:
                found = entry[at - since, rest]
                known = found >= 0
                start = np.where(known, zero.start[found], zero.rest[rest])
                freq = np.where(known, zero.freq[found], (1 << ZERO_BITS) - zero.rest[rest])
                coder.put(rest, start, freq, ZERO_BITS)
                rest = rest[~known]
            for which, start, freq in _spelled(x[rest]):
                if len(start):
                    coder.put(rest[which], start, freq, 16)
        model.learn(n, x, is_two, is_one)
    words = coder.finish()
    raw = ids.astype("<u4")
    sums = [zlib.crc32(raw[i * BLOCK_IDS : (i + 1) * BLOCK_IDS].tobytes()) for i in range(blocks)]
    head = np.array([len(ids), blocks << 1 | wide], dtype="<u8").tobytes()
    lists = coder.size.astype("<u4").tobytes() + np.array(sums, dtype="<u4").tobytes()
    return MAGIC + head + lists + words[np.arange(words.shape[1]) < coder.size[:, None]].tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload; a block whose checksum differs is an error."""
    if payload[:4] != MAGIC:
        raise ValueError("not a payload of token ids")
    total, blocks = map(int, np.frombuffer(payload, "<u8", 2, 4))
    wide, blocks = bool(blocks & 1), blocks >> 1
    lengths, sums = np.frombuffer(payload, "<u4", 2 * blocks, 20).astype(np.int64).reshape(2, blocks)
    words = np.frombuffer(payload, "<u2", offset=20 + 8 * blocks)
    if len(words) != lengths.sum():
        raise ValueError("a payload of token ids is cut short")
    sizes = np.full(blocks, BLOCK_IDS)
    if blocks:
        sizes[-1] = total - (blocks - 1) * BLOCK_IDS
    out = np.zeros((BLOCK_IDS, blocks), dtype=np.int64 if wide else np.uint16)
    coder, model = _Decoder(words, np.cumsum(lengths) - lengths), _Model(blocks, wide)
    slots = None
    for at, n in _blocks_of(sizes):
        if _refreshes(at):
            zero = _Zero(out[:at, :n].T)
            slots = zero.slots()
        two, one = model.predict(n)
        unit = coder.step(slice(0, n), 16)
        code = coder.code[:n]
        is_two = code < unit * two
        is_one = ~is_two & (code < unit * (two + one))
        start = np.where(is_two, 0, np.where(is_one, two, two + one))
        freq = np.where(is_two, two, np.where(is_one, one, _FULL - two - one))
        coder.take(slice(0, n), start, freq)
        x = np.where(is_two, model.c2, model.c1) - 1
        rest = np.flatnonzero(~(is_two | is_one))
        if len(rest):
            if slots is not None:
                unit = coder.step(rest, ZERO_BITS)
                place = np.minimum(coder.code[rest] // unit, (1 << ZERO_BITS) - 1)
                found = slots[rest << ZERO_BITS | place]
                known = found >= 0
                coder.take(rest, np.where(known, zero.start[found], zero.rest[rest]), np.where(known, zero.freq[found], (1 << ZERO_BITS) - zero.rest[rest]))
                x[rest] = zero.ids[found]
                rest = rest[~known]
            if len(rest):
                low = np.minimum(coder.code[rest] // coder.step(rest, 16), _FULL - 1)
                coder.take(rest, low, 1)
                large = coder.code[rest] >= coder.step(rest, 16) * (_FULL - 1)
                coder.take(rest, np.where(large, _FULL - 1, 0), np.where(large, 1, _FULL - 1))
                x[rest] = low
                rest = rest[large]
                high = np.minimum(coder.code[rest] // coder.step(rest, 16), _FULL - 1)
                coder.take(rest, high, 1)
                x[rest] |= high << 16
        out[at, :n] = x
        model.learn(n, x, is_two, is_one)
    ids = out.T.ravel()[:total].astype("<u4")
    for i, wanted in enumerate(sums.tolist()):
        if zlib.crc32(ids[i * BLOCK_IDS : (i + 1) * BLOCK_IDS].tobytes()) != wanted:
            raise ValueError(f"block {i} of a payload of token ids is damaged")
    return ids


# --- tokens of texts --------------------------------------------------------------------------------


class _Pieces:
    """Token ids by the ``tokenizers`` library, asked once for each piece of text.

    In a text of characters up to U+02C1 without special tokens the pieces can be told apart
    here; any other text is handed to the library whole.
    """

    def __init__(self, file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_str(file)
        self.find = re.compile(PIECES).findall
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join([BEYOND_LATIN.pattern, *map(re.escape, specials)])).search
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def learn(self, pieces: list[str]) -> None:
        found = [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]
        self.known.update(zip(pieces, range(len(self.known), len(self.known) + len(pieces)), strict=True))
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum([len(f) for f in found]))
        self.ids = np.append(self.ids, np.fromiter((i for f in found for i in f), dtype=np.int64))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has."""
        if len(self.known) > CACHE_PIECES:
            self.forget()
        pieces = [self.find(t) if t and not self.whole(t) else [] for t in texts]
        new = set().union(*pieces).difference(self.known)
        if new:
            self.learn(list(new))
        number = self.known.__getitem__
        counts = np.array([len(p) for p in pieces])
        index = np.fromiter((number(p) for own in pieces for p in own), dtype=np.int64, count=int(counts.sum()))
        sizes = self.ends[index + 1] - self.ends[index]
        ends = np.cumsum(sizes)
        ids = self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[index] - ends + sizes, sizes)]
        text_sizes = np.diff(np.append(0, ends)[np.append(0, np.cumsum(counts))])
        whole = [i for i, (t, p) in enumerate(zip(texts, pieces, strict=True)) if t and not p]
        if whole:
            parts = np.split(ids, np.cumsum(text_sizes)[:-1])
            for i, e in zip(whole, self.tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True):
                parts[i] = np.array(e.ids, dtype=np.int64)
            ids, text_sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, text_sizes


@lru_cache(maxsize=2)
def _loaded(file: str) -> _Pieces:
    return _Pieces(file)


def encode_ids(docs: DataFrame, path: str, end_id: int | None = None) -> DataFrame:
    """Token ids of every whole text by the tokenizer file at ``path``: doc_id, ids.

    ``end_id`` is appended to each document's ids. A null or empty text has no other ids; repeated rows
    are encoded as often, in their order; other columns are ignored. Special tokens that a text
    spells out are taken as such, as the library does.
    """
    file = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path))

    def run(batches):
        pieces = _loaded(file.value)
        for part in cut(batches, "text", 1 << 20):
            ids, sizes = pieces.encode([t or "" for t in part.column("text").to_pylist()])
            if end_id is not None:
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<bigint>")


# --- files ---------------------------------------------------------------------------------------------


def in_id_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in ascending order over partitions and within them: nulls first, rows of one id by their text's hash, then text."""
    named = docs.select("doc_id", "text").withColumn("__hash", F.xxhash64("text"))
    order = ["doc_id", "__hash", "text"]
    return named.repartitionByRange("doc_id", "__hash").sortWithinPartitions(*order).drop("__hash")


def _file_schema(kind: str) -> str:
    return f"part int, first bigint, doc_ids array<{kind}>, counts array<bigint>, n_ids bigint, payload binary"


def write_ids(encoded: DataFrame, path: str) -> None:
    """Writes rows (doc_id, ids) in the order of their partitions and rows, as ``encode_ids(in_id_order(docs), ...)`` has them.

    ids are whole numbers from 0 to 2^32 - 1; null ids are none. A chunk takes whole documents, so
    the largest one must fit in a task. Files appear when the whole write is done, whichever
    executors were lost.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        part, first, held, total = TaskContext.get().partitionId(), 0, [], 0

        def row():
            table = pa.Table.from_batches(held).combine_chunks()
            lists = table.column("ids").chunk(0)
            counts = lists.value_lengths().fill_null(0)
            ids = lists.flatten().to_numpy()
            if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 32):
                raise ValueError("a token id is not from 0 to 2^32 - 1")
            doc_ids = table.column("doc_id").chunk(0)
            one = pa.array([0, len(doc_ids)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([first], pa.int64()),
                    pa.ListArray.from_arrays(one, doc_ids),
                    pa.ListArray.from_arrays(one, counts.cast(pa.int64())),
                    pa.array([len(ids)], pa.int64()),
                    pa.array([pack(ids)], pa.binary()),
                ],
                ["part", "first", "doc_ids", "counts", "n_ids", "payload"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            total += len(batch.column("ids").flatten())
            if total >= CHUNK_IDS:
                yield row()
                first, held, total = first + total, [], 0
        if held:
            yield row()

    write_rows(encoded.select("doc_id", "ids").mapInArrow(run, _file_schema(kind)), path)


def read_binary(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """Documents of a file: doc_id, start (ids of all documents before), n_ids, data (unsigned 32-bit little-endian ids).

    ``kind`` is the type of doc_id. What is broadcast is a row per task that wrote the file.
    """
    rows = read_rows(spark, path, _file_schema(kind))
    parts = rows.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("before"))
    placed = rows.join(F.broadcast(parts), "part").withColumn("first", F.col("before") + F.col("first"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids = unpack(batch.column("payload")[i].as_py())
                counts = batch.column("counts")[i].values.to_numpy()
                ends = np.cumsum(counts)
                at = np.append(0, ends * 4).astype(np.int32 if len(ids) < 1 << 29 else np.int64)
                build = pa.BinaryArray if at.dtype == np.int32 else pa.LargeBinaryArray
                data = build.from_buffers(pa.binary() if at.dtype == np.int32 else pa.large_binary(), len(counts), [None, pa.py_buffer(at), pa.py_buffer(ids.tobytes())])
                starts = batch.column("first")[i].as_py() + ends - counts
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(starts), pa.array(counts), data], ["doc_id", "start", "n_ids", "data"])

    return placed.select("doc_ids", "counts", "payload", "first").mapInArrow(run, f"doc_id {kind}, start bigint, n_ids bigint, data binary")


def read_ids(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """The same with ids as an array: doc_id, start, ids."""

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(d, dtype="<u4").astype(np.int64) for d in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return read_binary(spark, path, kind).select("doc_id", "start", "data").mapInArrow(run, f"doc_id {kind}, start bigint, ids array<bigint>")
