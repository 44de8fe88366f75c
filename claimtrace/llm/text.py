"""Words and hashes of whole texts, computed on the byte buffers of Arrow batches.

Texts never become Python strings here: a batch is cut into slices of a few MB (a longer
text is a slice of its own), and numpy works on the bytes of a slice at once. Equal words
have equal 64-bit hashes; that different words or shingles share one is not to be expected
(about one pair in 10^19) and is the only inexactness.
"""

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

SLICE_BYTES = 2 << 20
#: for tasks that hold tables beside the slice, as numpy takes some fifty times its bytes
SMALL_BYTES = 1 << 19
#: rows of a batch in jobs that hold much beside it, at most
SMALL_ROWS = 1000
_U = np.uint64
#: glibc hands back free memory in the middle of its heap only when asked
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def randoms(seed: int, count: int) -> np.ndarray:
    """Fixed pseudo-random 64-bit numbers, the same in every task."""
    return mix(np.arange(1, count + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: words `[^\x20\x09-\x0D]+`
NOT_SPACE = ~SPACE
#: words of a-z, 0-9 and whatever is not ASCII, after lower-casing A-Z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_BASE = 0xD6E8FEB86659FD93
_BYTE = randoms(11, 256)[LOWER]
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the ones for ordinary slices are kept."""
    keep = SLICE_BYTES * 2
    if base not in _POWERS or len(_POWERS[base]) < min(n, keep):
        steps = np.full(max(1, min(max(n, 1 << 16), keep)), base, dtype=_U)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    if n <= len(_POWERS[base]):
        return _POWERS[base][:n]
    steps = np.full(n, base, dtype=_U)
    steps[0] = 1
    return np.cumprod(steps)


class Slice:
    """Some rows of a batch with the bytes of their texts; a null text is empty."""

    def __init__(self, rows: pa.RecordBatch, column: str):
        self.rows = rows
        texts = rows.column(column).cast(pa.large_binary())
        if texts.null_count:
            texts = texts.fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]

    def __len__(self) -> int:
        return self.rows.num_rows


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run meanwhile hand over SMALL_ROWS rows at a time at most; the session's own setting comes back.

    A batch of texts is there several times over, in the executor and in the Python worker. Results do not depend on it.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    # none or less is no bound
    spark.conf.set(name, min(int(before), SMALL_ROWS) if int(before) > 0 else SMALL_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back() -> None:
    """Free memory goes back to the machine, as a Python worker outlives its tasks and would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def cut(batches: Iterable[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a part holds about ``size`` bytes of text, or one longer text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to
    batch = None
    give_back()


def slices(batches: Iterable[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[Slice]:
    for part in cut(batches, column, size):
        yield Slice(part, column)


class Words:
    """start, end: bytes of each word; first[i]:first[i+1] are the words of text i; hash by word."""

    def __init__(self, part: Slice, letters: np.ndarray):
        data, offsets = part.data, part.offsets
        inside = letters[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_BYTE[data] * _powers(_BASE, len(data)), out=sums[1:])
        back = _powers(pow(_BASE, -1, 1 << 64), len(data))
        self.hash = mix((sums[self.end] - sums[self.start]) * back[self.start])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def shingles(words: Words, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each word on, and which of them are shingles.

    A text of fewer words has one shingle, all its words, or none if ``short`` is false.
    """
    n = len(words.hash)
    last = np.repeat(words.first[1:], words.counts())
    at = np.arange(n)
    total = np.zeros(n, dtype=_U)
    for j, factor in enumerate(randoms(23, width) | _U(1)):
        there = at[: max(0, n - j)] + j < last[: max(0, n - j)]
        total[: max(0, n - j)] += np.where(there, words.hash[j:] * factor, _U(0))
    starts = at + width <= last
    if short:
        starts |= at == np.repeat(words.first[:-1], words.counts())
    return mix(total), starts
