"""Periodic runs of words by a sparse diagonal DP, and texts without their repetitions.

On diagonal q word i matches word i - q; the match length M_i[q] is M_{i-1}[q] + 1 where they
are equal, else 0. A diagonal that ends with match length m is a stretch of m + q words of
period q, and is emitted as a run if that is long enough. The diagonals that a word's earlier
occurrences open are as many as those occurrences, so most must never become active:

* A run of period q needs m >= max(min_words - q, (min_repeats - 1) * q), at least G words
  for every q (16 for runs of 24 words and three repeats). A lag becomes active only
  where the last k words have occurred before, k being G for lags up to G and the first of
  2G, 4G, ... that reaches longer lags.
* Of those occurrences the nearest alone counts. In a run of smallest period q <= k, one at
  a lag d < q would overlap, so both d and q would be periods of k + d >= q + d words, and by
  Fine and Wilf their greatest common divisor a shorter period of the whole run.

So a word has at most one active lag per k, and work and memory grow with n log n, for a
text of one repeated word too. All words of a slice of texts advance at once. Stretches of
k words get exact names by doubling, never hashes, and only repeated ones are carried on.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimtrace.llm.text import cut

MIN_WORDS = 24
MIN_REPEATS = 3
SPLIT_BYTES = 4 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _split(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text; a long one is cut at blanks so that few words are objects at a time."""
    at = 0
    while at < len(text):
        blank = _BLANK.search(text, at + SPLIT_BYTES) if len(text) - at > SPLIT_BYTES else None
        to = blank.start() if blank else len(text)
        # bytes.split() takes the blanks of [\x20\x09-\x0D]
        yield text[at:to].split()
        at = to


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, and whether the key occurs more than once."""
    _, names, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return names, counts[names] > 1


def _longer(at: np.ndarray, names: np.ndarray, owner: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Repeated stretches from those that start ``step`` words apart and lie in one text.

    ``at`` holds the ascending places of the repeated stretches so far, ``names`` their names.
    """
    if not len(at):
        return at, names
    place = np.minimum(np.searchsorted(at, at + step), len(at) - 1)
    both = (at[place] == at + step) & (owner[at] == owner[at[place]])
    at, pairs = at[both], names[both] * (names.max() + 1) + names[place[both]]
    names, again = _repeated(pairs)
    return at[again], names[again]


def find_runs(words: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> list[np.ndarray]:
    """Runs of each text as rows (start, length, period), by start, then period.

    ``words`` are numbers of words, equal where the words are; text i has first[i]:first[i+1].
    """
    sizes = np.diff(first)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    names, again = _repeated(words + owner * (words.max(initial=0) + 1))
    at = np.flatnonzero(again)
    names = names[at]
    seed, k = -(-min_words * (min_repeats - 1) // min_repeats), 1
    while 2 * k <= seed:
        at, names = _longer(at, names, owner, k)
        k *= 2
    if k < seed:
        at, names = _longer(at, names, owner, seed - k)
        k = seed
    found = [np.zeros((0, 4), dtype=np.int64)]
    longest = sizes.max(initial=0)
    while len(at):
        order = np.argsort(names, kind="stable")
        lag = np.zeros(len(at), dtype=np.int64)
        same = names[order[1:]] == names[order[:-1]]
        lag[order[1:]] = np.where(same, at[order[1:]] - at[order[:-1]], 0)
        # a diagonal goes on while the next word is on the same lag
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1]) | (owner[at[1:]] != owner[at[:-1]])
        head = np.flatnonzero(new)
        period, match = lag[head], np.diff(np.append(head, len(at))) - 1 + k
        good = (period > (0 if k == seed else k // 2)) & (period <= k)
        good &= match >= np.maximum(min_words - period, (min_repeats - 1) * period)
        head, period, match = at[head[good]], period[good], match[good]
        found.append(np.stack([owner[head], head - period - first[owner[head]], match + period, period], axis=1))
        if k * min_repeats > longest:
            break
        at, names = _longer(at, names, owner, k)
        k *= 2
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    ends = np.searchsorted(rows[:, 0], np.arange(len(sizes) + 1))
    return [rows[a:b, 1:] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _kept(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words no run contains after its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """Runs of each whole text, and the text without its repetitions: doc_id, n_words, runs, text.

    Words are whatever lies between blanks (0x20, 0x09-0x0D), upper and lower case apart. A run
    is a stretch of at least ``min_words`` words and ``min_repeats`` times its smallest period (3
    at least) that no neighbouring word extends at that period; ``runs`` holds start, length and
    period by start, then period. The returned text joins by one space the words that no run
    contains after that run's first period. A null or empty text has no words, no runs and an empty text;
    repeated rows and rows without an id are each answered; other columns are ignored.
    """
    if min_repeats < 3 or min_words < 3:
        raise ValueError("runs need three repeats and three words at least")

    def run(batches):
        for part in cut(batches, "text"):
            numbers: dict[bytes, int] = {}
            codes, sizes = [], []
            for text in part.column("text").to_pylist():
                before = len(codes)
                for words in _split((text or "").encode()):
                    codes.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words)))
                sizes.append(sum(map(len, codes[before:])))
            first = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            codes = np.concatenate([*codes, np.zeros(0, dtype=np.int64)])
            runs = find_runs(codes, first, min_words, min_repeats)
            spelled = list(numbers)
            texts = []
            for i, found in enumerate(runs):
                own = codes[first[i] : first[i + 1]]
                if len(found):
                    own = own[_kept(len(own), found)]
                texts.append(b" ".join(map(spelled.__getitem__, own.tolist())).decode())
            rows = np.concatenate(runs)
            ends = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in runs])]), pa.int32())
            fields = [pa.array(np.ascontiguousarray(rows[:, j])) for j in range(3)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["start", "length", "period"])).cast(_RUNS),
                    pa.array(texts, pa.string()),
                ],
                ["doc_id", "n_words", "runs", "text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, text string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
