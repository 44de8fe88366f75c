"""Language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. The vectors of three consecutive letters,
rotated by two, one and no places, are multiplied to the vector of the letter n-gram; a text is
the sum of its n-grams (Joshi, Halseth, Kanerva 2016). A language is the sum of its texts' unit
vectors, and a text is of the language whose prototype has the largest cosine.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimtrace.llm.text import cut, randoms

SIZE = 512
MAX_LANGUAGES = 1024
ROWS = 256
UNDETERMINED = "und"


@dataclass
class Profiles:
    """Unit prototypes around their common centre, one row for each language."""

    languages: list[str]
    centre: np.ndarray
    prototypes: np.ndarray


_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Which code points are letters; made once per worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def letter_vectors(points: np.ndarray, size: int) -> np.ndarray:
    """The random vector of each code point, the same in every task."""
    words = size // 64
    bits = randoms(101, 1)[0] + np.uint64(0x9E3779B97F4A7C15) * (points.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64))
    mixed = (bits ^ (bits >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(32)
    flat = np.unpackbits(mixed.view(np.uint8).reshape(len(points), -1), axis=1)
    return flat.astype(np.int8) * 2 - 1


def text_vectors(texts: list[str], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of texts, and which texts have a letter; the others are zero."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), dtype=np.int64, count=len(texts)) + 1)
    letter = _is_letter()[points]
    used = np.flatnonzero(np.bincount(points[letter], minlength=1))
    number = np.zeros(int(used[-1]) + 1 if len(used) else 1, dtype=np.int64)
    number[used] = np.arange(1, len(used) + 1)
    symbol = np.where(letter, number[np.minimum(points, len(number) - 1)], 0)
    middle = np.flatnonzero(letter)
    base = len(used) + 1
    grams = (symbol[middle - 1] * base + symbol[middle]) * base + symbol[middle + 1]
    if base**3 <= 1 << 22:
        kinds = np.flatnonzero(np.bincount(grams, minlength=1))
        place = np.zeros(base**3, dtype=np.int64)
        place[kinds] = np.arange(len(kinds))
        grams = place[grams]
    else:
        kinds, grams = np.unique(grams, return_inverse=True)
    letters = np.concatenate([np.ones((1, size), dtype=np.int8), letter_vectors(used, size)])
    bound = (
        np.roll(letters, 2, axis=1)[kinds // (base * base)] * np.roll(letters, 1, axis=1)[kinds // base % base] * letters[kinds % base]
    ).astype(np.float32)
    first = np.searchsorted(owner[middle - 1], np.arange(len(texts) + 1))
    out = np.zeros((len(texts), size), dtype=np.float32)
    for at in range(0, len(texts), ROWS):
        to = min(at + ROWS, len(texts))
        rows = owner[middle[first[at] : first[to]] - 1] - at
        counts = np.bincount(rows * len(kinds) + grams[first[at] : first[to]], minlength=(to - at) * len(kinds))
        if len(kinds):
            out[at:to] = counts.reshape(to - at, -1).astype(np.float32) @ bound
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(norm, 1e-9), first[1:] > first[:-1]


def train(docs: DataFrame, size: int = SIZE) -> Profiles:
    """Prototypes from text and lang of ``docs``; rows with a null of either or no letter say nothing.

    Unit vectors are summed in the tasks in fixed point, so that the result does not depend on
    how rows are dealt; Spark adds the sums. More than MAX_LANGUAGES values of lang are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for part in cut(batches, "text"):
            vectors, known = text_vectors(part.column("text").to_pylist(), size)
            langs = np.array(part.column("lang").to_pylist(), dtype=object)
            fixed = np.rint(vectors.astype(np.float64) * (1 << 20)).astype(np.int64)
            for lang in set(langs[known]):
                sums[lang] = sums.get(lang, 0) + fixed[known & (langs == lang)].sum(axis=0)
            if len(sums) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["lang", "dim", "total"])

    usable = docs.where("text is not null and lang is not null").select("text", "lang")
    sums = usable.mapInArrow(run, "lang string, dim int, total bigint").groupBy("lang", "dim").agg(F.sum("total").alias("total"))
    languages = [r.lang for r in sums.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    matrix = np.zeros((len(languages), size))
    rows = sums.toArrow()  # languages x size
    place = {lang: i for i, lang in enumerate(languages)}
    at = [place[lang] for lang in rows.column("lang").to_pylist()]
    matrix[at, rows.column("dim").to_numpy()] = rows.column("total").to_numpy()
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    centre = matrix.mean(axis=0) if len(languages) > 1 else np.zeros(size)
    matrix -= centre
    return Profiles(languages, centre, matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9))


def identify(docs: DataFrame, profiles: Profiles, size: int = SIZE) -> DataFrame:
    """doc_id, lang_pred and score for each row of ``docs`` (doc_id, text); other columns are not read.

    score is (1 + cosine) / 2 of the best prototype, both taken from the common centre; of equal
    cosines the language first in order wins. A null text or one without letters is ``und`` with
    score 0, as is every text when no language was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        names = np.array([*p.languages, UNDETERMINED], dtype=object)
        for part in cut(batches, "text"):
            vectors, known = text_vectors([t or "" for t in part.column("text").to_pylist()], size)
            best, score = np.full(part.num_rows, len(p.languages)), np.zeros(part.num_rows)
            if p.languages:
                own = vectors - p.centre
                cosine = own @ p.prototypes.T / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
                best = np.where(known, cosine.argmax(axis=1), best)
                score = np.where(known, np.clip((1 + cosine.max(axis=1)) / 2, 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
