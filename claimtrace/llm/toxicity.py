"""Toxicity: significant segments of token log-odds, as high-scoring segments are found in sequences.

Words get the log-odds of toxic against other documents under an informative Dirichlet prior
(Monroe, Colaresi, Quinn 2008). All maximal scoring segments of a text are found by one linear
scan (Ruzzo, Tompa 1999); the extreme-value law of such scores (Karlin, Altschul 1990) says how
many segments of that score chance would give, and that number becomes the score of the document.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimtrace.llm.text import NOT_SPACE, SMALL_BYTES, Words, mix, slices
from claimtrace.sources import written

MAX_LABELS = 200_000
MAX_WORDS = 100_000
MIN_Z = 3.0
PRIOR_SHARE = 0.1
DRIFT = 0.05
E_VALUE = 0.01
CUT = 0.7


def in_fold(doc_id, remainder: int, folds: int = 3):
    """Whether crc32 of the id as text leaves this remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == remainder, F.lit(False))


@dataclass
class Model:
    """hashes (sorted) and scores of words; offset: what every token costs; lam, log_k: the law of
    chance scores; a, b: logistic calibration of the log of the number of chance segments."""

    hashes: np.ndarray
    scores: np.ndarray
    offset: float
    lam: float = 1.0
    log_k: float = 0.0
    a: float = 1.0
    b: float = -4.0

    def evidence(self, top: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-log of the number of segments of this score expected in n tokens; about 0 for no segment."""
        return np.maximum(0.0, self.lam * top - np.log(np.maximum(n, 1)) - self.log_k) * (top > 0)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.a * evidence + self.b, -50, 50)))


def segments(scores: np.ndarray, offset: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of scores - offset, in one scan.

    Tokens without a positive score only lower the running sum, so the scan visits the others.
    A segment takes in earlier ones whose left sum is lower while their right sum is lower too;
    each step removes a candidate for good, which keeps the scan linear.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores - offset)])
    # start, end, sum before, sum after, and the nearest earlier candidate with a lower sum before
    out: list[tuple[int, int, float, float, int]] = []
    for at in np.flatnonzero(scores > offset).tolist():
        start, left, right = at, float(sums[at]), float(sums[at + 1])
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j = out[j][4]
            if j < 0 or out[j][3] >= right:
                break
            start, left = out[j][0], out[j][2]
            del out[j:]
        out.append((start, at + 1, left, right, j))
    return [(s, e, after - before) for s, e, before, after, _ in out]


def train(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """Learns from documents whose label is not null and whose id is not in the held-out fold.

    At most ``max_labels`` labelled documents are used, those whose ids hash lowest; labels of a
    repeated id must agree, else the larger counts. Four fifths of them give word scores, the
    rest the law of chance scores and the calibration. Words are counted by Spark; the model
    holds at most MAX_WORDS words, the most significant ones, all with |z| >= MIN_Z. Without
    any toxic or any other document the model has no words and every score is below the cut.
    """
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", 1))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic", F.xxhash64("doc_id").alias("h"))
        .orderBy("h", "doc_id")
        .limit(max_labels)
    )
    rows = chosen.select("doc_id", "toxic").toArrow()
    ids = rows.column("doc_id").to_numpy()
    order = np.argsort(ids)
    ids, toxic = ids[order], (rows.column("toxic").to_numpy()[order] > 0)
    part_of = (mix(ids.astype(np.uint64)) % np.uint64(5)) == 0
    known = docs.sparkSession.sparkContext.broadcast((ids, toxic, part_of))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, label in _labelled(batches, known.value, held=False):
            words = Words(part, NOT_SPACE)
            hashes = words.hash.view(np.int64)
            # a word counts once in a document, so that none is significant by one document alone
            own = [np.unique(hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            is_toxic = np.repeat(label, [len(x) for x in own])
            values, where = np.unique(np.concatenate([*own, hashes[:0]]), return_inverse=True)
            hits = np.bincount(where, weights=is_toxic, minlength=len(values)).astype(np.int64)
            all_ = np.bincount(where, minlength=len(values))
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(hits), pa.array(all_ - hits)], ["word", "toxic", "other"])

    counts = docs.select("doc_id", "text").mapInArrow(count, "word bigint, toxic bigint, other bigint")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = written(counts, "toxicity")
    total = counts.agg(F.sum("toxic"), F.sum("other")).first()
    n1, n0 = float(total[0] or 0), float(total[1] or 0)
    if not n1 or not n0:
        return Model(np.zeros(0, np.int64), np.zeros(0), DRIFT)
    # the prior: PRIOR_SHARE of what all counted documents have of each word
    prior, whole = (F.col("toxic") + F.col("other")) * PRIOR_SHARE, (n1 + n0) * PRIOR_SHARE
    y1, y0 = F.col("toxic") + prior, F.col("other") + prior
    odds = F.log(y1 / (n1 + whole - y1)) - F.log(y0 / (n0 + whole - y0))
    table = (
        counts.select("word", "toxic", "other", odds.alias("odds"), (odds / F.sqrt(1 / y1 + 1 / y0)).alias("z"))
        .where(F.abs("z") >= MIN_Z)
        .orderBy(F.abs("z").desc(), "word")
        .limit(MAX_WORDS)
        .toArrow()
        .to_pandas()
        .sort_values("word")
    )
    model = Model(table["word"].to_numpy(), table["odds"].to_numpy(), DRIFT)
    if not len(table):
        return model
    # what other documents spend and gain by chance gives lambda: the mean of exp(lambda * score) is 1
    share = table["other"].to_numpy() / n0
    gain = np.append(model.scores, 0.0) - DRIFT
    share = np.append(share, max(0.0, 1.0 - share.sum()))
    mean = float((share * gain).sum())
    if mean >= 0:
        model.offset += mean + DRIFT
        gain = gain - mean - DRIFT
    model.lam = _root(share, gain)
    return _calibrated(docs, known, model)


def _root(share: np.ndarray, gain: np.ndarray) -> float:
    """The positive lambda with mean exp(lambda * gain) = 1, by bisection."""
    if not (gain > 0).any() or not share[gain > 0].sum():
        return 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * gain, 700))).sum()) - 1
    low, high = 0.0, 1e-3
    while value(high) < 0 and high < 1e3:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _calibrated(docs: DataFrame, known, model: Model) -> Model:
    """Fits the place of the extreme-value law and the logistic on the kept-back fifth."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, label in _labelled(batches, known.value, held=True):
            top, n, _ = _tops(part, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(n), pa.array(label.astype(np.int64))], ["top", "n", "toxic"])

    rows = docs.select("doc_id", "text").mapInArrow(measure, "top double, n bigint, toxic bigint")
    # bounded: a fifth of at most MAX_LABELS documents
    found = rows.toArrow().to_pandas()
    chance = found[(found.toxic == 0) & (found.top > 0)]
    others = found[found.toxic == 0]
    if len(others):
        # P(no segment of score s) = exp(-K n e^(-lambda s)): K from the mean of what chance gave
        spread = model.lam * chance.top.to_numpy() - np.log(np.maximum(chance.n.to_numpy(), 1))
        model.log_k = float(np.log(max(len(chance), 1) / len(others)) + (spread.mean() if len(spread) else -np.log(others.n.mean() + 1)))
    x = model.evidence(found.top.to_numpy(), found.n.to_numpy())
    y = found.toxic.to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        model.a, model.b = _logistic(x, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Two-parameter logistic regression by Newton steps, with a small ridge."""
    w = np.zeros(2)
    features = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        gradient = features.T @ (y - p) - 1e-2 * w
        hessian = (features * (p * (1 - p))[:, None]).T @ features + 1e-2 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.0), float(w[1])


def _labelled(batches, known, held: bool):
    """Slices with only the labelled documents of one part, and their labels."""
    ids, toxic, part_of = known
    for batch in batches:
        own = batch.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy()
        place = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
        take = (ids[place] == own) & (part_of[place] == held) if len(ids) else np.zeros(len(own), bool)
        take &= ~np.asarray(batch.column("doc_id").is_null())
        if not take.any():
            continue
        chosen = batch.filter(pa.array(take)).append_column("toxic_", pa.array(toxic[place[take]]))
        for part in slices([chosen], "text", SMALL_BYTES):
            yield part, np.asarray(part.rows.column("toxic_"))


def _word_scores(words: Words, model: Model) -> np.ndarray:
    if not len(model.hashes):
        return np.zeros(len(words.hash))
    hashes = words.hash.view(np.int64)
    place = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
    return np.where(model.hashes[place] == hashes, model.scores[place], 0.0)


def _tops(part, model: Model):
    """Highest segment score and number of tokens of each text, and its segments with byte offsets."""
    words = Words(part, NOT_SPACE)
    scores = _word_scores(words, model)
    positive = np.concatenate([[0], np.cumsum(scores > model.offset)])
    top, found = np.zeros(len(part)), [()] * len(part)
    for i in np.flatnonzero(positive[words.first[1:]] > positive[words.first[:-1]]).tolist():
        a, b = words.first[i], words.first[i + 1]
        own = segments(scores[a:b], model.offset)
        top[i] = max(s for _, _, s in own)
        base = part.offsets[i]
        found[i] = [(int(words.start[a + s] - base), int(words.end[a + e - 1] - base), v) for s, e, v in own]
    return top, words.counts(), found


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """Per document: doc_id, score, predicted, passages array<struct<start, end, score, e_value>>.

    Passages are the maximal segments that chance gives fewer than E_VALUE times in a text of
    this length; start and end are byte offsets in UTF-8. Texts without words score as texts
    without any segment do. Repeated rows give repeated rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, "text", SMALL_BYTES):
            top, n, found = _tops(part, m)
            p = m.probability(m.evidence(top, n))
            passages = []
            for own, size in zip(found, n, strict=True):
                rows = [{"start": s, "end": e, "score": v, "e_value": float(np.exp(np.log(max(size, 1)) + m.log_k - m.lam * v))} for s, e, v in own]
                passages.append([r for r in rows if r["e_value"] <= E_VALUE])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e_value", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [part.rows.column("doc_id"), pa.array(p), pa.array((p >= cut).astype(np.int32)), pa.array(passages, kind)],
                ["doc_id", "score", "predicted", "passages"],
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, score double, predicted int, passages array<struct<start: bigint, end: bigint, score: double, e_value: double>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``docs`` without the documents that score ``cut`` or more; columns and repeated rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, "text", SMALL_BYTES):
            top, n, _ = _tops(part, m)
            yield part.rows.filter(pa.array(m.probability(m.evidence(top, n)) < cut))

    return docs.mapInArrow(run, docs.schema)
