"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w . x): one weight for each hashed text feature, shared by all
grades, and ordered thresholds between neighbouring grades (McCullagh 1980).
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from claimtrace.llm.text import Slice, mix, slices
from claimtrace.sources import written

FEATURES = 1 << 16
GRAM = 3
MAX_LABELS = 20_000
PARTS = 8
ROUNDS = 3
EPOCHS = 8
BATCH = 64
RATE = 0.5
RIDGE = 1e-5


@dataclass
class Model:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, margin: np.ndarray) -> np.ndarray:
        """P(grade above k) for each k but the last."""
        return _logistic(margin[:, None] - self.thresholds[None, :])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def features(part: Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, values) of each text: square roots of counts of hashed byte n-grams, of length 1."""
    data = part.data.astype(np.uint64)
    n = max(0, len(data) - GRAM + 1)
    key = np.zeros(n, dtype=np.uint64)
    for j in range(GRAM):
        key = key << np.uint64(8) | data[j : j + n]
    place = (mix(key) >> np.uint64(48)).astype(np.int64) % FEATURES
    for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True):
        counts = np.bincount(place[a : max(a, b - GRAM + 1)], minlength=FEATURES)
        at = np.flatnonzero(counts)
        values = np.sqrt(counts[at])
        yield at, values / max(1.0, float(np.sqrt((values * values).sum())))


def train(docs: DataFrame, labels: DataFrame, grade: str = "quality", max_labels: int = MAX_LABELS) -> Model | None:
    """Learns from at most ``max_labels`` labelled documents, those whose ids hash lowest.

    Labels with a null id or grade are left out; of several grades of an id the highest counts.
    The chosen rows' features are written once. In each of ROUNDS rounds PARTS tasks start from
    the same weights, go EPOCHS times over their own rows and return theirs, which are averaged
    by rows (McDonald, Hall, Mann 2010); the driver sees PARTS weight vectors of fixed size.
    None if fewer than two grades occur.
    """
    chosen = (
        labels.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(grade).cast("double").alias("grade"))
        .select(F.col("doc_id").cast("bigint").alias("doc_id"), "grade", F.xxhash64("doc_id").alias("h"))
        .orderBy("h", "doc_id")
        .limit(max_labels)
        .toArrow()
    )
    ids, rated = chosen.column("doc_id").to_numpy(), chosen.column("grade").to_numpy()
    order = np.argsort(ids)
    grades = np.unique(rated)
    if len(grades) < 2:
        return None
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast((ids[order], np.searchsorted(grades, rated[order])))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rank = known.value
        for batch in batches:
            asked = batch.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy()
            place = np.minimum(np.searchsorted(own, asked), len(own) - 1)
            take = (own[place] == asked) & ~np.asarray(batch.column("doc_id").is_null())
            if not take.any():
                continue
            kept = batch.filter(pa.array(take)).append_column("y", pa.array(rank[place[take]]))
            for part in slices([kept], "text"):
                found = list(features(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.rows.column("doc_id").cast(pa.int64()),
                        part.rows.column("y"),
                        pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                        pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32())),
                    ],
                    ["doc_id", "y", "at", "value"],
                )

    schema = "doc_id bigint, y bigint, at array<int>, value array<float>"
    rows = docs.select("doc_id", "text").mapInArrow(pick, schema)
    part_of = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")
    rows = written(rows.withColumn("part", part_of).repartition(PARTS, "part"), "quality")
    model = Model(grades.tolist(), np.zeros(FEATURES), np.linspace(-0.5, 0.5, len(grades) - 1) if len(grades) > 2 else np.zeros(1))
    for _ in range(ROUNDS):
        model = _round(rows, model)
    return model


def _round(rows: DataFrame, model: Model) -> Model:
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("y", "ascending")])
        trained = _fitted(shared.value, table)
        state = np.concatenate([trained.weights, trained.thresholds]).astype(np.float64)
        return pa.table({"n": pa.array([table.num_rows], pa.int64()), "state": pa.array([state.tobytes()], pa.binary())})

    # a part holds about MAX_LABELS / PARTS rows
    found = rows.groupBy("part").applyInArrow(fit, "n bigint, state binary").toArrow().to_pylist()
    total = sum(r["n"] for r in found)
    state = sum(np.frombuffer(r["state"]) * (r["n"] / total) for r in sorted(found, key=lambda r: r["state"]))
    return Model(model.grades, state[:FEATURES], np.sort(state[FEATURES:]))


def _fitted(model: Model, table: pa.Table) -> Model:
    """Adaptive gradient steps over small batches, in the order of ids."""
    weights, cuts = model.weights.copy(), model.thresholds.copy()
    at, value, y = (table.column(c).combine_chunks() for c in ("at", "value", "y"))
    first = np.asarray(at.offsets).astype(np.int64)
    at, value, y = np.asarray(at.flatten()).astype(np.int64), np.asarray(value.flatten()).astype(np.float64), y.to_numpy()
    seen, seen_cuts = np.full(FEATURES, 1e-2), np.full(len(cuts), 1e-2)
    first = first - first[0]
    for _ in range(EPOCHS):
        for start in range(0, len(y), BATCH):
            stop = min(start + BATCH, len(y))
            a, b = first[start], first[stop]
            row = np.repeat(np.arange(stop - start), np.diff(first[start : stop + 1]))
            margin = np.bincount(row, weights=weights[at[a:b]] * value[a:b], minlength=stop - start)
            slope, slope_cuts = _slopes(margin, cuts, y[start:stop])
            gradient = np.bincount(at[a:b], weights=slope[row] * value[a:b], minlength=FEATURES) + RIDGE * weights
            seen += gradient * gradient
            weights -= RATE * gradient / np.sqrt(seen)
            seen_cuts += slope_cuts * slope_cuts
            cuts = np.sort(cuts - RATE * slope_cuts / np.sqrt(seen_cuts))
    return Model(model.grades, weights, cuts)


def _slopes(margin: np.ndarray, cuts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Derivatives of the mean negative log likelihood by margin and by threshold."""
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    high, low = edges[y + 1] - margin, edges[y] - margin
    up, down = _logistic(np.minimum(high, 40)), _logistic(np.maximum(low, -40))
    up, down = np.where(np.isinf(high), 1.0, up), np.where(np.isinf(low), 0.0, down)
    p = np.maximum(up - down, 1e-9)
    d_up, d_down = up * (1 - up) / p, down * (1 - down) / p
    by_cut = np.bincount(y, weights=-d_up, minlength=len(cuts) + 1)[: len(cuts)] + np.bincount(y, weights=d_down, minlength=len(cuts) + 1)[1:]
    return (d_up - d_down) / len(y), by_cut / len(y)


def rate(docs: DataFrame, model: Model | None, least: float | None = None, cut: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, tail_probability, selected for each row of ``docs`` (doc_id, text).

    tail_probability is that of a grade of ``least`` or more (the highest one by default), and
    ``cut`` of it selects. Null and empty texts have no features and get what the thresholds
    alone say; repeated rows give repeated rows. Without a model all three are null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in slices(batches, "text"):
            if m is None:
                none = pa.nulls(len(part), pa.float64())
                yield pa.RecordBatch.from_arrays([part.rows.column("doc_id"), none, none, pa.nulls(len(part), pa.bool_())], names)
                continue
            grades = np.array(m.grades)
            margin = np.array([float(m.weights[at] @ values) for at, values in features(part)])
            tails = m.tails(margin)
            expected = grades[0] + tails @ np.diff(grades)
            k = len(grades) - 1 if least is None else int(np.searchsorted(grades, least))
            tail = np.ones(len(margin)) if k == 0 else np.zeros(len(margin)) if k >= len(grades) else tails[:, k - 1]
            yield pa.RecordBatch.from_arrays([part.rows.column("doc_id"), pa.array(expected), pa.array(tail), pa.array(tail >= cut)], names)

    names = ["doc_id", "expected_grade", "tail_probability", "selected"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_grade double, tail_probability double, selected boolean")
