"""Approximate nearest documents by cosine similarity: a trained coarse quantiser with inverted lists.

Directions are clustered by k-means on a bounded sample; every vector goes to the list
of its nearest centre, and a query looks into the lists whose centres are nearest to it
(Jegou, Douze and Schmid, 2011). How many lists that takes for the wanted recall is
measured against exact search when the index is built, on a bounded sample of the vectors as
queries, not guessed. Similarities of what is found are exact.

Vectors and queries have the columns id and vector, as for the exact search.
"""

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, functions as F

from claimtrace.operators.vectors import HITS, _as_batch, _directions, _Nearest, _placed, _ranked, _side, _usable, _width, vector_topk
from claimtrace.sources.storage import read_rows, write_rows, written

#: rows that the centres are learned from, and rows that recall is measured on, at most
TRAINED_ROWS = 200_000
MEASURED_ROWS = 256
#: iterations of k-means at most; it ends before if no centre moves further than this
ITERATIONS = 10
MOVED = 1e-4
#: centres are broadcast; there are never more than fit here
CENTRE_BYTES = 64 << 20
#: vectors (and queries) of one list that one task compares, in bytes
CELL_BYTES = 64 << 20
#: and in rows, as time grows with their product
CELL_ROWS = 1 << 17


class IvfIndex(NamedTuple):
    """Centres (one direction a row), the number of lists to look into, and all vectors with their list."""

    centres: np.ndarray
    probes: int
    rows: DataFrame


def build_ivf(
    vectors: DataFrame, k: int, recall: float = 0.95, lists: int | None = None, seed: int = 1, dimension: int | None = None
) -> IvfIndex:
    """An index of every vector, with as many probes as ``k`` neighbours at the given recall take.

    ``lists`` is four times the root of the number of vectors by default, at most what fits in
    CENTRE_BYTES. Centres come from at most TRAINED_ROWS vectors, probes from MEASURED_ROWS, both
    drawn by a hash of the id. A null vector is left out, a zero vector kept but nobody's neighbour;
    one of another width than ``dimension`` stops the build.
    """
    width = _width(vectors, dimension)
    rows = _usable(vectors, width)
    norm = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    sample = rows.where(norm > 0).orderBy(F.xxhash64("id", F.lit(seed))).limit(TRAINED_ROWS)
    if lists is None:
        lists = max(1, min(math.ceil(4 * math.sqrt(rows.count())), CENTRE_BYTES // (8 * (width or 1))))
    directions = Normalizer(inputCol="__vector", outputCol="features").transform(sample.withColumn("__vector", array_to_vector("vector")))
    # a limit leaves one partition
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    points = written(directions.select("id", vector_to_array("features").alias("vector")).repartition(cores), "ivf-sample")
    n = points.count()
    if n > 1:
        centres = _trained(points, max(2, min(lists, n)), seed)
    else:
        centres = np.zeros((1, width or 0))
    listed = written(_listed(rows.repartition("id"), centres), "ivf-lists")
    index = IvfIndex(centres, len(centres), listed)
    return index._replace(probes=_probes(index, k, recall, seed))


def save_ivf(index: IvfIndex, path: str) -> None:
    """One folder per list, so that a search reads the lists it looks into alone."""
    spark = index.rows.sparkSession
    write_rows(index.rows.repartitionByRange("list", "id"), f"{path}/lists", partition_by=["list"])
    centres = [(i, [float(x) for x in c], index.probes) for i, c in enumerate(index.centres)]
    write_rows(spark.createDataFrame(centres, "list int, centre array<double>, probes int"), f"{path}/centres")


def load_ivf(spark: SparkSession, path: str) -> IvfIndex:
    rows = read_rows(spark, f"{path}/centres", "list int, centre array<double>, probes int").orderBy("list").toArrow()
    centres = np.array(rows.column("centre").to_pylist())
    listed = read_rows(spark, f"{path}/lists", "id bigint, vector array<double>, list int")
    return IvfIndex(centres, rows.column("probes")[0].as_py(), listed)


def ivf_topk(index: IvfIndex, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """About the ``k`` nearest vectors per query: query_id, doc_id, score and rank.

    Queries meet the vectors of their lists only. Lists are put together to groups of bounded size, and a query goes to a
    group once, with a bit for each list of the group that it looks into: its copies grow with the groups, not with the lists.
    A list that is too full for a group is dealt over several, and queries are dealt over cells, so no list, however full or
    often asked for, makes a large task. With as many probes as lists the result is that of the exact search.
    """
    width = index.centres.shape[1]
    if not width:
        return _ranked(queries.sparkSession.createDataFrame([], HITS), k)
    per_cell = max(1, min(CELL_ROWS, CELL_BYTES // (8 * width)))
    # a row per list, of which there are as many as broadcast centres
    full = np.zeros(len(index.centres), dtype=np.int64)
    for row in index.rows.groupBy("list").count().collect():
        full[row["list"]] = row["count"]
    usable = _usable(queries, width)
    n = usable.count()
    side = _side(queries, n, int(full.sum()), per_cell)
    group, parts = _grouped(full, side)
    cells = max(1, -(-n // side))
    places = queries.sparkSession.createDataFrame([(i, int(g), int(p)) for i, (g, p) in enumerate(zip(group, parts, strict=True))], "list int, __g int, __parts int")
    vectors = (
        index.rows.join(F.broadcast(places), "list")
        .withColumn("__g", (F.col("__g") + F.pmod(F.xxhash64("id"), "__parts")).cast("int"))
        .withColumn("__q", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        .select("id", "vector", "list", "__g", "__q")
    )
    asked = _asked(usable.repartition("id"), index.centres, min(probes or index.probes, len(index.centres)), group, parts)
    asked = asked.withColumn("__q", F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int"))
    lists_of = _spans(group, parts)

    def nearest(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.schema({"query_id": pa.int64(), "doc_id": pa.int64(), "score": pa.float64()}).empty_table()
        low, high = lists_of[key[0].as_py()]
        ids, matrix, kept = _directions(left)
        of = left.column("list").to_numpy()[kept] - low
        order = np.lexsort((ids, of))
        ids, matrix, starts = ids[order], matrix[order], np.searchsorted(of[order], np.arange(high - low + 1))
        query_ids, wanted, whole = _directions(right)
        bits = np.frombuffer(b"".join(right.column("asked").to_pylist()), np.uint8).reshape(right.num_rows, -1)
        bits = np.ascontiguousarray(bits[whole].T)
        best = _Nearest((query_ids, wanted), k)
        for i, (start, end) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            if start < end:
                best.offer(ids[start:end], matrix[start:end], np.flatnonzero(bits[i >> 3] & (128 >> (i & 7))))
        return pa.Table.from_batches([_as_batch(best.found())])

    cell, groups = ["__g", "__q"], len(lists_of)
    vectors, asked = (_placed(rows, cell, groups * cells) for rows in (vectors, asked))
    return _ranked(vectors.groupBy(*cell).cogroup(asked.groupBy(*cell)).applyInArrow(nearest, HITS), k)


def _grouped(sizes: np.ndarray, per_cell: int) -> tuple[np.ndarray, np.ndarray]:
    """The (first) group of each list, and over how many groups its vectors are dealt; lists of a group follow each other."""
    group, parts = np.zeros(len(sizes), dtype=np.int64), np.maximum(1, -(-sizes // per_cell))
    last, room = -1, 0
    for i, (n, dealt) in enumerate(zip(sizes.tolist(), parts.tolist(), strict=True)):
        if dealt > 1 or n > room or last < 0:
            group[i], last, room = last + 1, last + dealt, per_cell if dealt == 1 else 0
        else:
            group[i] = last
        room = max(0, room - n)
    return group, parts


def _spans(group: np.ndarray, parts: np.ndarray) -> list[tuple[int, int]]:
    """First and last list (plus one) of each group."""
    numbers = np.arange(int((group + parts).max()))
    low = np.searchsorted(group + parts, numbers, side="right")
    return list(zip(low.tolist(), np.searchsorted(group, numbers, side="right").tolist(), strict=True))


def _asked(queries: DataFrame, centres: np.ndarray, probes: int, group: np.ndarray, parts: np.ndarray) -> DataFrame:
    """Each query once for each group (``__g``) that has lists it looks into: these as bits."""
    shared = queries.sparkSession.sparkContext.broadcast((centres, _spans(group, parts)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, spans = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                near = _matrix(part) @ own.T
                # lists as near as the last are looked into too
                looks = near >= np.partition(near, -probes, axis=1)[:, -probes, None]
                for g, (low, high) in enumerate(spans):
                    rows = np.flatnonzero(looks[:, low:high].any(axis=1))
                    if not len(rows):
                        continue
                    bits = np.packbits(looks[rows, low:high], axis=1)
                    columns = [part.column(c).take(pa.array(rows)) for c in ("id", "vector")]
                    columns += [pa.array(np.full(len(rows), g), pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "vector", "__g", "asked"])

    return queries.select("id", "vector").mapInArrow(place, "id bigint, vector array<double>, __g int, asked binary")


def _trained(points: DataFrame, lists: int, seed: int) -> np.ndarray:
    """Centres of unit vectors by k-means with cosines: Spark's own start, then iterations as matrix products.

    Spark's iterations with cosines compare all centres with each other, in up to 1,024 tasks each time; its block solver
    knows distances only and fails where the start has fewer centres than asked for.
    """
    features = points.select(array_to_vector("vector").alias("features"))
    model = KMeans(k=lists, distanceMeasure="cosine", initSteps=2, maxIter=0, seed=seed).fit(features)
    centres = _unit(np.array(model.clusterCenters()))
    for _ in range(ITERATIONS):
        means = _listed(points, centres).groupBy("list").agg(Summarizer.mean(array_to_vector("vector")).alias("mean"))
        # a row per list, of which there are as many as broadcast centres
        rows = means.select("list", vector_to_array("mean").alias("vector")).toArrow()
        moved = centres.copy()
        for batch in rows.to_batches():
            moved[batch.column("list").to_numpy()] = _matrix(batch)
        before, centres = centres, _unit(moved)
        if np.linalg.norm(centres - before, axis=1).max() <= MOVED:
            break
    return centres


def _unit(centres: np.ndarray) -> np.ndarray:
    """Centres of length 1; those of opposite directions may have none."""
    length = np.linalg.norm(centres, axis=1, keepdims=True)
    return centres / np.where(length > 0, length, 1)


def recall_at(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: n_queries, n_neighbours of the exact result, and n_found of them that ``found`` has.

    Ids may repeat, and so may a pair of them.
    """
    pairs = found.select("query_id", "doc_id").distinct().withColumn("__hit", F.lit(1))
    return exact.join(pairs, ["query_id", "doc_id"], "left").agg(
        F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_neighbours"), F.count("__hit").alias("n_found")
    )


def _listed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Each row with the list whose centre is nearest."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                # ties go to the smaller number
                nearest = np.argmax(_matrix(part) @ shared.value.T, axis=1)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vector"), pa.array(nearest, pa.int32())], ["id", "vector", "list"])

    return rows.select("id", "vector").mapInArrow(place, "id bigint, vector array<double>, list int")


def _matrix(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def _order(centres: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Lists from the nearest centre on; ties go to the smaller number."""
    return np.argsort(-(vectors @ centres.T), axis=1, kind="stable")


def _probes(index: IvfIndex, k: int, recall: float, seed: int) -> int:
    """Lists that hold the given share of true neighbours of sampled vectors."""
    asked = written(index.rows.orderBy(F.xxhash64("id", F.lit(seed + 1))).limit(MEASURED_ROWS).select("id", "vector"), "ivf-asked")
    exact = vector_topk(index.rows.select("id", "vector"), asked, k)
    # at most MEASURED_ROWS x k rows
    true = exact.join(index.rows.select(F.col("id").alias("doc_id"), "list"), "doc_id").select("query_id", "list").toArrow()
    if not true.num_rows:
        return len(index.centres)
    table = asked.toArrow().combine_chunks().to_batches()[0]
    order = _order(index.centres, _matrix(table))
    place = np.argsort(order, axis=1)
    row = {i: n for n, i in enumerate(table.column("id").to_pylist())}
    ranks = np.sort([place[row[q], c] for q, c in zip(*(true.column(c).to_pylist() for c in ("query_id", "list")), strict=True)])
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1
