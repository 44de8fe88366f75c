"""Nearest documents by cosine similarity, for a batch of query vectors.

Vectors and queries have the columns id and vector. A query is never its own hit, and a
zero vector, which has no direction, is nobody's. Scores are rounded to four places and
ties go to the smaller id. Similarities are computed block by block with numpy, and a
block keeps only its ``k`` best per query, so pairs are never rows of a table.
"""

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from claimtrace.plans import top_k

HITS = "query_id bigint, doc_id bigint, score double"
BLOCK_BYTES = 64 * 1024 * 1024
#: vectors that a block of queries is compared with at once, and scores that are held then
TILE_ROWS = 4096
SCORES_AT_ONCE = 1 << 19
#: blocks are cut smaller to give every core several pairs of them, but not below so many rows
LEAST_ROWS = 4096
CELLS_A_CORE = 6
#: scores this much below the k-th best may still equal it when rounded
ROUNDED = 1.01e-4


def vector_topk(
    vectors: DataFrame, queries: DataFrame, k: int, block_bytes: int = BLOCK_BYTES, dimension: int | None = None
) -> DataFrame:
    """The exact ``k`` nearest vectors per query: query_id, doc_id, score and rank.

    The work is queries x vectors x dimension. Queries that fit in ``block_bytes`` are
    broadcast and the vectors are never shuffled; otherwise both sides are cut into
    blocks of at most that size and every block of queries meets every block of vectors.

    A vector that is null is left out. One of another width than ``dimension`` (by default
    that of the widest vector) or with a null element stops the query.
    """
    n = queries.count()
    width = _width(vectors, dimension)
    row_bytes = 8 * (width or 1)
    queries, vectors = _usable(queries, width), _usable(vectors, width)
    if n * row_bytes <= block_bytes:
        near = _against_broadcast(vectors, queries, k)
    else:
        n_vectors = vectors.count()
        side = _side(queries, n, n_vectors, block_bytes // row_bytes)
        blocks, cells = -(-n // side), max(1, -(-n_vectors // side))
        near = _within_cells(
            _dealt(vectors, "__v", cells, "__q", blocks), _dealt(queries, "__q", blocks, "__v", cells),
            ["__q", "__v"], k, blocks * cells,
        )
    return _ranked(near, k)


def vector_topk_lsh(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    tables: int = 8,
    bits: int = 8,
    seed: int = 1,
    cell_rows: int = 100_000,
    dimension: int | None = None,
) -> DataFrame:
    """Approximate ``vector_topk``: only vectors that share a bucket with the query are compared.

    A bucket is the signs of ``bits`` random projections (Charikar, 2002); there are
    ``tables`` independent ones. Similarities of the candidates are exact. There are at
    most tables x 2^bits buckets, so their sizes may be broadcast. A bucket with more than
    ``cell_rows`` vectors or queries is dealt out over several cells.
    """
    width = _width(vectors, dimension)
    signs = _signs(tables, bits, seed)

    def hashed(rows: DataFrame) -> DataFrame:
        buckets = F.posexplode(signs("vector")).alias("__table", "__bucket")
        return _usable(rows, width).select("id", "vector", buckets)

    keys = ["__table", "__bucket"]

    def cells(rows: DataFrame, name: str) -> DataFrame:
        number = F.ceil(F.count(F.lit(1)) / cell_rows).cast("int").alias(f"{name}s")
        return F.broadcast(rows.groupBy(*keys).agg(number))

    left, right = hashed(vectors), hashed(queries)
    sizes = cells(left, "__v").join(cells(right, "__q"), keys)

    def placed(rows: DataFrame, own: str, other: str) -> DataFrame:
        return (
            rows.join(F.broadcast(sizes), keys)
            .withColumn(own, F.pmod(F.xxhash64("id"), f"{own}s").cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
            .select("id", "vector", *keys, "__v", "__q")
        )

    near = _within_cells(
        placed(left, "__v", "__q"), placed(right, "__q", "__v"), [*keys, "__v", "__q"], k
    )
    return _ranked(near.distinct(), k)


def _width(vectors: DataFrame, dimension: int | None) -> int | None:
    return dimension or vectors.agg(F.max(F.size("vector"))).first()[0]


def _usable(rows: DataFrame, width: int | None) -> DataFrame:
    """Rows with a vector, as doubles; another width or a null element stops the query."""
    whole = (F.size("vector") == (width or 0)) & ~F.exists("vector", lambda x: x.isNull())
    message = F.concat(F.lit(f"not a vector of {width} numbers: id "), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    checked = F.when(whole, F.col("vector").cast("array<double>")).otherwise(F.raise_error(message).cast("array<double>"))
    return rows.where(F.col("vector").isNotNull()).select(F.col("id").cast("bigint"), checked.alias("vector"))


def _side(rows: DataFrame, n_queries: int, n_vectors: int, most: int) -> int:
    """Rows of a block of either side: at most ``most``, and fewer if the cores would get too few pairs of blocks."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(most, max(LEAST_ROWS, math.ceil(math.sqrt(n_queries * n_vectors / (CELLS_A_CORE * cores))))))


def _placed(rows: DataFrame, cell: list[str], cells: int) -> DataFrame:
    """Rows sent to their cell. The work of a cell is the square of its bytes, by which Spark would put cells together."""
    spark = rows.sparkSession
    spread = min(4 * cells, 2 * CELLS_A_CORE * spark.sparkContext.defaultParallelism)
    return rows.repartition(max(spread, int(spark.conf.get("spark.sql.shuffle.partitions"))), *cell)


def _dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Rows dealt over their own blocks and repeated for each block of the other side."""
    return rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int")).withColumn(
        other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))
    )


def _ranked(near: DataFrame, k: int) -> DataFrame:
    return top_k(near, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def _against_broadcast(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast(_unit_rows(queries.toArrow()))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Nearest(shared.value, k)
        for batch in batches:
            best.offer(*_unit_rows(batch))
        yield _as_batch(best.found())

    return vectors.mapInArrow(nearest, HITS)


def _within_cells(vectors: DataFrame, queries: DataFrame, cell: list[str], k: int, cells: int | None = None) -> DataFrame:
    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _hits(_unit_rows(right), _unit_rows(left), k)
        return pa.Table.from_batches([_as_batch(found)])

    if cells:
        vectors, queries = _placed(vectors, cell, cells), _placed(queries, cell, cells)
    return vectors.groupBy(*cell).cogroup(queries.groupBy(*cell)).applyInArrow(nearest, HITS)


def _signs(tables: int, bits: int, seed: int):
    """A function from a vector column to its bucket in each table."""

    @F.pandas_udf(ArrayType(IntegerType()))
    def buckets(vector):
        if not len(vector):
            return vector
        rows = np.stack(vector.to_numpy())
        planes = np.random.default_rng(seed).standard_normal((rows.shape[1], tables * bits))
        positive = (rows @ planes > 0).reshape(len(rows), tables, bits)
        return type(vector)(list((positive * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)))

    return buckets


def _unit_rows(rows) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of length 1 from Arrow rows; zero vectors are left out."""
    return _directions(rows)[:2]


def _directions(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, and which rows are not left out."""
    table = pa.Table.from_batches([rows]) if isinstance(rows, pa.RecordBatch) else rows
    ids = table.column("id").combine_chunks().to_numpy(zero_copy_only=False)
    if not len(ids):
        return ids.astype(np.int64), np.empty((0, 0)), np.zeros(0, dtype=bool)
    values = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    matrix = values.reshape(len(ids), -1)
    norms = np.linalg.norm(matrix, axis=1)
    kept = norms > 0
    return ids[kept], matrix[kept] / norms[kept, None], kept


def _hits(asked, among, k: int):
    """The ``k`` best of ``among`` for each of ``asked``, as (query ids, doc ids, scores)."""
    nearest = _Nearest(asked, k)
    nearest.offer(*among)
    return nearest.found()


class _Nearest:
    """The ``k`` best hits so far of each of ``asked``, which are offered vectors block by block.

    Scores are made as floats, in tiles of SCORES_AT_ONCE, so what is held does not grow with the vectors. A tile gives up only
    scores that may be among the best so far, by as much as floats may be off; those alone are made again as doubles and rounded.
    """

    def __init__(self, asked, k: int):
        self.query_ids, self.wanted = asked
        self.k = max(1, k)
        self.floats = self.wanted.astype(np.float32)
        self.off = (self.wanted.shape[1] + 8) * 2.0**-23
        # hits are known by the row of the query until the end, as ids may repeat; a place with -inf is free
        self.ids = np.zeros((len(self.query_ids), self.k), np.int64)
        self.scores = np.full(self.ids.shape, -np.inf)

    def offer(self, ids, matrix, rows=None) -> None:
        """Compares vectors with all queries, or with those at ``rows``."""
        if (ids[1:] < ids[:-1]).any():
            order = np.argsort(ids, kind="stable")
            ids, matrix = ids[order], matrix[order]
        self.ids = self.ids.astype(np.result_type(self.ids, ids), copy=False)
        rows, floats = np.arange(len(self.query_ids)) if rows is None else rows, matrix.astype(np.float32)
        for at in range(0, len(ids), TILE_ROWS):
            tile = slice(at, at + TILE_ROWS)
            at_once = min(2 * TILE_ROWS, SCORES_AT_ONCE // len(ids[tile]))
            for start in range(0, len(rows), at_once):
                self._compare(rows[start : start + at_once], ids[tile], matrix[tile], floats[tile])

    def found(self):
        """(query ids, doc ids, scores), by query, score and id."""
        row, place = np.nonzero(np.isfinite(self.scores))
        return _best((self.query_ids[row], self.ids[row, place], self.scores[row, place]), self.k)

    def _compare(self, rows, ids, matrix, floats) -> None:
        scores = self.floats[rows] @ floats.T
        worst = self.scores[rows, -1]
        # one of k hits gives way to a better score, or to the same of a smaller id
        least = worst + np.where(ids[0] > self.ids[rows, -1], 0.49e-4, -0.51e-4) - self.off
        free = np.flatnonzero(np.isneginf(worst))
        if len(free) and self.k < len(ids):
            kth = self._kth(scores[free], self.query_ids[rows[free], None] == ids)
            least[free] = np.where(np.isnan(kth), -np.inf, kth - ROUNDED - 2 * self.off)
        q, d = _at_least(scores, least.astype(np.float32))
        if not len(q):
            return
        if len(q) > min(scores.size // 32, BLOCK_BYTES // (16 * matrix.shape[1])):
            exact = (self.wanted[rows] @ matrix.T)[q, d]
        else:
            exact = np.einsum("ij,ij->i", self.wanted[rows[q]], matrix[d])
        kept = (self.query_ids[rows[q]] != ids[d]) & np.isfinite(exact)
        self._merge(rows, q[kept], ids[d[kept]], np.round(exact[kept], 4))

    def _kth(self, scores: np.ndarray, own: np.ndarray) -> np.ndarray:
        """A score that ``k`` of each row reach: the k-th of the best of some shares of the row."""
        scores[own] = -np.inf
        shares = max(1, scores.shape[1] // (8 * self.k))
        if shares > 1:
            scores = scores[:, : 8 * self.k * shares].reshape(len(scores), shares, 8 * self.k).max(axis=1)
        return -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1]

    def _merge(self, rows, q, ids, scores) -> None:
        """Takes in hits of the queries ``rows[q]``, in the order of ``q``."""
        n = np.bincount(q, minlength=len(rows))
        first = np.cumsum(n) - n
        # each query of a round gets as many places as the one with most new hits
        for few, many in pairwise((0, 2, 16, max(16, n.max(initial=0)))):
            changed = np.flatnonzero((n > few) & (n <= many))
            if not len(changed):
                continue
            held, place = rows[changed], np.arange(n[changed].max())
            new = place < n[changed, None]
            at = np.where(new, first[changed, None] + place, 0)
            every_id = np.concatenate([self.ids[held], ids[at]], axis=1)
            every_score = np.concatenate([self.scores[held], np.where(new, scores[at], -np.inf)], axis=1)
            best = np.lexsort((every_id, -every_score), axis=1)[:, : self.k]
            self.ids[held], self.scores[held] = np.take_along_axis(every_id, best, 1), np.take_along_axis(every_score, best, 1)


def _at_least(scores: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the scores that reach the least of their row; looked for eight at a time, as they are few."""
    reached = (scores >= least[:, None]).ravel()
    whole = len(reached) // 8 * 8
    eights = np.flatnonzero(reached[:whole].view(np.uint64))
    at = (eights[:, None] * 8 + np.arange(8))[reached[:whole].reshape(-1, 8)[eights]]
    return np.divmod(np.concatenate([at, whole + np.flatnonzero(reached[whole:])]), scores.shape[1])


def _best(found, k: int):
    """The first ``k`` per query by score, then id."""
    queries, ids, scores = found
    order = np.lexsort((ids, -scores, queries))
    queries, ids, scores = queries[order], ids[order], scores[order]
    place = np.arange(len(queries)) - np.searchsorted(queries, queries, side="left")
    kept = place < k
    return queries[kept], ids[kept], scores[kept]


def _as_batch(found) -> pa.RecordBatch:
    queries, ids, scores = found
    # -0.0 and 0.0 are one score
    return pa.RecordBatch.from_arrays(
        [pa.array(queries, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores + 0.0)],
        names=["query_id", "doc_id", "score"],
    )
