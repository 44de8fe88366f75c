import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimtrace.operators import search, vectors
from tests.frames import ordered, tuples
from tests.oracle import spark_rows

TEXTS = [
    (1, "The heart rate rose. The heart rate fell."),
    (2, "Sweetheart rates; été 2024"),
    (3, ""),
    (4, "heart-rate heart rate"),
    (5, None),
    (6, "the the the"),
]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string").withColumn("lang", F.lit("en"))


def _queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id bigint, text string")


def test_postings(docs):
    index = search.build_postings(docs)
    postings = tuples(index.postings.where("doc_id in (2, 6)"), "doc_id", "term", "tf", "length")
    assert postings == [
        (2, "2024", 1, 4),
        (2, "rates", 1, 4),
        (2, "sweetheart", 1, 4),
        (2, "été", 1, 4),
        (6, "the", 3, 3),
    ]
    assert tuples(index.terms.where("term in ('heart', 'the')"), "term", "df") == [("heart", 2), ("the", 2)]


def test_bm25_by_hand(spark, docs):
    found = search.bm25_topk(search.build_postings(docs), _queries(spark, "Heart heart", "zebra", ""), 5)
    n, df, mean = 4, 2, (8 + 4 + 4 + 3) / 4
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    def score(tf, length):
        return round(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)), 4)

    assert tuples(found, "query_id", "doc_id", "score", "rank") == [
        (0, 1, score(2, 8), 2),
        (0, 4, score(2, 4), 1),
    ]


def test_equal_scores_are_ranked_by_document(spark):
    docs = spark.createDataFrame([(i, "a b") for i in (5, 3, 9)], "doc_id bigint, text string")
    found = search.bm25_topk(search.build_postings(docs), _queries(spark, "a"), 2)
    assert tuples(found, "doc_id", "rank") == [(3, 1), (5, 2)]


def test_filters(docs):
    index = search.build_postings(docs)

    def ids(**terms):
        return [r[0] for r in tuples(search.filter_search(index, docs, **terms), "doc_id")]

    assert ids(all_of=["heart", "rate"]) == [1, 4]
    assert ids(any_of=["fell", "2024"]) == [1, 2]
    assert ids(none_of=["the"]) == [2, 3, 4, 5]
    assert ids(all_of=["heart"], none_of=["fell"]) == [4]
    assert ids(any_of=["heart"], where=F.col("doc_id") > 1) == [4]


def test_phrases_match_whole_tokens(spark, docs):
    found = search.phrase_search(docs, _queries(spark, "heart RATE", "rate fell", "zebra heart", "", "heart rates"))
    assert tuples(found, "query_id", "doc_id", "position") == [(0, 1, 1), (0, 4, 0), (1, 1, 6)]


@pytest.mark.parametrize("n, starts", [(1, [0]), (4, [0]), (5, [0, 3]), (7, [0, 3]), (8, [0, 3, 6])])
def test_chunks_cover_the_document(spark, n, starts):
    words = [f"w{i}" for i in range(n)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "")], "doc_id bigint, text string")
    chunks = search.chunk_documents(docs, 4, 1).orderBy("chunk_no").collect()
    assert [c.start for c in chunks] == starts
    assert [c.text.split() for c in chunks] == [words[s : s + 4] for s in starts]
    assert {w for c in chunks for w in c.text.split()} == set(words)


def test_snippets_and_duplicates(spark):
    docs = spark.createDataFrame(
        [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x d")], "doc_id bigint, text string"
    )
    queries = _queries(spark, "z d f")
    hits = search.bm25_topk(search.build_postings(docs), queries, 10)
    snippets = search.search_snippets(hits, docs, queries, 1)
    assert tuples(snippets, "doc_id", "position", "snippet") == [(1, 3, "c d e"), (2, 3, "c d e"), (3, 1, "x d")]
    assert [r[0] for r in tuples(search.collapse_duplicates(hits, docs), "doc_id")] == [1, 3]


def test_fusion(spark):
    first = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id bigint, doc_id bigint, rank int")
    second = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id bigint, doc_id bigint, rank int")
    found = search.hybrid_topk(first, second, 2)
    assert tuples(found, "doc_id", "score", "rank") == [(10, round(1 / 61, 6), 2), (20, round(1 / 61 + 1 / 62, 6), 1)]


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (2, 20, 9)], "query_id int, doc_id int, rank int")
    truth = spark.createDataFrame([(1, 10), (1, 12), (2, 20), (3, 30)], "query_id int, doc_id int")
    row = search.retrieval_eval(hits, truth, 5).first()
    assert tuple(row) == (3, 4, 1, round(0.5 / 3, 4), round(0.5 / 3, 4))


def test_an_updated_index_equals_a_rebuilt_one(spark, docs):
    changed = spark.createDataFrame([(1, "new words"), (3, "the heart"), (7, "seven"), (6, "")], "doc_id bigint, text string")
    whole = docs.select("doc_id", "text").join(changed, "doc_id", "left_anti").unionByName(changed)
    updated, rebuilt = search.update_postings(search.build_postings(docs), changed), search.build_postings(whole)
    for ours, theirs in zip(updated, rebuilt, strict=True):
        assert spark_rows(ours) == spark_rows(theirs)


def test_an_index_is_read_as_it_was_saved(spark, docs, tmp_path):
    index = search.build_postings(docs)
    search.save_index(index, str(tmp_path / "index"))
    loaded = search.load_index(spark, str(tmp_path / "index"))
    for ours, theirs in zip(loaded, index, strict=True):
        assert spark_rows(ours) == spark_rows(theirs)
    queries = _queries(spark, "heart rate")
    assert spark_rows(search.bm25_topk(loaded, queries, 3)) == spark_rows(search.bm25_topk(index, queries, 3))


def _vectors(spark, matrix, first_id=0):
    rows = [(first_id + i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, "id bigint, vector array<float>").repartition(3)


def _brute_force(matrix, k):
    unit = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 4)
    found = []
    for q in range(len(matrix)):
        near = sorted((d for d in range(len(matrix)) if d != q), key=lambda d: (-scores[q, d], d))[:k]
        found += [(q, d, rank + 1) for rank, d in enumerate(near)]
    return found


@pytest.mark.parametrize("block_bytes", [vectors.BLOCK_BYTES, 300])
def test_nearest_vectors(spark, block_bytes):
    """The same with all queries broadcast and with both sides cut into many blocks."""
    matrix = np.random.default_rng(3).integers(-2, 3, (60, 6)).astype(np.float32)
    matrix[:, 0] = 1
    rows = _vectors(spark, matrix)
    found = vectors.vector_topk(rows, rows, 4, block_bytes)
    assert tuples(found, "query_id", "doc_id", "rank") == ordered(_brute_force(matrix, 4))


def test_vectors_without_direction_are_left_out(spark):
    rows = _vectors(spark, [[1, 0], [0, 0], [0, 2]]).unionByName(
        spark.createDataFrame([(7, None)], "id bigint, vector array<float>")
    )
    found = vectors.vector_topk(rows, rows, 5)
    assert tuples(found, "query_id", "doc_id", "score") == [(0, 2, 0.0), (2, 0, 0.0)]
    assert vectors.vector_topk(rows, rows.limit(0), 5).count() == 0


@pytest.mark.parametrize("cell_rows", [100_000, 20])
def test_approximate_search_finds_planted_neighbours(spark, cell_rows):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 32))
    near = base + 0.05 * rng.standard_normal(base.shape)
    rows = _vectors(spark, base).unionByName(_vectors(spark, near, 1_000))
    found = vectors.vector_topk_lsh(rows, _vectors(spark, base), 1, cell_rows=cell_rows)
    hits = sum(r.doc_id == r.query_id + 1_000 for r in found.collect())
    assert hits >= 145
    exact = vectors.vector_topk(rows, _vectors(spark, base), 1)
    scores = exact.select("query_id", F.col("score").alias("best"))
    assert found.join(scores, "query_id").where("score > best").count() == 0


def test_one_bucket_with_most_vectors(spark):
    """Copies of one vector fill one bucket, which is dealt out over cells."""
    rows = _vectors(spark, [[1.0, 2.0, 3.0]] * 90 + [[-3.0, 1.0, 0.5]] * 10)
    found = vectors.vector_topk_lsh(rows, rows, 3, tables=2, bits=3, cell_rows=10)
    assert found.count() == 300
    assert {r.score for r in found.collect()} == {1.0}


def test_scores_do_not_move_postings(spark):
    """Text is shuffled by document; postings of all documents were shuffled once more, by term, to meet the weights."""
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "beta gamma")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "beta alpha")], "query_id bigint, text string")
    ranked = search.bm25_topk(search.build_postings(docs), queries, 2)
    assert "SortMergeJoin" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert [r.doc_id for r in ranked.orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize("broadcast", [0, 100])
def test_searches_with_and_without_broadcast(spark, monkeypatch, broadcast):
    monkeypatch.setattr(search, "BROADCAST_TERMS", broadcast)
    docs = spark.createDataFrame([(1, "b a b c a b"), (2, "a c"), (3, None), (4, "a b c"), (5, "")], "doc_id bigint, text string")
    queries = spark.createDataFrame([(1, "a b"), (2, "A, c"), (3, "zz a"), (4, ""), (5, "b a b c a b d")], "query_id bigint, text string")
    found = {tuple(r) for r in search.phrase_search(docs, queries).select("query_id", "doc_id", "position").collect()}
    assert found == {(1, 1, 1), (1, 4, 0), (2, 2, 0)}
    top = search.bm25_topk(search.build_postings(docs), queries, 1)
    assert {(r.query_id, r.doc_id) for r in top.collect()} == {(1, 1), (2, 2), (3, 2), (5, 1)}


def test_partitions_grow_with_the_text(spark, monkeypatch):
    monkeypatch.setattr(search, "PART_CHARS", 100)
    docs = spark.range(50).selectExpr("id AS doc_id", "repeat('alpha beta ', 10) AS text")
    assert search.tokenised(docs).rdd.getNumPartitions() == 55
    assert search.build_postings(docs).postings.count() == 100


def test_hits_hold_one_tile_of_scores_at_a_time(monkeypatch):
    """Same hits whatever the tiles, and memory that does not grow with the vectors."""
    rng = np.random.default_rng(5)
    ids, matrix = np.arange(60_000) % 50_000, np.round(rng.standard_normal((60_000, 8)), 1)
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    asked = (ids[:256], matrix[:256])
    tracemalloc.start()
    found = vectors._hits(asked, (ids, matrix), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    scores = np.round(asked[1] @ matrix.T, 4)
    for query in range(256):
        mine = found[0] == query
        order = np.lexsort((ids, -scores[query]))
        first = order[ids[order] != query][:5]
        assert found[1][mine].tolist() == ids[first].tolist()
        assert np.array_equal(found[2][mine], scores[query][first])
    monkeypatch.setattr(vectors, "TILE_ROWS", 3)
    small = vectors._hits((ids[:9], matrix[:9]), (ids[:40], matrix[:40]), 5)
    monkeypatch.setattr(vectors, "TILE_ROWS", 4096)
    assert all(np.array_equal(a, b) for a, b in zip(small, vectors._hits((ids[:9], matrix[:9]), (ids[:40], matrix[:40]), 5), strict=True))


def test_hits_of_scores_closer_than_floats_tell():
    """Scores are made as floats first; what they leave out must not be among the best as doubles."""
    rng = np.random.default_rng(6)
    matrix = np.repeat(rng.standard_normal((20, 24)), 100, axis=0) + 2e-3 * rng.standard_normal((2000, 24))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    ids = rng.permutation(2000)
    scores = np.round(matrix @ matrix.T, 4)
    nearest = vectors._Nearest((ids, matrix), 7)
    for start in range(0, 2000, 130):
        nearest.offer(ids[start : start + 130], matrix[start : start + 130])
    found = nearest.found()
    for row in range(0, 2000, 9):
        order = np.lexsort((ids, -scores[row]))
        first = order[order != row][:7]
        mine = found[0] == ids[row]
        assert found[1][mine].tolist() == ids[first].tolist() and np.array_equal(found[2][mine], scores[row][first])


def test_copies_are_merged_once(monkeypatch):
    """Every copy of one vector equals the k-th best and was sorted in again, tile by tile."""
    merged, merge = [], vectors._Nearest._merge
    monkeypatch.setattr(vectors._Nearest, "_merge", lambda self, rows, q, *hits: merged.append(len(q)) or merge(self, rows, q, *hits))
    monkeypatch.setattr(vectors, "TILE_ROWS", 50)
    ids, matrix = np.arange(1000)[::-1], np.full((1000, 4), 0.5)
    found = vectors._hits((ids[:10], matrix[:10]), (ids, matrix), 3)
    assert found[1].tolist() == [0, 1, 2] * 10
    assert sum(merged) == 10 * 50


def test_blocks_give_every_core_work(spark, monkeypatch):
    """All vectors of a block met all queries of a block in one task, on however many cores."""
    monkeypatch.setattr(vectors, "LEAST_ROWS", 20)
    cells, within = [], vectors._within_cells
    monkeypatch.setattr(vectors, "_within_cells", lambda *args: cells.append(args[-1]) or within(*args))
    rng = np.random.default_rng(8)
    rows = _vectors(spark, rng.standard_normal((200, 4)))
    exact = spark_rows(vectors.vector_topk(rows, rows, 3))
    assert not cells
    assert spark_rows(vectors.vector_topk(rows, rows, 3, block_bytes=8 * 4 * 199)) == exact
    assert cells[0] >= 2 * spark.sparkContext.defaultParallelism
