"""Search queries: benchmark passages and embeddings as queries over the documents."""

from pyspark.sql import functions as F

from claimtrace.operators import ivf, search, segments, vectors
from claimtrace.sources import document_vectors, documents, scratch_path, search_queries, written

TOP = 10


def _bm25(spark, path):
    index = search.build_postings(documents(spark, path))
    return search.bm25_topk(index, search_queries(spark, path), TOP)


def _hits(spark, path):
    """Written, so that Spark sees how few they are and brings them to the documents, not the texts to them."""
    return written(_bm25(spark, path), "bm25-hits")


def build_postings(spark, path):
    return search.build_postings(documents(spark, path)).postings


def term_frequencies(spark, path):
    return search.build_postings(documents(spark, path)).terms


def bm25_topk(spark, path):
    return _bm25(spark, path)


def filter_search(spark, path):
    docs = documents(spark, path)
    index = search.build_postings(docs)
    found = search.filter_search(
        index, docs, all_of=["the", "of"], any_of=["and", "for"], none_of=["whst"], where=F.col("lang") == "en"
    )
    return found.select("doc_id", "source")


def bitmap_search(spark, path):
    terms = {"all_of": ["the", "of"], "any_of": ["and", "for"], "none_of": ["whst"]}
    bitmaps = search.build_bitmaps(documents(spark, path), sum(terms.values(), []))
    return search.bitmap_search(bitmaps, **terms)


def phrase_search(spark, path):
    return search.phrase_search(documents(spark, path), search_queries(spark, path))


def position_postings(spark, path):
    found = search.build_positions(documents(spark, path))
    listed = F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")
    return found.select("doc_id", "term", F.size("positions").alias("n"), listed.alias("positions"))


def chunk_documents(spark, path):
    return search.chunk_documents(documents(spark, path), 128, 32)


def vector_topk(spark, path):
    rows = document_vectors(spark, path)
    return vectors.vector_topk(rows, rows, TOP)


def vector_topk_lsh(spark, path):
    rows = document_vectors(spark, path)
    return vectors.vector_topk_lsh(rows, rows, TOP)


def vector_ivf_recall(spark, path):
    """Whether the inverted lists find nine in ten of the true neighbours of all vectors."""
    rows = document_vectors(spark, path)
    found = ivf.ivf_topk(ivf.build_ivf(rows, TOP), rows, TOP)
    recall = ivf.recall_at(found, vectors.vector_topk(rows, rows, TOP))
    return recall.select("n_queries", "n_neighbours", (F.col("n_found") >= 0.9 * F.col("n_neighbours")).alias("recall_reached"))


def hybrid_topk(spark, path):
    """A passage and the vector of the same number form one query."""
    rows = document_vectors(spark, path)
    asked = rows.join(search_queries(spark, path).select(F.col("query_id").alias("id")), "id", "left_semi")
    return search.hybrid_topk(_hits(spark, path), vectors.vector_topk(rows, asked, TOP), TOP)


def search_snippets(spark, path):
    hits = search.search_snippets(
        _hits(spark, path), documents(spark, path), search_queries(spark, path), 8
    )
    return hits.select("query_id", "doc_id", "rank", "position", "snippet")


def collapse_duplicates(spark, path):
    return search.collapse_duplicates(_hits(spark, path), documents(spark, path))


def search_facets(spark, path):
    return search.search_facets(_hits(spark, path), documents(spark, path), ["lang", "source"])


def retrieval_eval(spark, path):
    """A document is a true hit if it contains the passage word for word."""
    docs, queries = documents(spark, path), search_queries(spark, path)
    passages = queries.select("query_id", F.col("text").alias("passage"))
    truth = (
        written(search.phrase_search(docs, queries), "passages-found")
        .join(docs.select("doc_id", "text"), "doc_id")
        .join(passages, "query_id")
        .where(F.contains("text", "passage"))
        .select("query_id", "doc_id")
    )
    return search.retrieval_eval(_hits(spark, path), truth, TOP)


def update_postings(spark, path):
    """German documents get their source as a further word."""
    docs = documents(spark, path)
    changed = docs.where(F.col("lang") == "de").withColumn("text", F.concat_ws(" ", "text", "source"))
    return search.update_postings(search.build_postings(docs), changed).terms


def _segmented(spark, path):
    """Documents in two parts; then German ones get their source as a further word, and French ones of even number go."""
    docs = documents(spark, path).select("doc_id", "text", "lang", "source")
    where, even = scratch_path(spark, "segments"), F.col("doc_id") % 2 == 0
    german = docs.where(F.col("lang") == "de").withColumn("text", F.concat_ws(" ", "text", "source"))
    segments.update_index(spark, where, docs.where(even))
    segments.update_index(spark, where, docs.where(~even))
    segments.update_index(spark, where, german, docs.where(even & (F.col("lang") == "fr")))
    return segments.open_index(spark, where)


def segment_postings(spark, path):
    return _segmented(spark, path).postings


def segment_lengths(spark, path):
    return _segmented(spark, path).lengths


def segment_terms(spark, path):
    return _segmented(spark, path).terms


QUERIES = {
    "build_postings": build_postings,
    "term_frequencies": term_frequencies,
    "bm25_topk": bm25_topk,
    "filter_search": filter_search,
    "bitmap_search": bitmap_search,
    "phrase_search": phrase_search,
    "position_postings": position_postings,
    "chunk_documents": chunk_documents,
    "vector_topk": vector_topk,
    "vector_topk_lsh": vector_topk_lsh,
    "vector_ivf_recall": vector_ivf_recall,
    "hybrid_topk": hybrid_topk,
    "search_snippets": search_snippets,
    "collapse_duplicates": collapse_duplicates,
    "search_facets": search_facets,
    "retrieval_eval": retrieval_eval,
    "update_postings": update_postings,
    "segment_postings": segment_postings,
    "segment_lengths": segment_lengths,
    "segment_terms": segment_terms,
}

TOKENS = r"""
words AS (
  SELECT doc_id, lang, source, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS toks FROM documents
),
asked AS (
  SELECT item_id AS query_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS toks FROM benchmark
)"""

POSTINGS = """
postings AS (
  SELECT doc_id, term, length, count(*) AS tf
  FROM (SELECT doc_id, CAST(len(toks) AS INTEGER) AS length, unnest(toks) AS term FROM words)
  GROUP BY ALL
)"""

RANKED = f"""
sizes AS (SELECT count(*) AS n, avg(len(toks)) AS mean FROM words WHERE len(toks) > 0),
weights AS (
  SELECT q.query_id, q.term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf
  FROM (SELECT DISTINCT query_id, term FROM (SELECT query_id, unnest(toks) AS term FROM asked)) q
  JOIN (SELECT term, count(*) AS df FROM postings GROUP BY term) d ON q.term = d.term, sizes
),
scores AS (
  SELECT query_id, doc_id,
         round(sum(idf * tf * {search.K1 + 1} / (tf + {search.K1} * (1 - {search.B} + {search.B} * length / mean))), 4) AS score
  FROM postings p JOIN weights w ON p.term = w.term, sizes
  GROUP BY ALL
),
bm25 AS (
  SELECT * FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM scores
  ) WHERE rank <= {TOP}
)"""

SEARCHED = f"{TOKENS}, {POSTINGS}, {RANKED}"

NEAREST = f"""
v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm
  FROM embeddings
),
nearest AS (
  SELECT * FROM (
    SELECT query_id, doc_id, score,
           CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
    FROM (
      SELECT q.vec_id AS query_id, d.vec_id AS doc_id,
             round(list_dot_product(q.e, d.e) / (q.norm * d.norm), 4) AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id
    )
  ) WHERE rank <= {TOP}
)"""

PHRASES = """
phrases AS (
  SELECT query_id, doc_id, strpos(' ' || array_to_string(w.toks, ' ') || ' ', ' ' || array_to_string(a.toks, ' ') || ' ') AS found_at,
         ' ' || array_to_string(w.toks, ' ') || ' ' AS spaced
  FROM words w JOIN asked a
    ON contains(' ' || array_to_string(w.toks, ' ') || ' ', ' ' || array_to_string(a.toks, ' ') || ' ')
)"""

SEGMENTED = r"""
words AS (
  SELECT doc_id, regexp_extract_all(lower(CASE WHEN lang = 'de' THEN text || ' ' || source ELSE text END), '[\p{L}\p{N}]+') AS toks
  FROM documents WHERE NOT (lang = 'fr' AND doc_id % 2 = 0)
)"""

ORACLES = {
    "segment_postings": f"""
WITH {SEGMENTED}, {POSTINGS}
SELECT * FROM postings""",
    "segment_lengths": f"""
WITH {SEGMENTED}
SELECT doc_id, CAST(len(toks) AS INTEGER) AS length FROM words""",
    "segment_terms": f"""
WITH {SEGMENTED}, {POSTINGS}
SELECT term, count(*) AS df FROM postings GROUP BY term""",
    "build_postings": f"""
WITH {TOKENS}, {POSTINGS}
SELECT * FROM postings""",
    "term_frequencies": f"""
WITH {TOKENS}
SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(toks) AS term FROM words) GROUP BY term""",
    "bm25_topk": f"""
WITH {SEARCHED}
SELECT * FROM bm25""",
    "filter_search": f"""
WITH {TOKENS}
SELECT doc_id, source FROM words
WHERE lang = 'en' AND list_has_all(toks, ['the', 'of']) AND list_has_any(toks, ['and', 'for'])
  AND NOT list_contains(toks, 'whst')""",
    "bitmap_search": f"""
WITH {TOKENS}
SELECT doc_id FROM words
WHERE list_has_all(toks, ['the', 'of']) AND list_has_any(toks, ['and', 'for']) AND NOT list_contains(toks, 'whst')""",
    "phrase_search": f"""
WITH {TOKENS}, {PHRASES}
SELECT query_id, doc_id, CAST(len(string_split(substring(spaced, 1, found_at), ' ')) - 2 AS INTEGER) AS position FROM phrases""",
    "position_postings": f"""
WITH {TOKENS}
SELECT doc_id, term, CAST(count(*) AS INTEGER) AS n, string_agg(CAST(i - 1 AS VARCHAR), ',' ORDER BY i) AS positions
FROM (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) AS i FROM words) GROUP BY doc_id, term""",
    "chunk_documents": f"""
WITH {TOKENS}, starts AS (
  SELECT doc_id, toks,
         unnest(range(0, CAST(ceil(greatest(len(toks) - 128, 0) / 96) AS BIGINT) + 1)) AS chunk_no
  FROM words WHERE len(toks) > 0
), chunks AS (
  SELECT doc_id, chunk_no, toks[chunk_no * 96 + 1 : chunk_no * 96 + 128] AS chunk FROM starts
)
SELECT doc_id, CAST(chunk_no AS INTEGER) AS chunk_no, CAST(chunk_no * 96 AS INTEGER) AS start,
       CAST(len(chunk) AS INTEGER) AS n_tokens, array_to_string(chunk, ' ') AS text
FROM chunks""",
    "vector_topk": f"""
WITH {NEAREST}
SELECT * FROM nearest""",
    "vector_ivf_recall": f"""
WITH {NEAREST}
SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_neighbours, true AS recall_reached FROM nearest""",
    "hybrid_topk": f"""
WITH {SEARCHED}, {NEAREST}, fused AS (
  SELECT query_id, doc_id, b.rank AS keyword_rank, n.rank AS vector_rank,
         round(coalesce(1 / (b.rank + {search.FUSION}), 0) + coalesce(1 / (n.rank + {search.FUSION}), 0), 6) AS score
  FROM bm25 b FULL JOIN (
    SELECT * FROM nearest WHERE query_id IN (SELECT item_id FROM benchmark)
  ) n USING (query_id, doc_id)
)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM fused
) WHERE rank <= {TOP}""",
    "search_snippets": f"""
WITH {SEARCHED}, placed AS (
  SELECT b.query_id, b.doc_id, b.rank, w.toks AS toks,
         list_min([i FOR x, i IN w.toks IF list_contains(a.toks, x)]) AS first
  FROM bm25 b JOIN asked a ON a.query_id = b.query_id JOIN words w ON w.doc_id = b.doc_id
)
SELECT query_id, doc_id, rank, CAST(first - 1 AS INTEGER) AS position,
       array_to_string(toks[greatest(first - 8, 1) : first + 8], ' ') AS snippet
FROM placed""",
    "collapse_duplicates": f"""
WITH {SEARCHED}
SELECT b.query_id, b.doc_id, score, rank FROM bm25 b JOIN words w ON w.doc_id = b.doc_id
QUALIFY row_number() OVER (PARTITION BY b.query_id, w.text ORDER BY rank, b.doc_id) = 1""",
    "search_facets": f"""
WITH {SEARCHED}
SELECT query_id, lang, source, CAST(grouping(query_id, lang, source) AS INTEGER) AS facet, count(*) AS n
FROM bm25 JOIN words USING (doc_id)
GROUP BY GROUPING SETS ((query_id, lang), (query_id, source), (query_id))""",
    "retrieval_eval": f"""
WITH {SEARCHED}, truth AS (
  SELECT item_id AS query_id, doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)
), per_query AS (
  SELECT query_id, count(*) AS n_true, count(rank) AS n_found, min(rank) AS best
  FROM truth LEFT JOIN bm25 USING (query_id, doc_id) GROUP BY query_id
)
SELECT count(*) AS n_queries, CAST(sum(n_true) AS BIGINT) AS n_true, CAST(sum(n_found) AS BIGINT) AS n_found,
       round(avg(n_found / n_true), 4) AS recall, round(avg(coalesce(1 / best, 0)), 4) AS mean_reciprocal_rank
FROM per_query""",
    "update_postings": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(
    lower(CASE WHEN lang = 'de' THEN text || ' ' || source ELSE text END), '[\p{L}\p{N}]+')) AS term
  FROM documents
)
SELECT term, count(DISTINCT doc_id) AS df FROM words GROUP BY term""",
}
