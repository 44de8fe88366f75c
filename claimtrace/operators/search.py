"""Batch search over documents by keyword, Boolean filter and phrase.

Documents have doc_id, text and metadata columns; queries have query_id and text.
"""

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from claimtrace.functions import tokens
from claimtrace.plans import top_k
from claimtrace.sources.storage import read_rows, write_rows

# BM25 constants (Robertson and Zaragoza, 2009) and the rank fusion constant (Cormack et al., 2009)
K1 = 1.2
B = 0.75
FUSION = 60

#: characters of text in one partition of documents, about; postings and scores of a partition are one task's
PART_CHARS = 16_000_000
#: query terms that are broadcast, at most
BROADCAST_TERMS = 200_000


class Index(NamedTuple):
    """Postings (doc_id, term, length, tf), lengths (doc_id, length) and terms (term, df)."""

    postings: DataFrame
    lengths: DataFrame
    terms: DataFrame


def tokenised(docs: DataFrame) -> DataFrame:
    """doc_id and tokens, partitioned by document.

    This is the only shuffle of text. Postings, document lengths and scores of a
    document are all computed in the partition it lands in, so a term that is in
    every document does not make a large group anywhere. There are as many partitions as
    the text takes, so that a task's share does not grow with the table.
    """
    return docs.select("doc_id", tokens("text").alias("tokens")).repartition(text_parts(docs), "doc_id")


def text_parts(docs: DataFrame) -> int:
    """Partitions for the text of ``docs``."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(chars / PART_CHARS))


def build_postings(docs: DataFrame) -> Index:
    """The index of ``docs``."""
    words = tokenised(docs)
    length = F.size("tokens").alias("length")
    postings = (
        _exploded(words.select("doc_id", length, "tokens"), F.col("tokens"))
        .groupBy("doc_id", "term", "length")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    return Index(postings, words.select("doc_id", length), _document_frequency(postings))


def update_postings(index: Index, changed: DataFrame) -> Index:
    """``index`` with the postings of the ``changed`` documents replaced."""
    new = build_postings(changed)
    ids = changed.select("doc_id").distinct()
    postings = index.postings.join(ids, "doc_id", "left_anti").unionByName(new.postings)
    lengths = index.lengths.join(ids, "doc_id", "left_anti").unionByName(new.lengths)
    return Index(postings, lengths, _document_frequency(postings))


def save_index(index: Index, path: str) -> None:
    """Postings are laid out by term, so a search for given terms skips most row groups."""
    by_term = index.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    write_rows(by_term, f"{path}/postings")
    write_rows(index.lengths, f"{path}/lengths")
    write_rows(index.terms, f"{path}/terms")


def load_index(spark, path: str) -> Index:
    return Index(
        read_rows(spark, f"{path}/postings", "doc_id bigint, term string, length int, tf bigint"),
        read_rows(spark, f"{path}/lengths", "doc_id bigint, length int"),
        read_rows(spark, f"{path}/terms", "term string, df bigint"),
    )


def bm25_topk(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best documents per query: query_id, doc_id, score and rank.

    Every document that shares a term with the query is scored. Scores are added up
    and cut to ``k`` per query inside each document partition, so what is shuffled is at
    most ``k`` rows per query and partition. A batch of queries with more than BROADCAST_TERMS
    terms is joined by term instead, where adaptive execution splits common terms.
    """
    wanted = _query_terms(queries)
    near = _nearby(wanted)
    sought = near(wanted.select("term").distinct())
    # stored with a saved index; else counted for these terms alone, as the join moves below the count
    df = index.terms.join(sought, "term", "left_semi")
    # documents without tokens do not count
    n = index.lengths.agg(F.count_if(F.col("length") > 0).alias("n")).scalar()
    mean = index.lengths.agg(F.avg(F.when(F.col("length") > 0, F.col("length"))).alias("mean")).scalar()
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = near(df.join(near(wanted), "term").select("query_id", "term", idf.alias("idf")))
    saturated = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    scores = (
        index.postings.join(sought, "term", "left_semi")
        .join(weights, "term")
        .groupBy("doc_id", "query_id")
        .agg(F.round(F.sum(F.col("idf") * saturated), 4).alias("score"))
    )
    return top_k(scores, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def filter_search(
    index: Index,
    docs: DataFrame,
    all_of: Sequence[str] = (),
    any_of: Sequence[str] = (),
    none_of: Sequence[str] = (),
    where: Column | None = None,
) -> DataFrame:
    """Documents with all, at least one and none of the given terms, that satisfy ``where``."""
    kept = docs if where is None else docs.where(where)
    sought = sorted({*all_of, *any_of, *none_of})
    term = F.col("term")

    def hits(terms: Sequence[str]) -> Column:
        return F.count_if(term.isin(list(terms))) if terms else F.count_if(F.lit(False))

    found = (
        index.postings.where(term.isin(sought))
        .groupBy("doc_id")
        .agg(hits(all_of).alias("__all"), hits(any_of).alias("__any"), hits(none_of).alias("__none"))
    )
    matches = (F.coalesce("__all", F.lit(0)) == len(set(all_of))) & (F.coalesce("__none", F.lit(0)) == 0)
    if any_of:
        matches = matches & (F.col("__any") > 0)
    # without required terms a document that has none of the sought ones may match
    how = "inner" if all_of or any_of else "left"
    return kept.join(found, "doc_id", how).where(matches).drop("__all", "__any", "__none")


def build_bitmaps(docs: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Documents of each term as bits: term, bucket and bitmap, a row for each 32,768 numbers of documents.

    Documents are known by whole numbers from 1 on, as ``doc_id`` + 1. Bits are set on the map
    side, so at most a row of 4 KB per term and bucket leaves a task, however common the term.
    """
    words = docs.select("doc_id", F.explode_outer(F.array_distinct(tokens("text"))).alias("term")).where(F.col("term").isin(list(terms)))
    number = F.col("doc_id") + 1
    return words.groupBy("term", F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bitmap")
    )


def bitmap_search(
    bitmaps: DataFrame, all_of: Sequence[str] = (), any_of: Sequence[str] = (), none_of: Sequence[str] = ()
) -> DataFrame:
    """Ids of documents with all, at least one and none of the given terms, by operations on whole bitmaps.

    The union of ``any_of`` is one more bitmap that must hold; those of ``none_of`` are
    looked up bit by bit for what is left. At least one required term is needed.
    """
    if not all_of and not any_of:
        raise ValueError("a search by bitmaps needs a term that must be there")
    term = F.col("term")
    wanted = F.when(term.isin(list(all_of)), F.concat(F.lit("all:"), term))
    if any_of:
        # a term may be in both lists
        wanted = F.array_compact(F.array(wanted, F.when(term.isin(list(any_of)), F.lit("any"))))
    else:
        wanted = F.array_compact(F.array(wanted))
    roles = bitmaps.select("bucket", "bitmap", F.explode(wanted).alias("role")).groupBy("bucket", "role").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    needed = len(set(all_of)) + bool(any_of)
    kept = roles.groupBy("bucket").agg(F.bitmap_and_agg("bitmap").alias("__kept"), F.count(F.lit(1)).alias("__roles")).where(F.col("__roles") == needed)
    gone = bitmaps.where(term.isin(list(none_of))).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("__gone"))
    both = kept.join(gone, "bucket", "left").select("bucket", F.hex("__kept").alias("__kept"), F.hex("__gone").alias("__gone"))
    # one character of the hex text holds four bits; a byte's low half is its second character
    digit = F.posexplode(F.split("__kept", "")).alias("__at", "__digit")
    halves = both.select("bucket", "__gone", digit).where(~F.col("__digit").isin("0", ""))
    value = F.conv("__digit", 16, 10).cast("int").bitwiseAND(
        F.bitwise_not(F.coalesce(F.conv(F.expr("substring(__gone, __at + 1, 1)"), 16, 10).cast("int"), F.lit(0)))
    )
    low = F.floor(F.col("__at") / 2) * 8 + F.when(F.col("__at") % 2 == 0, 4).otherwise(0)
    bits = halves.select("bucket", low.alias("__low"), value.alias("__bits")).select("bucket", "__low", "__bits", F.explode(F.array(*map(F.lit, range(4)))).alias("__bit"))
    set_bits = bits.where(F.expr("shiftright(__bits, __bit) & 1 = 1"))
    return set_bits.select(((F.col("bucket") - 1) * 32_768 + F.col("__low") + F.col("__bit")).alias("doc_id"))


def build_positions(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Positional postings: doc_id, term and the positions of the term in the document, ascending from 0.

    Text is shuffled once, by document, and posted where it lands: a row per document and term is
    several times larger. With ``terms`` (a column term, one row each) only those are posted. Rows of one doc_id
    should be one row.
    """
    words = tokenised(docs).select("doc_id", F.posexplode_outer("tokens").alias("__at", "term")).where(F.col("term").isNotNull())
    if terms is not None:
        words = words.join(terms.select("term"), "term", "left_semi")
    return words.groupBy("doc_id", "term").agg(F.sort_array(F.collect_list("__at")).alias("positions"))


def phrase_search(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Documents that contain a phrase as consecutive tokens, and the token it first starts at.

    ``phrases`` has query_id and text. Positions count from 0. The rarest term of a phrase proposes
    documents; whether and where these have the phrase is seen in their tokens, in the partition they are in.
    """
    words, sought = tokenised(docs), _phrase_terms(phrases)
    near = _nearby(sought)
    terms = _exploded(words, F.array_distinct("tokens"))
    df = _document_frequency(terms.join(near(sought.select("term").distinct()), "term", "left_semi"))
    whole = near(phrases.select("query_id", tokens("text").alias("__phrase")))
    rarest = near(_rarest(sought, df).select("query_id", "term"))
    candidates = terms.join(rarest, "term").select("doc_id", "query_id").distinct()
    start = F.filter(F.sequence(F.lit(0), F.size("tokens") - F.size("__phrase")), _begins)
    found = words.join(candidates, "doc_id").join(whole, "query_id").where(F.size("tokens") >= F.size("__phrase"))
    return found.select("query_id", "doc_id", F.array_min(start).alias("position")).where(F.col("position").isNotNull())


def phrase_hits(positions: DataFrame, phrases: DataFrame) -> DataFrame:
    """The same over positional postings: query_id, doc_id, position.

    The rarest term of a phrase proposes where it may start; positions of its other terms, moved
    back by their place in the phrase, are intersected with that in the candidate documents only.
    """
    sought = _phrase_terms(phrases)
    df = _document_frequency(positions.join(sought.select("term").distinct(), "term", "left_semi"))
    rarest = _rarest(sought, df)
    candidates = (
        positions.join(rarest, "term")
        .select("query_id", "doc_id", "__n", F.col("__at").alias("__anchor"), _starts().alias("__starts"))
        .where(F.size("__starts") > 0)
    )
    others = sought.withColumnRenamed("__at", "__place")
    wanted = candidates.join(others, "query_id").where(F.col("__place") != F.col("__anchor")).select("query_id", "doc_id", "term", F.col("__place").alias("__at"))
    beside = wanted.join(positions, ["doc_id", "term"]).select("query_id", "doc_id", _starts().alias("__starts"))
    # as many rows per phrase and document as the phrase has words
    lists = candidates.select("query_id", "doc_id", "__starts").unionByName(beside)
    met = lists.groupBy("query_id", "doc_id").agg(F.collect_list("__starts").alias("__lists"))
    both = F.reduce(F.slice("__lists", F.lit(2), F.size("__lists")), F.get("__lists", F.lit(0)), F.array_intersect)
    lengths = rarest.select("query_id", "__n")
    found = met.join(lengths, "query_id").where(F.size("__lists") == F.col("__n"))
    return found.select("query_id", "doc_id", F.array_min(both).alias("position")).where(F.col("position").isNotNull())


def _starts() -> Column:
    """Where the phrase would start for each position of a term at ``__at`` in it."""
    return F.filter(F.transform("positions", lambda p: p - F.col("__at")), lambda p: p >= 0)


def _begins(at: Column) -> Column:
    """Whether the phrase is in the tokens from ``at`` on; its first word is looked at alone first."""
    return (F.get("tokens", at) == F.get("__phrase", F.lit(0))) & (F.slice("tokens", at + 1, F.size("__phrase")) == F.col("__phrase"))


def _rarest(sought: DataFrame, df: DataFrame) -> DataFrame:
    """query_id, the rarest term of the phrase, its place and the number of words."""
    # a term without postings is the rarest of all, and its phrase is nowhere
    return (
        sought.join(df, "term", "left")
        .groupBy("query_id")
        .agg(
            F.min_by(F.struct("term", "__at"), F.struct(F.coalesce("df", F.lit(0)), "term", "__at")).alias("__first"),
            F.count(F.lit(1)).alias("__n"),
        )
        .select("query_id", "__first.*", "__n")
    )


def _phrase_terms(phrases: DataFrame) -> DataFrame:
    """query_id, place in the phrase (``__at``) and term."""
    return phrases.select("query_id", F.posexplode_outer(tokens("text")).alias("__at", "term")).where(F.col("term").isNotNull())


def chunk_documents(docs: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of ``size`` tokens that share ``overlap`` tokens with the one before.

    The last window ends with the document. A document without tokens has no chunks.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    last = F.ceil(F.greatest(F.size("tokens") - size, F.lit(0)) / step).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    return (
        docs.select("doc_id", tokens("text").alias("tokens"))
        # the outer form, as in _exploded
        .select("doc_id", "tokens", F.posexplode_outer(starts).alias("chunk_no", "start"))
        .where(F.col("start") < F.size("tokens"))
        .withColumn("__chunk", F.slice("tokens", F.col("start") + 1, size))
        .select(
            "doc_id",
            "chunk_no",
            "start",
            F.size("__chunk").alias("n_tokens"),
            F.array_join("__chunk", " ").alias("text"),
        )
    )


def hybrid_topk(keyword: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, doc_id, rank): sum of 1 / (60 + rank)."""
    lists = keyword.select("query_id", "doc_id", F.col("rank").alias("keyword_rank")).join(
        vector.select("query_id", "doc_id", F.col("rank").alias("vector_rank")),
        ["query_id", "doc_id"],
        "full_outer",
    )

    def share(rank: str) -> Column:
        return F.coalesce(1 / (F.col(rank) + FUSION), F.lit(0.0))

    fused = lists.withColumn("score", F.round(share("keyword_rank") + share("vector_rank"), 6))
    return top_k(fused, ["query_id"], [F.col("score").desc(), F.col("doc_id")], k)


def search_snippets(hits: DataFrame, docs: DataFrame, queries: DataFrame, width: int) -> DataFrame:
    """The tokens around the first query term in each hit, ``width`` on either side.

    ``position`` and ``snippet`` are null for a hit without a query term.
    """
    asked = queries.select("query_id", F.array_distinct(tokens("text")).alias("__terms"))
    # joined before it is tokenised: only texts that were hit are; documents first, as few hits are broadcast to them
    found = (
        hits.join(docs.select("doc_id", F.col("text").alias("__text")), "doc_id")
        .join(asked, "query_id")
        .withColumn("__tokens", tokens("__text"))
    )
    # the intersection keeps the order of the text
    earliest = F.get(F.array_intersect("__tokens", "__terms"), F.lit(0))
    begin = F.greatest(F.col("__first") - width, F.lit(1))
    cut = F.slice("__tokens", begin.cast("int"), (F.col("__first") + width - begin + 1).cast("int"))
    return (
        found.withColumn("__first", F.array_position("__tokens", earliest))
        .withColumn("position", (F.col("__first") - 1).cast("int"))
        .withColumn("snippet", F.array_join(cut, " "))
        .drop("__terms", "__tokens", "__text", "__first")
    )


def collapse_duplicates(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """One hit per query and identical text: the one of best rank."""
    # hashed below the join, so that texts do not move
    hashes = docs.select("doc_id", F.sha2("text", 256).alias("__hash"))
    hashed = hits.join(hashes, "doc_id")
    order = [F.col("rank"), F.col("doc_id")]
    return top_k(hashed, ["query_id", "__hash"], order, 1, "__best").drop("__hash", "__best")


def search_facets(hits: DataFrame, docs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Hit counts per query by each column, and in all; ``facet`` is the grouping id.

    Hits are counted for each combination of values before they are multiplied into facets.
    """
    counts = (
        hits.join(docs.select("doc_id", *columns), "doc_id")
        .groupBy("query_id", *columns)
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    query = F.col("query_id")
    sets = [[query, F.col(c)] for c in columns] + [[query]]
    return counts.groupingSets(sets, query, *[F.col(c) for c in columns]).agg(
        F.grouping_id().cast("int").alias("facet"), F.sum("__n").alias("n")
    )


def retrieval_eval(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Recall at ``k`` and mean reciprocal rank over the queries that have a true document.

    ``truth`` has one row per (query_id, doc_id).
    """
    top = hits.where(F.col("rank") <= k).select("query_id", "doc_id", "rank")
    per_query = (
        truth.join(top, ["query_id", "doc_id"], "left")
        .groupBy("query_id")
        .agg(
            F.count(F.lit(1)).alias("__true"),
            F.count("rank").alias("__found"),
            F.min("rank").alias("__best"),
        )
    )
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.sum("__true").alias("n_true"),
        F.sum("__found").alias("n_found"),
        F.round(F.avg(F.col("__found") / F.col("__true")), 4).alias("recall"),
        F.round(F.avg(F.coalesce(1 / F.col("__best"), F.lit(0.0))), 4).alias("mean_reciprocal_rank"),
    )


def _document_frequency(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _nearby(wanted: DataFrame):
    """Broadcasts what has at most a row per row of ``wanted``, if that is bounded; one small job on the queries."""
    few = wanted.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    return F.broadcast if few else lambda rows: rows


def _query_terms(queries: DataFrame) -> DataFrame:
    return _exploded(queries.select("query_id", tokens("text").alias("tokens")), F.array_distinct("tokens"))


def _exploded(rows: DataFrame, words: Column) -> DataFrame:
    """One row per word instead of the array ``tokens``.

    The outer form with a filter after it: for the inner form Spark would first filter on
    the size of the array and so tokenise every text once more.
    """
    return rows.withColumn("term", F.explode_outer(words)).where(F.col("term").isNotNull()).drop("tokens")
