"""A search index on disk that is updated by segments, as far as the changed documents go.

An update writes the postings and lengths of changed documents as a segment; what earlier segments say
of these documents is dead from then on, which marks in the segment record, for those documents that an earlier
segment has. Document
frequencies are kept by difference: one more for every term a changed document has now, one less for every term it had. The
terms it had come from a forward table (document, its terms and how often each) dealt out by a hash of
the document, of which only the buckets of changed documents are read. FAN segments of one tier are
merged into one of the next, without what is dead.

Text moves once, by document; buckets follow that partitioning, so the forward table is written where documents
land, and postings are its rows taken apart, sorted by term within a file. Postings move when tiers are merged.
"""

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimtrace.functions import tokens
from claimtrace.operators.search import Index, text_parts
from claimtrace.sources import manifests
from claimtrace.sources.storage import written

FAN = 8
BUCKETS = 256
#: documents whose marks are broadcast, at most (some 64 bytes each); more are joined by document
NEAR_MARKS = 2_000_000
_POSTINGS = "doc_id bigint, term string, length int, tf bigint"
_LENGTHS = "doc_id bigint, length int"
_FORWARD = "doc_id bigint, length int, terms array<struct<term: string, tf: bigint>>, bucket int"
_MARKS = "doc_id bigint"
_TERMS = "term string, df bigint"


def update_index(spark: SparkSession, path: str, changed: DataFrame, removed: DataFrame | None = None) -> None:
    """Replaces the ``changed`` documents (doc_id, text) and takes out the ``removed`` ones (doc_id).

    A first update creates the index. A document is one row of ``changed``; one that is changed and removed is
    changed. One writer at a time: an update that another one overtook is an error and
    changes nothing.
    """
    segments = _segments(spark, path)
    ids = changed.select("doc_id")
    if removed is not None:
        ids = ids.unionByName(removed.select("doc_id"))
    ids = written(ids.distinct().withColumn("bucket", _bucket()), "changed-documents")
    # what earlier segments say of these is dead; other documents need no mark
    known = _read(spark, path, segments, "lengths", _LENGTHS).select(F.col("doc_id").alias("__id")).distinct()
    old = written(ids.join(known, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi"), "known-documents")
    number = 1 + max((s["number"] for s in segments), default=0)
    folder = _folder(number, 0)
    _forward(changed).write.partitionBy("bucket").parquet(f"{path}/{folder}/forward")
    forward = spark.read.schema(_FORWARD).parquet(f"{path}/{folder}/forward")
    gone = _old_terms(spark, path, segments, old)
    terms = forward.select(F.explode("terms.term").alias("term"), F.lit(1).alias("df")).unionByName(gone.select("term", F.lit(-1).alias("df")))
    tables = {
        "postings": forward.select("doc_id", "length", F.inline("terms")).select("doc_id", "term", "length", "tf").sortWithinPartitions("term", "doc_id"),
        "lengths": forward.select("doc_id", "length"),
        "marks": old.select("doc_id"),
        "terms": _summed(terms),
    }
    _write(spark, path, folder, tables, number, 0, [])
    _merge_tiers(spark, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """Postings, lengths and terms of the documents as they are now."""
    segments = _segments(spark, path)
    live = lambda table, schema: _live(spark, path, segments, segments, table, schema)
    columns = [f.split()[0] for f in _POSTINGS.split(", ")]
    terms = _summed(_read(spark, path, segments, "terms", _TERMS).select("term", "df"))
    return Index(live("postings", _POSTINGS).select(columns), live("lengths", _LENGTHS).select("doc_id", "length"), terms)


def expire_segments(spark: SparkSession, path: str, keep: int = 10) -> None:
    """Removes all but the last ``keep`` states of the index, and the folders that no other names."""
    manifests.expire(spark, path, keep, lambda m: {s["folder"] for s in m["segments"]})


def _segments(spark: SparkSession, path: str) -> list[dict]:
    return manifests.latest(spark, path).get("segments", [])


def _bucket():
    """The hash that partitions rows by doc_id, so that a partition of a power of two holds few buckets."""
    return F.pmod(F.hash(F.col("doc_id").cast("bigint")), F.lit(BUCKETS)).cast("int")


def _forward(docs: DataFrame) -> DataFrame:
    """Documents with their length and terms, counted where the text lands."""
    parts = 1 << (text_parts(docs) - 1).bit_length()
    words = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), tokens("text").alias("tokens")).repartition(parts, "doc_id")
    # outer: documents without terms stay
    terms = words.select("doc_id", F.size("tokens").alias("length"), F.explode_outer("tokens").alias("term"))
    counted = terms.groupBy("doc_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))
    own = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    return counted.groupBy("doc_id", "length").agg(F.collect_list(own).alias("terms")).withColumn("bucket", _bucket())


def _summed(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term").agg(F.sum("df").cast("bigint").alias("df")).where(F.col("df") != 0)


def _read(spark: SparkSession, path: str, segments: Sequence[dict], table: str, schema: str) -> DataFrame:
    """Rows of the segments, with the number of the segment each is from."""
    rows = spark.createDataFrame([], f"{schema}, __segment bigint")
    for s in segments:
        part = spark.read.schema(schema).parquet(f"{path}/{s['folder']}/{table}")
        rows = rows.unionByName(part.withColumn("__segment", F.lit(s["number"]).cast("bigint")))
    return rows


def _live(spark: SparkSession, path: str, segments: Sequence[dict], later: Sequence[dict], table: str, schema: str) -> DataFrame:
    """Rows that no later segment marks as dead; of marks there is a row per document changed since the last merges."""
    last = max((s["number"] for s in later), default=0)
    rows = _read(spark, path, [s for s in segments if s["number"] < last], table, schema)
    marks = _read(spark, path, later, "marks", _MARKS)
    marks = _near(marks, marks.groupBy("doc_id").agg(F.max("__segment").alias("__dead")))
    # a null document is a document
    same = rows["doc_id"].eqNullSafe(marks["doc_id"]) & (marks["__dead"] > rows["__segment"])
    # nothing is later than the last segment
    return rows.join(marks, same, "left_anti").unionByName(_read(spark, path, [s for s in segments if s["number"] >= last], table, schema))


def _near(counted: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows``, broadcast if they are no more than NEAR_MARKS, so that postings and terms need not move."""
    return F.broadcast(rows) if counted.count() <= NEAR_MARKS else rows


def _old_terms(spark: SparkSession, path: str, segments: Sequence[dict], ids: DataFrame) -> DataFrame:
    """Terms that the changed documents have had: only their buckets of the forward table are read."""
    # at most BUCKETS numbers
    buckets = [r.bucket for r in ids.select("bucket").distinct().collect()]
    rows = _live(spark, path, segments, segments, "forward", _FORWARD).where(F.col("bucket").isin(buckets))
    own = _near(ids, ids.select(F.col("doc_id").alias("__id")))
    had = rows.select("doc_id", F.col("terms.term").alias("terms")).join(own, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return had.select(F.explode("terms").alias("term"))


def _folder(number: int, tier: int) -> str:
    return f"segments/{number}-{tier}-{uuid.uuid4().hex}"


def _write(spark: SparkSession, path: str, folder: str, tables: dict[str, DataFrame], number: int, tier: int, replaced: list[dict]) -> None:
    for name, rows in tables.items():
        writer = rows.write
        if name == "forward":
            writer = rows.repartition("bucket").write.partitionBy("bucket")
        writer.parquet(f"{path}/{folder}/{name}")
    segment = {"folder": folder, "number": number, "tier": tier}

    def change(now: dict) -> dict | None:
        segments = now.get("segments", [])
        if replaced:
            if any(s not in segments for s in replaced):
                return None
        elif number != 1 + max((s["number"] for s in segments), default=0):
            raise RuntimeError(f"{path}: another update was faster")
        return {"segments": [s for s in segments if s not in replaced] + [segment]}

    manifests.commit(spark, path, change)


def _merge_tiers(spark: SparkSession, path: str) -> None:
    """Segments of a tier are neighbours in number, so a merged one takes the greatest of theirs."""
    tier = 0
    while True:
        segments = _segments(spark, path)
        own = [s for s in segments if s["tier"] == tier]
        if len(own) < FAN:
            return
        number = max(s["number"] for s in own)
        live = lambda table, schema, own=own: _live(spark, path, own, own, table, schema).drop("__segment")
        tables = {
            "postings": live("postings", _POSTINGS).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id"),
            "lengths": live("lengths", _LENGTHS),
            "forward": live("forward", _FORWARD),
            "marks": _read(spark, path, own, "marks", _MARKS).select("doc_id").distinct(),
            "terms": _summed(_read(spark, path, own, "terms", _TERMS).select("term", "df")),
        }
        _write(spark, path, _folder(number, tier + 1), tables, number, tier + 1, own)
        tier += 1
