"""The segmented index after updates, removals and merges, against one built anew."""

import random

import pytest

from claimtrace.operators import search, segments
from tests.oracle import spark_rows

DOCS = "doc_id bigint, text string"
WORDS = ["alpha", "beta", "gamma", "delta", "eps"]


def _same(spark, path, docs: dict):
    index = segments.open_index(spark, path)
    built = search.build_postings(spark.createDataFrame(list(docs.items()), DOCS))
    for ours, theirs in zip(index, built, strict=True):
        assert spark_rows(ours.select(sorted(ours.columns))) == spark_rows(theirs.select(sorted(theirs.columns)))


@pytest.mark.parametrize("fan", [2, 8])
def test_updates_and_removals(spark, tmp_path, monkeypatch, fan):
    monkeypatch.setattr(segments, "FAN", fan)
    rng, path, docs = random.Random(fan), str(tmp_path / "index"), {}
    for round_no in range(5):
        changed = {i: rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randint(1, 9)))]) for i in rng.sample(range(12), 5)}
        gone = [i for i in rng.sample(range(12), 2) if i not in changed]
        segments.update_index(
            spark, path, spark.createDataFrame(list(changed.items()), DOCS), spark.createDataFrame([(i,) for i in gone], "doc_id bigint")
        )
        docs = {i: t for i, t in docs.items() if i not in gone} | changed
        if round_no in (0, 4):
            _same(spark, path, docs)
    assert len(segments._segments(spark, path)) == (5 if fan == 8 else 2)
    segments.expire_segments(spark, path, keep=1)
    _same(spark, path, docs)


def test_an_update_reads_the_buckets_of_changed_documents_alone(spark, tmp_path):
    path = str(tmp_path / "index")
    many = spark.range(2000).selectExpr("id AS doc_id", "concat('alpha w', id) AS text")
    segments.update_index(spark, path, many)
    ids = spark.createDataFrame([(7,)], "doc_id bigint").withColumn("bucket", segments._bucket())
    plan = segments._old_terms(spark, path, segments._segments(spark, path), ids)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_new_documents_need_no_marks(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(i, f"alpha w{i}") for i in range(10)] + [(None, "alpha")], DOCS)
    segments.update_index(spark, path, docs.where("doc_id < 5"))
    segments.update_index(spark, path, docs.where("doc_id >= 4 or doc_id is null"))
    marks = segments._read(spark, path, segments._segments(spark, path), "marks", segments._MARKS)
    assert [(r.doc_id, r["__segment"]) for r in marks.collect()] == [(4, 2)]


def test_an_index_of_nothing(spark, tmp_path):
    assert segments.open_index(spark, str(tmp_path / "none")).postings.count() == 0
    segments.update_index(spark, str(tmp_path / "empty"), spark.createDataFrame([], DOCS))
    assert segments.open_index(spark, str(tmp_path / "empty")).terms.count() == 0
