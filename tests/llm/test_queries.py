"""The registered text queries against SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from claimtrace.llm import decontamination, lines, ngrams, toxicity
from claimtrace.llm.queries import ORACLES, QUERIES
from claimtrace.sources import table
from tests.oracle import duck, duck_rows, spark_rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    found = QUERIES[name](spark, SMALL)
    columns, rows = duck_rows(duck(SMALL), ORACLES[name])
    assert columns == sorted(found.columns)
    assert spark_rows(found) == rows


def test_pipeline_is_its_stages_one_after_the_other(spark):
    """Each stage against the operator that decides it, on what the stage before has kept."""
    docs = table(spark, SMALL, "documents")
    whole = docs.columns
    model = toxicity.train(docs, table(spark, SMALL, "labels"))
    clean = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 0").collect()}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["toxicity"](spark, docs, SMALL)
    assert {r.doc_id for r in one.collect()} == clean and one.columns == whole
    two = stages["line_dedup"](spark, one, SMALL)
    assert {r.doc_id: r.text for r in two.collect()} == {r.doc_id: r.text for r in lines.line_dedup(one).collect()}
    assert two.columns == whole
    three = stages["ngram_jaccard"](spark, two, SMALL)
    kept = {r.doc_id for r in ngrams.jaccard_components(two).collect() if r.doc_id == r.component_id}
    assert {r.doc_id for r in three.collect()} == kept and three.columns == whole
    four = stages["decontamination"](spark, three, SMALL)
    hit = decontamination.decontaminate(three, table(spark, SMALL, "benchmark")).where("n_hit > 0")
    assert {r.doc_id for r in four.collect()} == kept - {r.doc_id for r in hit.collect()} and four.columns == whole
    out = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert set(out) == {r.doc_id for r in four.collect()}
