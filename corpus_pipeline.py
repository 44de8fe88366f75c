"""Documents to training tokens: five stages, each over all that the one before has kept."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimtrace.llm import bpe, decontamination, lines, ngrams, toxicity
from claimtrace.llm.queries import TOKENIZER
from claimtrace.sources import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the toxicity model, learnt from the labels, rejects."""
    return toxicity.reject_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that a large share of a source's documents carry; n_chars follows the text."""
    cleaned = lines.line_dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned.select([F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngrams.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a window of a benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and hashes of ids and decoded text."""
    return bpe.digests(docs, TOKENIZER, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]

#: a trained model and a tokenizer are not expressible in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
