"""The tables, with declared schemas, and the roles they stand in for."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from claimtrace.functions import money
from claimtrace.sources.storage import read_rows, stream_rows

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

# order number and line number alone repeat; these five columns do not
LINE_KEY = ["order_id", "line_no", "code", "provider", "service_date"]


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_rows(spark, f"{path}/{name}.parquet", SCHEMAS[name])


def claim_lines(spark: SparkSession, path: str, member: bool = False) -> DataFrame:
    """One row per claim line; ``member=True`` joins the order to learn the member."""
    lines = table(spark, path, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("code"),
        F.col("l_suppkey").alias("provider"),
        F.col("l_shipdate").alias("service_date"),
        F.col("l_quantity").alias("units"),
        money("l_extendedprice").alias("paid"),
    )
    if not member:
        return lines
    orders = table(spark, path, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("member")
    )
    return lines.join(orders, "order_id")


def case_events(spark: SparkSession, path: str) -> DataFrame:
    return as_case_events(table(spark, path, "events"))


def stream_events(
    spark: SparkSession, path: str, files: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """Case events as a stream; watermarks need ``timestamp``, so the time is cast."""
    events = stream_rows(
        spark, path, SCHEMAS["events"], files_per_trigger=files_per_trigger, pathGlobFilter=files
    )
    return as_case_events(events).withColumn("ts", F.col("ts").cast("timestamp"))


def as_case_events(events: DataFrame) -> DataFrame:
    """The columns of a case event, from the events table."""
    return events.select(
        F.col("user_id").alias("case_id"),
        "event_id",
        "ts",
        F.col("event_type").alias("state"),
        money("value").alias("amount"),
        "props",
    )


def obligations(events: DataFrame) -> DataFrame:
    return _entries(events, "error")


def recoveries(events: DataFrame) -> DataFrame:
    return _entries(events, "purchase")


def _entries(events: DataFrame, state: str) -> DataFrame:
    return events.where(F.col("state") == state).select(
        F.col("case_id").alias("party"), F.col("event_id").alias("entry_id"), "ts", "amount"
    )


def documents(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "documents").select("doc_id", "text", "lang", "source")


def search_queries(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def document_vectors(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
