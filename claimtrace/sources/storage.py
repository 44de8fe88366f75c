"""Reading and writing files with declared schemas, and where intermediate tables go."""

import tempfile
import uuid
from collections.abc import Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SHARED_DIR_CONF = "spark.checkpoint.dir"


def read_rows(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", **options) -> DataFrame:
    """A batch read; the schema is always given, never inferred."""
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def stream_rows(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    fmt: str = "parquet",
    files_per_trigger: int | None = None,
    **options,
) -> DataFrame:
    """A file stream; ``files_per_trigger`` bounds one micro-batch."""
    if files_per_trigger is not None:
        options["maxFilesPerTrigger"] = files_per_trigger
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


def write_rows(
    df: DataFrame,
    path: str,
    mode: str = "errorifexists",
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> None:
    """A batch write; partition columns let later reads skip whole directories."""
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder.

    Only a session on a local master without that setting gets a temporary folder.
    """
    shared = spark.conf.get(SHARED_DIR_CONF, None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SHARED_DIR_CONF} to a folder that all executors share")
        shared = _local_folder()
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="claimtrace-")


def written(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For a result that several later steps read: it is computed once, its plan ends
    here, and the files outlive the executors that wrote them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
