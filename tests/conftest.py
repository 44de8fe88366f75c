import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def make_session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("claimtrace")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark():
    session = make_session()
    yield session
    session.stop()


@pytest.fixture
def split(spark):
    """Treats groups of more than 3 rows as hot, to run the paths for very large groups."""
    spark.conf.set("claimtrace.hotRows", "3")
    spark.conf.set("claimtrace.hotSample", "1")
    yield
    spark.conf.unset("claimtrace.hotRows")
    spark.conf.unset("claimtrace.hotSample")
