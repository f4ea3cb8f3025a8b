import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark, tmp_path_factory):
    """The edge table, as Parquet files."""
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    spark.createDataFrame(brute.edge_rows(), brute.SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)
