from __future__ import annotations

import os
from collections.abc import Callable

import pytest
from pyspark.sql import DataFrame, SparkSession

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def small() -> str:
    return os.path.join(DATA, "sf0.001")


@pytest.fixture
def documents(spark: SparkSession) -> Callable[[list], DataFrame]:
    """A table of documents from (doc_id, text) pairs."""
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
