import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_cases import SCHEMA, edge_texts  # noqa: E402


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i, t, "de" if n % 3 else None, s, len(t or ""), 1, "r", 2, "x", 3, 4, 5, 6) for n, (i, t, s) in enumerate(edge_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
