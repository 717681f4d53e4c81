from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from llm_corpus import SCHEMA, corpus  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """Further columns that have the names the operators use within."""
    from pyspark.sql import functions as F

    names = "id mark key lines fp node label u v b p h size rid part length rank seq g score predicted hash n pos kept _id"
    return docs.withColumns({c: F.lit("clash") for c in names.split()})
