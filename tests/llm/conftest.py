import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [HERE, os.path.dirname(os.path.dirname(HERE))]

DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def frame(spark):
    """``frame(rows)``: documents with extra columns whose names clash with those the operators use."""
    def make(rows, schema=DOCS):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(rows, schema)
        return df.withColumns({c: F.lit("x") for c in ("id", "row", "tag", "fp", "_gone", "keep_id", "kept")})
    return make
