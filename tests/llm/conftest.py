from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows, columns="doc_id long, text string, lang string"):
        rows = [(*r, *[None] * (3 - len(r)))[:3] for r in rows]
        return spark.createDataFrame(rows, T.StructType.fromDDL(columns))

    return make
