"""Queries that SQL can express give the rows of their SQL."""

from __future__ import annotations

import pytest

from compare import compare, connect
from marketmood.llm.oracles import ORACLES
from marketmood.llm.queries import REGISTRY


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    result = compare(spark, connect(sf_dir), sf_dir, REGISTRY[name], ORACLES[name])
    assert result["columns"] and not result["types"], result["types"]
    assert result["equal"], result["differences"]
