"""The queries that SQL can express, against DuckDB on the same files."""

from __future__ import annotations

import pytest

from tests import oracle
from varve.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, tiny, name):
    assert oracle.assert_same(queries.QUERIES[name](spark, tiny), oracle.connect(tiny), queries.ORACLES[name]) > 0
