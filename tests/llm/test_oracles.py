"""Queries with SQL against it, over whole tables."""

import pytest
from oracle import compare, connect

from keyweave.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [name for name, query in QUERIES.items() if query.sql])
def test_query_equals_its_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, QUERIES[name], FOLDER) is None
