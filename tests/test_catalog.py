"""Every query of the catalogue against its SQL, on the smallest tables."""

import pytest
from oracle import compare, connect

from keyweave.catalog.all_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def runs_on_spark_operators_alone(df):
    """No cross join, no window over everything, and no Python in the rows' way."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "NestedLoop", "Window", "EvalPython", "InPandas"):
        assert operator not in plan


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_its_sql(spark, duck, name):
    assert QUERIES[name].sql, "every query has its SQL"
    assert compare(spark, duck, name, QUERIES[name], FOLDER, runs_on_spark_operators_alone) is None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(QUERIES) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())
