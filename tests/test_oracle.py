"""Every registered query: a clean physical plan, and the rows of its DuckDB counterpart."""

import os

import pytest
from compare import TESTDATA, compare, oracle_connection

import __spark_entry__ as entry
from tallyframe import plans

FOLDER = str(TESTDATA / os.environ.get("TALLYFRAME_TEST_SF", "sf0.001"))
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
    assert entry.FLAGSHIP in ORACLES
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(QUERIES) == set(ORACLES)


# No cross or nested-loop join, and no Python in the data path.
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "MapInArrow", "FlatMapGroupsInArrow", "AggregateInPandas", "WindowInPandas"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    frame = QUERIES[name](spark, FOLDER)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    problems = compare(connection, name, frame, ORACLES.get(name))
    assert not problems, "\n".join(problems)
