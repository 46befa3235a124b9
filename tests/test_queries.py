"""Every registered query against its SQL on DuckDB."""

import os

import pytest

import __spark_entry__ as entry_file
from playmetrics.queries import QUERIES, SQL
from tests.compare import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    connection = connect(FOLDER)
    yield connection
    connection.close()


def test_entry(spark):
    df = entry_file.entry(spark)
    assert df.columns == ["season", "epa_per_play"] and df.count() > 0


def test_registry():
    assert QUERIES.items() <= entry_file.queries().items() and SQL.items() <= entry_file.oracle_sql().items()
    assert set(entry_file.oracle_sql()) <= set(entry_file.queries())
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert differences(spark, con, name, FOLDER) == []


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("model_compare", "importance")])
def test_no_query_multiplies_rows(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
