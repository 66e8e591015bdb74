"""Every registered query against its SQL on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from check import canonical
from stratalens.catalog import QUERIES
from stratalens.oracle import oracle_queries

SF_DIR = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def test_all_queries_have_sql():
    assert set(oracle_queries()) == set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    found = contract.queries()[name](spark, str(SF_DIR)).toPandas()
    expected = con.execute(contract.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert canonical(found).equals(canonical(expected))


def test_entry(spark):
    assert contract.entry(spark).columns == ["n", "block_start", "block_end", "average_distance"]


@pytest.mark.parametrize("name", ["best_block", "choice_accuracy", "running_loss", "collate_pad", "comparison_rows"])
def test_plans_have_no_products(spark, name):
    plan = contract.queries()[name](spark, str(SF_DIR))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
