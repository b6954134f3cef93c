"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import compare

SF_DIR = "/root/testdata/sf0.001"
JOBS, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return compare.duck(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables are not here")
@pytest.mark.parametrize("name", list(JOBS))
def test_query_equals_sql(spark, con, name):
    assert compare.compare(spark, con, name, JOBS[name], SQL.get(name), SF_DIR) is None


def test_comparison_sees_a_difference(spark, con):
    job = lambda s, d: s.sql("SELECT 1 AS a, 'x' AS b")
    assert compare.compare(spark, con, "n", job, "SELECT 1 AS a, 'x' AS b", SF_DIR) is None
    assert "difference" in compare.compare(spark, con, "n", job, "SELECT 1 AS a, 'y' AS b", SF_DIR)
    assert "rows" in compare.compare(spark, con, "n", job, "SELECT 1 AS a, 'x' AS b UNION ALL SELECT 1, 'x'", SF_DIR)
    assert "columns" in compare.compare(spark, con, "n", job, "SELECT 1 AS a, 'x' AS c", SF_DIR)


def test_entry(spark):
    assert entry.entry(spark).columns == ["page_id", "markdown"]
