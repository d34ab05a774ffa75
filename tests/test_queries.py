"""Every registered query against DuckDB at the smallest scale."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_points  # noqa: E402
from check_queries import compare, connect  # noqa: E402

from coogrid.catalog import QUERIES, SQL  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="tables not mounted")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, name, QUERIES[name], SQL[name])
    assert ok, note


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["row_id", "col_id"] and df.count() == 28414
