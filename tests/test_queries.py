"""Every registered query gives the rows of its SQL."""

import pytest

import __spark_entry__ as driver
from workload.check import compare, connect
from workload.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    assert compare(spark, name, SF_DIR, connection) in ("", "equal, but empty")


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_entry_has_rows(spark):
    assert driver.entry(spark).columns == ["word", "count"]
    assert driver.entry(spark).count() == 30
