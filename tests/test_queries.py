"""Every registered query next to its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import connect, difference
from checks.queries import QUERIES
from checks.sql import ORACLE

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry(spark):
    assert entry.entry(spark).count() == 6


#: Of these SQL can't tell the rows; others with SQL, and tests, check them.
WITHOUT_SQL = {"knn_approx"}


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    assert difference(spark, con, QUERIES[name], ORACLE[name], SF_DIR) is None
