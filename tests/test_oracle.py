"""Every registered query against its SQL in another engine."""

import pytest

import __spark_entry__ as entry
from tests.compare import database, difference

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLES)


@pytest.mark.parametrize("name", list(entry.QUERIES))
def test_query(spark, connection, name):
    ours = entry.queries()[name](spark, FOLDER).toPandas()
    theirs = connection.execute(entry.oracle_sql()[name]).df()
    assert difference(ours, theirs) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 8
