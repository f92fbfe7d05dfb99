"""Registered queries against independent SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from checks.compare import database, differences

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_entry(spark):
    assert driver.entry(spark).count() == 1


def test_every_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = driver.queries()[name](spark, FOLDER).toPandas()
    assert differences(got, con.sql(driver.oracle_sql()[name]).df()) == ""
