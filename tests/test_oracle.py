"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest
from oracle import compare, connect

from ledgerscope.plans.catalog import load

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
CATALOG = load()


@pytest.fixture(scope="module")
def con():
    connection = connect(SF)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if sql])
def test_matches_sql(spark, con, name):
    job, sql = CATALOG[name]
    assert compare(job(spark, SF), con, sql) == []


@pytest.mark.parametrize("name", [n for n, (_, sql) in CATALOG.items() if not sql])
def test_runs(spark, name):
    job, _ = CATALOG[name]
    assert job(spark, SF).take(1)
