import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerscope.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "ledgerscope-tests")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """``frame([(..), ..], "a long, b string")``."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def tiny_hot(spark):
    """Make every key with more than 3 rows hot, so the bucketed routes run."""
    from ledgerscope.scale import HOT_ROWS_CONF

    spark.conf.set(HOT_ROWS_CONF, "3")
    yield
    spark.conf.unset(HOT_ROWS_CONF)
