"""Every registered query against its oracle, on the smallest tables."""

import os

import pytest

from strongroom import plans
from strongroom.plans.registry import ORACLES, QUERIES
from tests.oracle import compare, connect

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
plans.load()


@pytest.fixture(scope="module")
def connection():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_oracle(spark, connection, name):
    equal, text = compare(spark, connection, name, QUERIES[name], ORACLES.get(name), DIRECTORY)
    assert equal, text


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
