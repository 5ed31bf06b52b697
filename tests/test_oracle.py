"""Every registered query against DuckDB on the smallest tables."""

import pytest

from check_oracle import compare, duck
from conftest import SMALL
from signalmill.plans.oracle import ORACLE
from signalmill.plans.registry import QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_oracle(spark, con, key):
    assert compare(spark, con, key, QUERIES[key], ORACLE[key], SMALL) == ""
