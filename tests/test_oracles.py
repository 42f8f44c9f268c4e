"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

from roadpass import oracles
from roadpass.queries import REGISTERED
from tests.compare import connect, difference

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = oracles.sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="benchmark tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(REGISTERED)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, duck, name):
    assert difference(REGISTERED[name](spark, SF_DIR), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(REGISTERED) - set(SQL)))
def test_query_without_sql_yields_rows(spark, name):
    assert REGISTERED[name](spark, SF_DIR).count() > 0
