"""Every registered query gives what its SQL counterpart gives."""

from __future__ import annotations

import os

import pytest
from compare import compare, connect

from gridmeter.queries import ORACLE, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLE[name]) == []


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
