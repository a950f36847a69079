"""Every query of the library against its SQL twin, over the small test tables."""

from __future__ import annotations

import pytest

from granary.plans.registry import ORACLES, QUERIES

from .comparing import connected, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connected(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, con, name):
    assert differences(QUERIES[name](spark, sf_dir), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_give_rows(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    assert found.count() > 0
