"""Queries that have a SQL twin, over the small test tables."""

from __future__ import annotations

import pytest

from granary.llm.registry import ORACLES, QUERIES
from tests.comparing import connected, differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connected(sf_dir), ORACLES[name]) == ""
