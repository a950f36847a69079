"""Documents with several values of one key."""

from __future__ import annotations

import pytest

from granary.operators import metadata as M


@pytest.mark.parametrize(
    "condition,want",
    [
        (("lang", "=", "de"), {1, 3}),
        (("lang", "in", "de,en"), {1, 2}),
        (("lang", "not in", "fr"), {1, 2}),
        (("n", "≥", "10"), {2}),
        (("gone", "=", "x"), set()),
        (("empty", "empty", ""), {2}),
    ],
)
def test_first_value_and_all_values(spark, condition, want):
    rows = [(1, "lang", "de", 0), (1, "lang", "en", 1), (2, "lang", "en", 0), (3, "lang", "de", 0), (3, "lang", "fr", 1)]
    rows += [(1, "n", "9", 0), (1, "n", "70", 1), (2, "n", "10", 0), (2, "empty", "", 0), (3, "lang", None, 2)]
    meta = spark.createDataFrame(rows, "doc_id long, key string, value string, ord int")
    assert {r["doc_id"] for r in M.record_ids(meta, [condition]).collect()} == want
