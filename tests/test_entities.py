"""Resolution and reduction of records against plain Python."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import entities as E
from granary.operators import merging as G


@pytest.mark.parametrize("exact", [True, False])
def test_resolution(spark, exact):
    draw = np.random.default_rng(1)
    centre = draw.normal(size=(12, 16))
    rows = []
    for i in range(80):
        name = None if i == 5 else ["  Name  ", "NAME ", "name"][i % 3] + f" {i % 25}"
        vector = None if i % 9 == 0 else (centre[i % 25 % 12] + 0.02 * draw.normal(size=16)).tolist()
        rows.append((i, name, vector, None if i % 7 == 0 else "d" * (i % 11), i % 5))
    frame = spark.createDataFrame(rows, "id long, name string, vector array<double>, description string, mentions long").repartition(4)
    members = E.resolved(frame, 0.95, exact)
    key = {i: " ".join((n or f"\0{i}").lower().split()) for i, n, *_ in rows}
    vector = {}
    for i, _, v, *_ in rows:
        if v is not None:
            vector.setdefault(key[i], np.array(v))
    first = {k: min(i for i in key if key[i] == k) for k in set(key.values())}
    root = dict(first)
    for a in vector:
        for b in vector:
            if a < b and np.dot(vector[a], vector[b]) / np.linalg.norm(vector[a]) / np.linalg.norm(vector[b]) >= 0.95:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    want = {i: root[key[i]] for i in key}
    assert {r["id"]: r["entity_id"] for r in members.collect()} == want
    assert len(set(want.values())) < 25
    got = {r["entity_id"]: (r["name"], r["description"], r["mentions"], r["n"]) for r in E.reduced(frame, members).collect()}
    for entity in set(want.values()):
        own = [r for r in rows if want[r[0]] == entity]
        name = max(own, key=lambda r: (r[4], -r[0]))[1]
        texts = [r for r in own if r[3] is not None]
        text = max(texts, key=lambda r: (len(r[3]), -r[0]))[3] if texts else None
        assert got[entity] == (name, text, sum(r[4] for r in own), len(own))


def edits_between(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_pairs(spark, monkeypatch):
    """Every pair of names within two edits as often as rows have both, whatever a pair's copies are split into."""
    monkeypatch.setattr(G, "COPIES", 3)
    draw = np.random.default_rng(3)
    names = ["".join(draw.choice(list("abé1"), draw.integers(0, 7))) for _ in range(150)] + [None, "", "ab", "ab", "ab", "ba", "ba"]
    rows = [(None if i % 40 == 0 else i % 3, n) for i, n in enumerate(names)]
    want = [(a, b) for x, a in rows for y, b in rows if x is not None and x == y and None not in (a, b) and a < b and edits_between(a, b) <= 2]
    got = G.edit_pairs(spark.createDataFrame(rows, "kind int, name string"), "kind", "name", 2)
    assert sorted((r["a"], r["b"]) for r in got.collect()) == sorted(want)


def test_edit_pairs_compares_few(spark):
    """Unlike names of one kind are not all compared: names and the texts left of them grow with the rows, pairs do not."""
    names = spark.range(3000).select(F.lit(1).alias("kind"), F.md5(F.col("id").cast("string")).substr(1, 12).alias("name"))
    plan = G.edit_pairs(names, "kind", "name", 2)
    assert plan.count() == 0
    shared = names.select(F.explode(G.shortened(F.col("name"), 2)).alias("v")).groupBy("v").count()
    assert shared.agg(F.max("count")).first()[0] < 10
