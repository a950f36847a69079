"""Beam search against a plain beam."""

from __future__ import annotations

import numpy as np
import pytest

from granary.operators import trees as T


def cosine(a, b):
    size = np.linalg.norm(a) * np.linalg.norm(b)
    return round(float(np.dot(a, b) / size), 9) if size else 0.0


def plain(nodes, query, beam, k):
    """``nodes``: node -> (parent, vector)."""
    kids = {}
    for n, (p, _) in nodes.items():
        kids.setdefault(p, []).append(n)
    front, leaves = kids.get(None, []), []
    while front:
        kept = sorted((-cosine(nodes[n][1], query), n) for n in front)[:beam]
        leaves += [x for x in kept if x[1] not in kids]
        front = [c for _, n in kept for c in kids.get(n, [])]
    return [(n, -s) for s, n in sorted(leaves)[:k]]


@pytest.mark.parametrize("beam", [1, 3, 50])
def test_beam(spark, beam):
    draw = np.random.default_rng(beam)
    trees = {}
    for tree in ("a", "b"):
        nodes = {f"r{i}": (None, draw.normal(size=4)) for i in range(2)}
        for i in range(60):  # leaves at all depths
            parent = list(nodes)[int(draw.integers(0, len(nodes)))]
            nodes[f"n{i}"] = (parent, draw.normal(size=4) if i % 7 else nodes[parent][1])
        trees[tree] = nodes
    rows = [(t, n, p, v.tolist()) for t, nodes in trees.items() for n, (p, v) in nodes.items()] + [("c", "x", "y", [1.0]), ("c", "y", "x", [1.0])]
    queries = [(i, "ab"[i % 2], draw.normal(size=4).tolist()) for i in range(6)] + [(7, "none", [1.0] * 4), (8, "a", [0.0] * 4), (9, "c", [1.0])]
    frame = spark.createDataFrame(rows, "tree string, node string, parent string, vector array<double>")
    asked = spark.createDataFrame(queries, "query long, tree string, vector array<double>")
    got = {}
    for r in T.beam_search(frame, asked, beam, 4).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["node"], r["score"]))
    want = {q: x for q, t, v in queries if t in trees and (x := plain(trees[t], np.array(v), beam, 4))}
    assert got == {q: [(n, pytest.approx(s, abs=2e-9)) for n, s in x] for q, x in want.items()}


def test_collapsed(spark):
    frame = spark.createDataFrame([("t", "a", None, [1.0, 0.0]), ("t", "b", "a", [0.0, 1.0]), ("t", "c", "a", [1.0, 1.0])], "tree string, node string, parent string, vector array<double>")
    asked = spark.createDataFrame([(1, "t", [1.0, 0.1])], "query long, tree string, vector array<double>")
    assert [r["node"] for r in T.collapsed_search(frame, asked, 2).orderBy("rank").collect()] == ["a", "c"]
