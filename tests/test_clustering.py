"""Clusters, near vectors, strongly connected components and groups of names against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from granary.operators import clustering as K
from granary.operators import graphs as G


def plain_clusters(vectors: list[list[float]], least: float, most: int) -> list[list[int]]:
    def cos(a, b):
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return float(np.dot(a, b) / size) if size else 0.0

    out = [[i] for i in range(len(vectors))]
    while True:
        best, pair = 0.0, None
        for i in range(len(out)):
            for j in range(i + 1, len(out)):
                if len(out[i]) + len(out[j]) > most:
                    continue
                mean = sum(cos(vectors[a], vectors[b]) for a in out[i] for b in out[j]) / (len(out[i]) * len(out[j]))
                if mean > best + 1e-9 and mean >= least:
                    best, pair = mean, (i, j)
        if pair is None:
            return out
        i, j = pair
        out[i] += out.pop(j)


@pytest.mark.parametrize("seed", range(4))
def test_average_link(seed):
    draw = np.random.default_rng(seed)
    vectors = draw.normal(size=(18, 5))
    vectors[3] = 0
    want = sorted(sorted(c) for c in plain_clusters(vectors.tolist(), 0.3, 5))
    assert sorted(sorted(c) for c in K.average_link(vectors, 0.3, 5)) == want


def test_balanced_clusters_keep_their_share(spark):
    draw = np.random.default_rng(5)
    v = np.concatenate([draw.normal(0, 0.1, size=(50, 3)), draw.normal(5, 0.1, size=(10, 3))])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "k long, e array<double>")
    got = K.balanced_clusters(rows, "k", "e", 4).collect()
    assert sorted(r["k"] for r in got) == list(range(60))
    assert max(np.bincount([r["cluster"] for r in got])) <= 15


def test_summary_tree_links_every_node(spark):
    draw = np.random.default_rng(6)
    rows = [(g, i, f"Text {i} here. More.", draw.normal(size=3).tolist()) for g in range(3) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, k int, t string, e array<double>")
    got = K.summary_tree(df, "g", "k", "t", "e", 0.2, 4, 3).collect()
    names = {(r["g"], r["node"]): r for r in got}
    assert sum(r["level"] == 0 for r in got) == 36
    for r in got:
        assert r["parent"] is None or names[r["g"], r["parent"]]["level"] == r["level"] + 1
    assert any(r["level"] == 1 and r["text"].startswith("Text") for r in got)


def plain_components(edges: list[tuple[int, int]]) -> dict[int, int]:
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            new = reach[b] - reach[a]
            if new:
                reach[a] |= new
                changed = True
        for n in nodes:
            more = set().union(*(reach[m] for m in reach[n])) - reach[n]
            if more:
                reach[n] |= more
                changed = True
    return {n: min(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_strong_components(spark, seed):
    draw = random.Random(seed)
    edges = [(draw.randrange(30), draw.randrange(30)) for _ in range(38)]
    got = {r["id"]: r["component"] for r in G.strong_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == plain_components(edges)


def test_name_groups(spark):
    names = ["Acme Corp", "acme corp.", "ACME CORP", "Zeta", "zeta!", "x", ""]
    df = spark.createDataFrame(list(enumerate(names)), "k int, n string")
    got = {r["k"]: r["group_id"] for r in K.name_groups(df, "k", "n", 0.7).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 6}


def test_summaries(spark):
    df = spark.createDataFrame([(1, 0, "Hi. Long first"), (1, 1, "A longer sentence. x"), (2, 0, "abc")], "c int, o int, t string")
    got = {r["c"]: r["summary"] for r in K.summaries(df, ["c"], "o", "t").collect()}
    assert got == {1: "A longer sentence.", 2: "abc"}
    assert K.extract_summary(["Hi. Long first", "A longer sentence. x"]) == "A longer sentence."


@pytest.mark.parametrize("key", ["n", "id", "s"])
def test_similar_names_under_any_key(spark, key):
    """Names with the same bigrams are different texts: each keeps its own links."""
    names = ["abab", "baba", "ABAB", "ababx", "zz"]
    df = spark.createDataFrame([(x,) for x in names], f"{key} string")
    grams = {x: {x.lower()[i : i + 2] for i in range(len(x) - 1)} for x in names}
    likeness = {(a, b): len(grams[a] & grams[b]) / len(grams[a] | grams[b]) for a in names for b in names if a < b}
    got = [(r["a"], r["b"], round(r["similarity"], 9)) for r in K.similar_names(df, key, key, 0.5).collect()]
    assert sorted(got) == sorted((*p, round(s, 9)) for p, s in likeness.items() if s >= 0.5)
