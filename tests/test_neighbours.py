"""Nearest neighbours, near pairs and near groups against numpy over all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from granary.operators import neighbours as N

SCHEMA = "id long, v array<float>, cell int, block int, keys string"


def clustered(seed, groups=40, each=25, length=32, spread=0.25):
    draw = np.random.default_rng(seed)
    centre = draw.standard_normal((groups, length))
    return (np.repeat(centre, each, axis=0) + spread * draw.standard_normal((groups * each, length))).astype(np.float32)


def frame(spark, matrix, odd=()):
    rows = [(i, v, 0, 1, "x") for i, v in enumerate(matrix.tolist())]
    rows += [(10_000 + i, v, 0, 1, "x") for i, v in enumerate(odd)]
    return spark.createDataFrame(rows, SCHEMA).repartition(6)


ODD = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0] * 7]


def truth(matrix):
    unit = matrix.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    return unit @ unit.T


@pytest.mark.parametrize("block", [2048, 60])
def test_search(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    matrix = clustered(1)
    matrix[100:300] = matrix[100]  # a third of a block and more: equal vectors, ties by key
    table = frame(spark, matrix, ODD)
    index = N.CellIndex.build(table, "id", "v", str(tmp_path / "index"))
    index = N.CellIndex(spark, str(tmp_path / "index"))
    queries = table.where("id % 50 = 0")
    score = np.round(truth(matrix), 9)
    want = {q: sorted(((-s, i) for i, s in enumerate(score[q].tolist())))[:10] for q in range(0, len(matrix), 50)}
    exact = {}
    for r in index.search_exact(queries, "id", "v", 10, 2).orderBy("query", "rank").collect():
        exact.setdefault(r["query"], []).append((-r["score"], r["key"]))
    assert set(exact) == set(want)
    assert all([k for _, k in exact[q]] == [k for _, k in want[q]] for q in want)
    probes = index.probes_for(queries, "id", "v", 10, 0.95)
    assert 1 <= probes < len(index.cells.blocks)
    near = index.search(queries, "id", "v", 10, probes).collect()
    hits = sum(r["key"] in {k for _, k in want[r["query"]]} for r in near)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_search_of_few(spark, tmp_path):
    index = N.CellIndex.build(frame(spark, clustered(2, 1, 3)), "id", "v", str(tmp_path / "few"))
    found = index.search_exact(frame(spark, clustered(2, 1, 3)), "id", "v", 10).collect()
    assert len(found) == 9


@pytest.mark.parametrize("least,block", [(0.9, 2048), (0.5, 50), (0.05, 300)])
def test_near_pairs(spark, monkeypatch, least, block):
    monkeypatch.setattr(N, "BLOCK", block)
    matrix = clustered(3, 20, 12)
    score = truth(matrix)
    want = {(i, j) for i in range(len(matrix)) for j in range(i + 1, len(matrix)) if score[i, j] >= least}
    found = N.near_pairs(frame(spark, matrix, ODD), "id", "v", least).collect()
    assert len(found) == len(want) and {(r["a"], r["b"]) for r in found} == want
    assert all(abs(r["similarity"] - score[r["a"], r["b"]]) < 1e-9 for r in found)


def test_blocks_travel_to_groups(spark, monkeypatch):
    """However many blocks meet, a block is copied ``GROUPS`` times at most, and each two blocks meet in one place."""
    monkeypatch.setattr(N, "BLOCK", 2)
    vectors = frame(spark, clustered(9, 1, 600, spread=3.0))
    rows, cells = N.placed(vectors, "id", "v", N.trained(vectors, "id", "v", 60))
    meets = np.ones((len(cells.blocks),) * 2, bool)
    group = N.groups_of(cells, np.arange(len(cells.blocks)))
    dealt = N.dealt_blocks(rows, "id", cells, meets, group).collect()
    blocks = {r["block"] for r in dealt}
    assert len(blocks) > 4 * N.GROUPS and len(dealt) <= N.GROUPS * len(blocks)
    at = {b: {(r["low"], r["high"]) for r in dealt if r["block"] == b} for b in sorted(blocks)[::7]}
    assert all(at[a] & at[b] for a in at for b in at)


def test_few_pairs_are_compared_in_full():
    """Unlike vectors of 64 dimensions at a threshold that few pairs reach: the bound leaves under a tenth of them."""
    draw = np.random.default_rng(4)
    unit = draw.standard_normal((2000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    _, directions = np.linalg.eigh(unit.T @ unit)
    i, j = N.surviving(unit[:1000], unit[1000:], directions[:, ::-1].copy(), 48, 0.4)
    assert len(i) < 0.1 * 1000 * 1000
    want = np.argwhere(unit[:1000] @ unit[1000:].T >= 0.4)
    assert set(map(tuple, want.tolist())) <= set(zip(i.tolist(), j.tolist(), strict=True))


@pytest.mark.parametrize("block", [2048, 40])
def test_near_groups(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK", block)
    matrix = np.concatenate((clustered(5, 60, 6, spread=0.12), clustered(6, 1, 150, spread=0.1), clustered(7, 200, 1)))
    matrix[40:90] = matrix[40]
    score, least = truth(matrix), 0.93
    found = {r["id"]: r for r in N.near_groups(frame(spark, matrix, ODD), "id", "v", least).collect()}
    assert set(found) == {*range(len(matrix)), *range(10_000, 10_000 + len(ODD))}
    head = {i: int(np.flatnonzero((matrix == matrix[i]).all(axis=1))[0]) for i in range(len(matrix))}
    heads = sorted(set(head.values()))
    links = [(i, j) for i in heads for j in heads if i < j and score[i, j] >= least]
    assert sum(found[i]["links"] for i in heads) >= 2 * 0.95 * len(links)
    root = {i: i for i in heads}
    for i, j in links:
        a, b = sorted((root[i], root[j]))
        root = {k: a if r == b else r for k, r in root.items()}
    same = sum(found[i]["class_id"] == root[head[i]] for i in head)
    assert same >= 0.95 * len(head)


def test_low_thresholds_are_refused():
    with pytest.raises(ValueError, match="bands"):
        N.bands_for(0.3)


def test_empty(spark):
    empty = frame(spark, clustered(1, 1, 1)).where("false")
    assert N.near_pairs(empty, "id", "v", 0.9).collect() == []
    assert N.near_groups(empty, "id", "v", 0.9).collect() == []
