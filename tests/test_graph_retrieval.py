"""Scores of entities and relations against plain Python."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from granary.operators import graph_retrieval as G
from granary.operators.graphs import undirected


@pytest.mark.parametrize("hops,most", [(1, 64), (2, 64), (2, 5), (3, 20)])
def test_scores(spark, hops, most):
    draw = random.Random(hops * 100 + most)
    edges = [(draw.choice("abcdefgh"), draw.choice("abcdefgh"), float(draw.randint(1, 4))) for _ in range(22)]
    seeds = [("q1", "a", 0.5), ("q1", "c", 0.25), ("q2", "h", 1.0), ("q2", "zz", 1.0)]
    typed, liked = [("q1", "b"), ("q1", "a"), ("q2", "d"), ("q1", "b")], [("q1", *sorted(e[:2]), 0.7) for e in edges[:4] if e[0] != e[1]]
    weight = {}
    for a, b, w in edges:
        if a != b:
            weight[min(a, b), max(a, b)] = max(w, weight.get((min(a, b), max(a, b)), 0))
    near = defaultdict(float)
    for q, node, sim in seeds:
        found, front = [], [((node,), 0.0)]
        for _ in range(hops):
            front = [((*p, n), w + v) for p, w in front for (x, y), v in weight.items() for m, n in ((x, y), (y, x)) if m == p[-1] and n not in p]
            found += front
        for path, _ in sorted(found, key=lambda f: (-f[1], -len(f[0]), f[0]))[:most]:
            for i in range(len(path) - 1):
                near[q, min(path[i : i + 2]), max(path[i : i + 2])] += sim / (2 + i)
    like = {(q, a, b): s for q, a, b, s in liked}
    want = {}
    for key in near.keys() | like.keys():
        q, a, b = key
        ends = ((q, a) in typed) + ((q, b) in typed)
        score = like[key] * (1 + near.get(key, 0) + ends) if key in like else near[key] * (1 + ends)
        want[key] = pytest.approx(score * weight[a, b])
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    e = frame(edges, "src string, dst string, weight double")
    s, t = frame(seeds, "query string, node string, sim double"), frame(typed, "query string, node string")
    r = frame(liked, "query string, src string, dst string, sim double")
    got = {(x["query"], x["src"], x["dst"]): x["score"] for x in G.relation_scores(e, s, t, r, hops, most).collect()}
    assert got == want
    ranks = frame([(n, 0.1 * i) for i, n in enumerate("abcdefgh")], "node string, rank double")
    scores = {(x["query"], x["node"]): x["score"] for x in G.entity_scores(s, t, ranks).collect()}
    assert scores == {("q1", "a"): 0.0, ("q1", "c"): pytest.approx(0.25 * 0.2), ("q2", "h"): pytest.approx(0.7)}


def test_edges_are_grouped_in_all_partitions(spark):
    """Few bytes of many edges are not joined into few tasks, whose hash tables would hold them; each edge comes once."""
    edges = spark.range(4000).selectExpr("id % 50 AS src", "id % 1000 AS dst", "1.0D AS weight")
    links = undirected(edges)
    assert links.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    want = {(a, b) for i in range(1000) for a, b in ((i % 50, i), (i, i % 50)) if a != b}
    got = [(r["src"], r["dst"]) for r in links.collect()]
    assert len(got) == len(want) and set(got) == want
