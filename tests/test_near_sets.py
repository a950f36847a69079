"""Near sets by slices of their hashes, against all pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from granary.operators import merging as G

SHARE = 0.8


def corpus() -> dict[int, list[str]]:
    """Lone sets, copies, sets that share a common part, and pairs just above, at and below the share."""
    draw = random.Random(3)
    common = [f"c{i}" for i in range(12)]
    sets = {i: [f"w{i}-{j}" for j in range(draw.randint(1, 60))] + (common if i % 3 == 0 else []) for i in range(60)}
    for i in range(60, 160):
        base = sets[draw.randrange(i)]
        cut = draw.choice((0, 1, len(base) // 10, len(base) // 9, len(base) // 5, len(base) // 4))
        sets[i] = base[cut:] + [f"n{i}-{j}" for j in range(draw.choice((0, 0, cut)))] or ["x"]
    sets[160], sets[161] = [f"e{i}" for i in range(4)], [f"e{i}" for i in range(5)]  # 4 of 5: just the share
    return sets


def test_pairs_are_those_of_all_comparisons(spark):
    sets = corpus()
    classes: dict[frozenset, int] = {}
    for i, s in sets.items():
        classes.setdefault(frozenset(s), i)
    want = {}
    for s, i in classes.items():
        for t, j in classes.items():
            if i < j and len(s & t) >= SHARE * len(s | t):
                want[i, j] = round(len(s & t) / len(s | t), 9)
    rows, copies = G.hashed_sets(spark.createDataFrame(list(sets.items()), "k long, g array<string>"), "k", "g")
    found = G.near_set_pairs(rows, copies, "k", SHARE).collect()
    assert {(r["a"], r["b"]): round(r["similarity"], 9) for r in found} == want
    assert len(found) == len(want) > 20
    assert {(r["k"], r["id"]) for r in copies.collect()} == {(i, classes[frozenset(s)]) for i, s in sets.items() if classes[frozenset(s)] != i}


def test_lone_sets_are_never_shuffled_whole(spark):
    docs = spark.range(400).toDF("k").select("k", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat_ws("-", F.col("k") % 398, i)).alias("g"))
    docs = docs.select("k", F.when(F.col("k") >= 398, F.slice("g", 1, 190)).otherwise(F.col("g")).alias("g"))
    rows, copies = G.hashed_sets(docs, "k", "g")
    left = {r["id"] for r in G.sets_that_may_pair(rows, copies, "k", SHARE).collect()}
    assert left == {0, 1, 398, 399}
    assert {(r["a"], r["b"]) for r in G.near_set_pairs(rows, copies, "k", SHARE).collect()} == {(0, 398), (1, 399)}
