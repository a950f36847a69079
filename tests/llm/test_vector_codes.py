"""Product codes against plain Python integers."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, slot int"


def plain(rows, parts=16, entries=64, rounds=2):
    """``[(vec_id, code, error, label)]`` and the digest, by definition."""
    kept = [(i, v, label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], None
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = -(-len(kept[0][1]) // parts)
    whole = [[math.floor(Fraction(x) * 256) for x in v] + [0] * (parts * width - len(v)) for _, v, _ in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def away(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min(range(len(b)), key=lambda j: (away(v[p], b[j]), j)) for p, b in enumerate(books)] for v in cut]

    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for j in range(len(books[p])):
                own = [v[p] for v, c in zip(cut, codes, strict=True) if c[p] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    errors = [sum(away(v[p], books[p][c[p]]) for p in range(parts)) for v, c in zip(cut, codes, strict=True)]
    text = ",".join(str(x) for b in books for e in b for x in e)
    rows = [(r[0], "".join(f"{x:02x}" for x in c), e, r[2]) for r, c, e in zip(kept, codes, errors, strict=True)]
    return rows, hashlib.sha256(text.encode()).hexdigest()


def compared(spark, table_folder, rows):
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(5)
    frame.write.parquet(f"{table_folder}/embeddings.parquet")
    got = vector_codes.op12_vector_codes(spark, str(table_folder)).collect()
    stored = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], n) for i, v, n in rows]
    want, digest = plain(stored)
    largest = (1 << 63) - 1
    sums = {}
    for *_, error, label in want:
        sums[label] = sums.get(label, 0) + min(error, largest)
    key = lambda r: (r[0] is None, *map(str, r))
    expect = sorted(((i, c, min(e, largest), min(sums[n], largest), digest) for i, c, e, n in want), key=key)
    assert sorted((tuple(r) for r in got), key=key) == expect
    return got


def drawn(n, length, seed, spread=0.3):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, spread) for _ in range(length)], draw.choice([None, 1, 1, 1, 2])) for i in range(n)]


def test_equals_plain_integers(spark, tmp_path):
    rows = drawn(300, 64, 1)
    rows += [(1000, None, 1), (1001, [], 1), (1002, [None] * 64, 1), (1003, [math.nan] * 64, 2), (1004, [math.inf] + [0.0] * 63, 2)]
    rows += [(None, rows[5][1], None), rows[7], rows[7], (1005, [0.5] * 32, 1)]
    compared(spark, tmp_path, rows)


def test_ties_and_equal_entries(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, [draw.choice([-1.0, 0.0, 1.0]) / 256 for _ in range(32)], 1) for i in range(200)]
    compared(spark, tmp_path, rows)


def test_few_vectors_and_odd_length(spark, tmp_path):
    compared(spark, tmp_path, drawn(5, 19, 4))


@pytest.mark.parametrize("size", [3e4, 9e6, 1e15, 1e36])
def test_large_components(spark, tmp_path, size):
    rows = drawn(90, 16, 5, size)
    rows += [(100 + i, [x * (1 + 1e-6) for x in v], 1) for i, v, _ in rows[:20]]
    compared(spark, tmp_path, rows)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert vector_codes.op12_vector_codes(spark, str(tmp_path)).collect() == []


def test_screening_keeps_the_best():
    """Close entries far from the origin: float32 alone would choose wrongly."""
    draw = np.random.default_rng(6)
    book = draw.integers(-5, 6, (64, 4)) + 2_000_000
    x = draw.integers(-5, 6, (3000, 4)) + 2_000_000
    at, away = vector_codes.nearest(x, book)
    exact = ((x[:, None, :] - book[None]) ** 2).sum(axis=-1)
    assert (at == exact.argmin(axis=1)).all() and (away == exact.min(axis=1)).all()


def test_decoded_vectors_are_near(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    codes, book = vector_codes.compress(table)
    both = vector_codes.decoded(codes, book).join(table, "vec_id")
    square = F.expr("aggregate(zip_with(vector, embedding, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x)")
    own = F.expr("aggregate(embedding, 0D, (s, x) -> s + x * x)")
    found = both.select(F.avg(square).alias("left"), F.avg(own).alias("whole")).first()
    assert found["left"] < 0.5 * found["whole"]
