"""Counting of tokens: prefixes, and the time of long texts."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import chunking as C

from .test_chunking import count

TEXTS = ["", "   ", "one", "...   ", "ж" * 90, "中文。字 " * 30, "word, " * 200, "é ü" * 50, "x" * 3000 + "中" * 9, "中" * 700, "a\x7fb\x85cd " * 40]
for seed in range(8):
    draw = random.Random(seed)
    TEXTS.append("".join(draw.choice(["word", " ", "\n", ". ", "字", "é", "🙂", "\t"]) for _ in range(400)))


def test_counts(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(-1, None)], "i int, t string")
    got = {r["i"]: r["n"] for r in rows.select("i", T.token_count(F.col("t")).alias("n")).collect()}
    assert got == {-1: None, **{i: count(t) for i, t in enumerate(TEXTS)}}


@pytest.mark.parametrize("budget", [1, 7, 100])
def test_longest_prefix(spark, budget):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r["i"]: r["c"] for r in rows.select("i", T.truncated(F.col("t"), budget).alias("c")).collect()}
    assert got == {i: t[: max(n for n in range(len(t) + 1) if n == 0 or count(t[:n]) <= budget)] for i, t in enumerate(TEXTS)}


def seconds(df) -> float:
    began = time.monotonic()
    assert df.collect()
    return time.monotonic() - began


def test_long_texts_are_not_counted_again_and_again(spark):
    """A prefix of a text of four million characters, and 6,000 parts that stay below the least size of a chunk."""
    text = F.repeat(F.lit("word, and "), 400_000)
    assert seconds(spark.range(1).select(F.length(T.truncated(F.concat(text, F.col("id").cast("string")), 100)))) < 5
    parts = F.transform(F.sequence(F.lit(1), F.lit(6000)), lambda i: F.concat(F.lit("part"), i.cast("string")))
    assert seconds(spark.range(1).select(F.size(C.merged_small(parts, 1_000_000)))) < 5
