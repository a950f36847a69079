"""Segments of questions: literals, and runs against a plain loop."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from granary.functions import segments as S
from granary.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def words(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")


@pytest.mark.parametrize(
    "tokens,want",
    [
        (["a", "b", "c"], ["a b c"]),
        (["a", "b", "c", "d", "e"], ["a b", "c d e"]),
        (list("abcdefghk"), ["a b", "c d", "e f", "g h k"]),
        (["x", "检索", "word"], ["x 检索", "word"]),
        (["x", "word"], ["x", "word"]),
        (["long", "", "a", "b", "word", "c"], ["long", "a b", "word", "c"]),
        ([], []),
    ],
)
def test_merged_terms(spark, tokens, want):
    assert value(spark, S.merged_terms(words(*tokens))) == want


def plain(tokens):
    short = lambda t: len(t) == 1 or bool(re.fullmatch("[0-9a-z]{1,2}", t))
    out, i = [], 0
    while i < len(tokens):
        if i == 0 and short(tokens[0]) and len(tokens) > 1 and len(tokens[1]) > 1 and not re.match("[0-9A-Za-z]", tokens[1]):
            out.append(f"{tokens[0]} {tokens[1]}")
            i = 2
            continue
        j = i
        while j < len(tokens) and tokens[j] and tokens[j] not in T.STOP_WORDS and short(tokens[j]):
            j += 1
        take = j - i if 1 < j - i < 5 else 2 if j - i >= 5 else 1
        out.append(" ".join(tokens[i : i + take]))
        i += take
    return [t for t in out if t]


def test_random_runs(spark):
    draw = random.Random(1)
    rows = [(i, draw.choices(["a", "b1", "的", "检索", "word", "", "7", "the", "x"], k=draw.randint(0, 14))) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, t array<string>").select("i", S.merged_terms(F.col("t")).alias("m"))
    assert {r["i"]: r["m"] for r in df.collect()} == {i: plain(t) for i, t in rows}


def test_pretokens_and_phrases(spark):
    assert value(spark, S.pretokens(words("the", "?", "12", "word", "检", ""), numbers=False)) == ["word", "检"]
    assert value(spark, S.pretokens(words("the", "12"), stops=False)) == ["the", "12"]
    assert value(spark, S.latin_phrases(F.lit("deep learning 模型 for x 2 y"))) == ["deep learning", "模型", "for x", "2", "y"]
    assert value(spark, S.latin_phrases(F.lit("a of b"), ("of",))) == ["a", "of", "b"]
    assert value(spark, S.latin_phrases(F.lit("  "))) == []


def test_query_string(spark):
    got = value(spark, S.query_string(F.lit("rust 12"), {"rust": ["iron", "oxide"]}))
    assert got == "((rust)^1) OR ((12)^1)".replace("rust", "(rust OR (iron oxide )^0.2)")
    got = value(spark, S.query_string(F.lit("deep learning"), {}))
    assert got == '(("deep learning" OR "deep learning" OR ("deep learning"~2)^0.5)^1)'
    assert value(spark, S.query_string(F.lit(""), {})) == ""
