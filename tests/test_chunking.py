"""Chunkers against plain Python."""

from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from granary.operators import chunking as C


def count(text: str) -> int:
    cjk = re.findall(r"[㐀-䶿一-鿿豈-﫿぀-ヿ가-힯]", text)
    rest = [c for c in text if not c.isspace() and not re.match(r"[!-/:-@\[-`{-~]", c) and c not in set(cjk)]
    total = math.ceil(len(cjk) / 1.5) + math.ceil(len(rest) / 4)
    return total if total or not text.strip() else 1


def plain_naive(text: str, budget: int, delimiter: str, overlap: float) -> list[str]:
    parts = [p.strip() for p in re.split("|".join(re.escape(d) for d in C.delimiters_of(delimiter)), text)]
    done, now, again = [], "", int(budget * overlap)
    for part in filter(None, parts):
        n = count(now)
        if now and n + count(part) > budget:
            done.append(now)
            tail = ""
            if again and n > again:
                for line in reversed(now.split("\n")):
                    if count(tail) >= again:
                        break
                    tail = f"{line}\n{tail}" if tail else line
            now = tail
        now = f"{now}{delimiter}{part}" if now else part
    return [*done, now] if now.strip() else done


TEXTS = ["", "   \n ", "one", "中文。字" * 30, "a\n" * 50, "no delimiters here at all " * 40, "!?;;\n\n"]
for seed in range(6):
    draw = random.Random(seed)
    TEXTS.append("".join(draw.choice(["word", " ", "\n", "x. ", "!", "long" * 9, "字"]) for _ in range(300)))


@pytest.mark.parametrize(("delimiter", "overlap"), [("\n", 0.0), ("\n!?", 0.05), ("`wo`\n", 0.9), (C.DEFAULT_DELIMITER, 0.3)])
def test_naive(spark, delimiter, overlap):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r["i"]: r["c"] for r in rows.select("i", C.naive(F.col("t"), 12, delimiter, overlap).alias("c")).collect()}
    assert got == {i: plain_naive(t, 12, delimiter, overlap) for i, t in enumerate(TEXTS)}


def test_delimiter_field():
    assert C.delimiters_of("`##`a`b``##`\r\n") == ["##", "a", "b", "\n"]


def test_children_positions_and_packing(spark):
    row = spark.range(1).select(
        C.with_children(F.array(F.lit("a. b."), F.lit("c")), [".", " "]).alias("kids"),
        C.positions(F.lit("x@@2-3\t1.5\t2\t3\t4##y@@z##")).alias("at"),
        C.without_positions(F.lit(" x@@2-3\t1.5\t2\t3\t4##y ")).alias("plain"),
        C.packed(F.array(*[F.lit(n) for n in (5, 5, 1, 20, 3)]), 10).alias("batches"),
        C.root_as_heading(F.array(F.lit("R"), F.lit("a"), F.lit("b"))).alias("root"),
        C.by_title(F.lit("intro\n# A\nx\n## B\ny\n# C"), ["^# ", "^## "]).alias("title"),
        C.by_delimiters(F.lit(" a,b.. c"), [".", ","]).alias("cut"),
    ).first()
    assert [(k["content"], k["mom"]) for k in row["kids"]] == [("a.", "a. b."), (" b.", "a. b."), ("c", None)]
    assert [tuple(p) for p in row["at"]] == [(2, 1, 2, 3, 4), (3, 1, 2, 3, 4)]
    assert row["plain"] == "xy"
    assert row["batches"] == [0, 0, 1, 2, 3]
    assert row["root"] == ["R\na", "R\nb"]
    assert row["title"] == ["# A\nintro\nx\n## B\ny", "# C\n"]
    assert row["cut"] == [" a,", "b.", ".", " c"]


def test_very_long_text(spark):
    text = "word " * 40_000
    row = spark.createDataFrame([(text.replace("word word", "word.\nword"),)], "t string").select(F.size(C.naive(F.col("t"), 64)).alias("n")).first()
    assert row["n"] > 500


def test_counted_children(spark):
    """Each child once with its number; a chunk in one part stands for itself."""
    rows = spark.createDataFrame([(0, "b.a.b."), (1, "c"), (2, "d."), (3, ". . "), (4, "x. y. y. ")], "i int, t string")
    found = rows.select("i", F.explode(C.counted_children(F.col("t"), ["."])).alias("k")).select("i", "k.*")
    got = sorted((r["i"], r["content"], r["mom"], r["n"]) for r in found.collect())
    plain = rows.select("i", F.explode(C.with_children(F.array("t"), ["."])).alias("k")).select("i", "k.*").groupBy("i", "content", "mom").count()
    assert got == sorted(tuple(r) for r in plain.collect())
    assert (0, "b.", "b.a.b.", 2) in got
