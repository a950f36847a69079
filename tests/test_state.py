"""Stateful streams against the batch rules."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from granary.streaming import state as S
from granary.streaming import windows as W


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, S.ROCKSDB)
    yield spark
    spark.conf.set(key, before)


def drained(make, source, schema, folder, files_at_once=1):
    """Run the query over what is there; called again, it goes on from its checkpoint."""
    stream = source.sparkSession.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).json(f"{folder}/in")
    query = make(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check")
    query.trigger(availableNow=True).start().awaitTermination()


def test_cache_as_a_stream(rocks, tmp_path):
    draw, schema, rows = random.Random(1), "key string, ts timestamp, ord long, value string", []
    for i in range(240):
        value = f"v{i}" if draw.random() < 0.3 else None
        rows.append((f"k{draw.randrange(5)}", 1_700_000_000 + 7 * i + draw.randrange(3), i, value))
    every = rocks.createDataFrame(rows, "key string, at long, ord long, value string").select("key", F.timestamp_seconds("at").alias("ts"), "ord", "value")
    for part in range(4):
        every.where((F.col("ord") >= 60 * part) & (F.col("ord") < 60 * part + 60)).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        if part in (1, 3):  # the second run starts from the first one's checkpoint
            drained(lambda s: S.cached_lookups_stream(s, 40), every, schema, tmp_path)
    want = sorted(tuple(r) for r in S.cached_lookups(every, 40).collect())
    got = sorted(tuple(r) for r in rocks.read.parquet(f"{tmp_path}/out").select("key", "ts", "ord", "value").collect())
    key = lambda r: r[:3]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[3] is None for r in got) and any(r[3] for r in got)


@pytest.mark.parametrize("seed", range(30))
def test_split_equals_the_whole(seed):
    draw = random.Random(seed)
    text = "".join(draw.choices(["a", "b<", "<think>", "</think>", "<th", "ink>", "</", "think>", "<", ">"], k=20))
    inside, carry, answer, thought = False, "", "", ""
    while text:
        n = draw.randint(1, 5)
        inside, carry, a, t = S.split_thoughts(inside, carry, text[:n])
        answer, thought, text = answer + a, thought + t, text[n:]
    draw = random.Random(seed)
    whole = "".join(draw.choices(["a", "b<", "<think>", "</think>", "<th", "ink>", "</", "think>", "<", ">"], k=20))
    import re

    assert answer + (carry if not inside else "") == re.sub(r"(?s)<think>.*?(?:</think>|$)", "", whole)
    assert thought + (carry if inside else "") == "".join(re.findall(r"(?s)<think>(.*?)(?:</think>|$)", whole))


def test_thoughts_as_a_stream(rocks, tmp_path):
    """Marks are cut between batches; one message has an end mark, one runs out of time."""
    schema = "key string, ord long, token string, ts timestamp"
    messages = {"a": ["say <thi", "nk>hm", "</thi", "nk> it <think", ">x</th", "ink>!<"], "b": ["no marks <", "thin king", " <thi"], "c": ["<think>open </", "think"]}
    rows = [(k, i, t, 1_700_000_000 + i) for k, tokens in messages.items() for i, t in enumerate(tokens)]
    rows += [("a", 9, None, 1_700_000_009), ("late", 0, "x", 1_700_009_000), ("later", 1, "x", 1_700_019_000)]
    every = rocks.createDataFrame(rows, "key string, ord long, token string, at long")
    every = every.select("key", "ord", "token", F.timestamp_seconds("at").alias("ts"))
    for part in range(10):
        every.where((F.col("ord") == part) & ~F.col("key").startswith("late")).coalesce(1).write.mode("append").option("ignoreNullFields", "false").json(f"{tmp_path}/in")
        if part == 2:
            drained(lambda s: S.thoughts_stream(s, 60), every, schema, tmp_path)
    for name in ("late", "later"):
        every.where(F.col("key") == name).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        drained(lambda s: S.thoughts_stream(s, 60), every, schema, tmp_path)
    got = defaultdict(lambda: ["", ""])
    for r in sorted(rocks.read.parquet(f"{tmp_path}/out").collect(), key=lambda r: (r["ord"] < 0, r["ord"])):
        got[r["key"]][0] += r["answer"]
        got[r["key"]][1] += r["thought"]
    want = W.without_thoughts(every.where("token IS NOT NULL AND NOT startswith(key, 'late')"), "key", "ord", "token")
    assert {k: tuple(v) for k, v in got.items() if not k.startswith("late")} == {r["key"]: (r["answer"], r["thought"]) for r in want.collect()}
