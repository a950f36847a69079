"""Structured Streaming queries against the batch rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from granary.streaming import sync as S
from granary.streaming import windows as W

FEED = "batch int, ord int, id string, fingerprint string, doc_updated_at string"


def test_rules_of_a_sync(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "2"), ("gone", "3")], "id string, fingerprint string")
    feed = spark.createDataFrame(
        [(0, 0, "a", "1", "t1"), (0, 1, "b", "9", "t3"), (0, 2, "c", None, "t2"), (1, 0, "c", "5", "t4"), (1, 1, "d", "6", "t0")], FEED
    )
    got = {(r["id"], r["batch"]): r["change"] for r in S.classified(S.changed_only(feed, known), known).collect()}
    assert got == {("b", 0): "updated", ("c", 0): "added", ("c", 1): "updated", ("d", 1): "added"}
    assert S.summary(feed, known, "t2", feed).first().asDict() == {
        "added": 2, "updated": 2, "skipped": 1, "deleted": 1, "total": 5, "next_start": "t4",
    }
    assert S.summary(feed, known, "t2", feed, reindex=True).first()["deleted"] == 0
    assert S.summary(feed.where("false"), known, "t2").first()["next_start"] == "t2"


def test_sync_as_a_stream(spark, tmp_path):
    source, state = str(tmp_path / "feed"), S.SyncState(spark, str(tmp_path / "state"))
    parts = [[(0, 0, "a", "1", "t1"), (0, 1, "b", "1", "t1")], [(1, 0, "a", "1", "t2"), (1, 1, "b", "2", "t2"), (1, 2, "c", None, "t2")]]
    for part in parts:
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").json(source)
        feed = spark.readStream.schema(FEED).json(source)
        S.start_sync(feed, state, str(tmp_path / "check")).awaitTermination()
    assert sorted((r["id"], r["fingerprint"]) for r in state.version(1).collect()) == [("a", "1"), ("b", "2"), ("c", None)]
    last = spark.read.parquet(str(tmp_path / "state" / "summary=1")).first()
    assert (last["added"], last["updated"], last["skipped"]) == (1, 1, 1)


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "sessions"])
def test_windows_of_a_stream(spark, tmp_path, kind):
    rows = [(i, f"2024-01-01 00:{m:02d}:00", i % 2, float(i)) for i, m in enumerate([0, 1, 4, 11, 12, 25, 26, 59])]
    events = spark.createDataFrame(rows, "i int, at string, u int, v double").withColumn("ts", F.col("at").cast("timestamp"))
    events.coalesce(1).write.json(str(tmp_path / "events"))
    late = spark.createDataFrame([(99, "2024-01-01 03:00:00", 0, 0.0)], "i int, at string, u int, v double").withColumn("ts", F.col("at").cast("timestamp"))
    late.coalesce(1).write.mode("append").json(str(tmp_path / "events"))
    make = {
        "tumbling": lambda e: W.tumbling(e, "ts", "10 minutes", ["u"], "v", "1 minute"),
        "sliding": lambda e: W.sliding(e, "ts", "10 minutes", "5 minutes", ["u"], "v", "1 minute"),
        "sessions": lambda e: W.sessions(e, "ts", "5 minutes", ["u"], "v", "1 minute"),
    }[kind]
    want = {tuple(r) for r in make(events).collect()}
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "events"))
    query = (
        make(stream).writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("start", "end", "u", "n", "total").collect()}
    assert want - got == set() and len(got - want) == 0


def test_budget_and_thoughts(spark):
    files = spark.createDataFrame([("k", i, s) for i, s in enumerate([5, 5, 20, 1])], "g string, o int, size long")
    assert [r["state"] for r in S.within_budget(files, "g", "o", "size", 12, 9).orderBy("o").collect()] == ["taken", "taken", "failed", "left"]
    assert [r["state"] for r in S.within_budget(files, "g", "o", "size", 99, 2).orderBy("o").collect()] == ["taken", "taken", "left", "left"]
    tokens = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a<th", "ink>b", "c</thi", "nk>d<think>e"])], "k int, o int, t string")
    assert tuple(W.without_thoughts(tokens, "k", "o", "t").first()) == (1, "ad", "bce")
