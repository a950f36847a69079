"""Incremental reading, versions and the mirror."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from granary.operators import mirror as M
from granary.sources.incremental import FolderSync, listing, stream
from granary.sources.versions import Conflict, VersionedTables


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


class Taker:
    """Keeps what a sync hands over; fails once where told to."""

    def __init__(self, fail_at=None):
        self.batches, self.fail_at = [], fail_at

    def __call__(self, df, number):
        rows = {r["id"]: (r["change"], r["content"] and bytes(r["content"]).decode()) for r in df.collect()}
        if self.fail_at == len(self.batches):
            raise RuntimeError("lost")
        self.batches.append((number, rows))

    @property
    def all(self):
        return {k: v for _, rows in self.batches for k, v in rows.items()}


def test_folder_sync(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    for i in range(9):
        put(folder, f"deep {i % 2}/f{i}.txt", f"text {i}" * (i + 1))
    put(folder, ".hidden", "no")
    sync = lambda: FolderSync(spark, str(folder), state, batch_bytes=100)
    first = Taker(fail_at=2)
    with pytest.raises(RuntimeError):
        sync().run(first)
    assert 0 < len(first.all) < 9
    rest = Taker()
    assert sync().run(rest) == {"added": 9 - len(first.all)}
    assert not first.all.keys() & rest.all.keys()  # what was committed isn't read again
    both = first.all | rest.all
    assert both == {f"deep {i % 2}/f{i}.txt": ("added", f"text {i}" * (i + 1)) for i in range(9)}
    assert [n for n, _ in first.batches + rest.batches] == list(range(len(first.batches) + len(rest.batches)))
    none = Taker()
    assert sync().run(none) == {} and none.batches == []
    put(folder, "deep 0/f0.txt", "changed and longer")
    put(folder, "new.txt", "n")
    put(folder, "empty.txt", "")
    (folder / "deep 1/f3.txt").unlink()
    sync().compact()
    last = Taker()
    assert sync().run(last) == {"updated": 1, "added": 1, "deleted": 1}
    assert last.all == {"deep 0/f0.txt": ("updated", "changed and longer"), "new.txt": ("added", "n"), "deep 1/f3.txt": ("deleted", None)}
    assert sync().known().count() == 9


def test_budgets_of_batches(spark, tmp_path):
    for i in range(20):
        put(tmp_path / "in", f"f{i:02d}", "x" * (10 * (1 + i % 4)))
    taker = Taker()
    FolderSync(spark, str(tmp_path / "in"), str(tmp_path / "s"), batch_bytes=60, batch_files=4).run(taker)
    assert len(taker.all) == 20 and all(len(rows) <= 5 for _, rows in taker.batches)
    assert listing(spark, str(tmp_path / "in"), "f0*").count() == 10


def test_stream_of_new_files(spark, tmp_path):
    """Runs with what is there; a restart reads only what came since."""
    def run():
        rows = stream(spark, str(tmp_path / "in"), 20).select("path", F.col("content").cast("string").alias("t"))
        query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(r["t"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    for i in range(3):
        put(tmp_path / "in", f"f{i}", f"text {i}")
    assert run() == ["text 0", "text 1", "text 2"]
    put(tmp_path / "in", "f9", "text 9")
    assert run() == ["text 0", "text 1", "text 2", "text 9"]


def test_versions(spark, tmp_path):
    tables = VersionedTables(spark, str(tmp_path / "v"))
    assert tables.current() == 0 and tables.read("a") is None
    tables.write({"a": spark.range(3), "b": spark.range(1)})
    tables.write({"a": spark.range(5)})
    assert (tables.read("a").count(), tables.read("b").count(), tables.read("a", 1).count()) == (5, 1, 3)

    def refuse(_, written):
        assert written["a"].count() == 9
        raise ValueError("no")

    with pytest.raises(ValueError, match="no"):
        tables.write({"a": spark.range(9)}, check=refuse)
    broken = spark.range(4).select(F.raise_error(F.lit("broken")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        tables.write({"b": spark.range(7), "a": broken})
    assert tables.current() == 2 and tables.read("a").count() == 5 and tables.read("b").count() == 1
    assert len(list((tmp_path / "v" / "tables").iterdir())) == 3  # nothing of the failed ones is left
    with pytest.raises(Conflict):
        tables._commit(2, {})
    assert tables.roll_back(1) == 3 and tables.read("a").count() == 3
    tables.expire(1)
    assert tables.versions() == [3] and tables.read("a").count() == 3 and len(list((tmp_path / "v" / "tables").iterdir())) == 2


def extract(chunks):
    return chunks.select("chunk_id", F.explode(F.array_distinct(F.split("text", " "))).alias("entity")).where("entity <> ''")


def build_entities(mentions):
    return mentions.groupBy("entity").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first"))


def build_pages(rows):
    return rows.groupBy("page").agg(F.sum("n").alias("n"), F.count("*").alias("entities"))


def state_of(mirror):
    return {n: sorted(tuple(r[c] for c in sorted(r.asDict())) for r in mirror.tables.read(n).collect()) for n in ("chunks", "mentions", "entities", "pages", "links")}


def test_mirror_equals_a_whole_build(spark, tmp_path):
    draw, words = random.Random(1), [f"e{i}" for i in range(25)]
    texts = {i: " ".join(draw.choices(words, k=3)) for i in range(30)}
    links = {(f"p{i % 7}", w) for i, w in enumerate(words)}
    chunks_of = lambda: spark.createDataFrame([(i, str(hash(t)), t) for i, t in texts.items()], "chunk_id long, hash string, text string")
    links_of = lambda: spark.createDataFrame(sorted(links), "page string, entity string")
    mirror = M.Mirror(VersionedTables(spark, str(tmp_path / "m")), extract, build_entities, build_pages)
    assert mirror.sync(chunks_of(), links_of())["added"] == 30
    assert mirror.sync(chunks_of(), links_of()) == {"entities": 0, "pages": 0}
    assert mirror.tables.current() == 1
    old = state_of(mirror)
    before = {i: set(t.split()) for i, t in texts.items()}
    for i in (3, 4):
        texts[i] = " ".join(draw.choices(words, k=2))
    texts[99] = "e0 newcomer"
    del texts[7]
    links ^= {("p0", "e0"), ("p9", "newcomer")}
    touched = {"e0", "newcomer"} | before[7] | before[3] | before[4] | set(texts[3].split()) | set(texts[4].split())

    def fail(*_):
        raise RuntimeError("midway")

    with pytest.raises(RuntimeError, match="midway"):
        mirror.sync(chunks_of(), links_of(), check=fail)
    assert state_of(mirror) == old and mirror.tables.current() == 1
    counts = mirror.sync(chunks_of(), links_of())
    assert (counts["added"], counts["updated"], counts["deleted"], counts["entities"]) == (1, 2, 1, len(touched))
    whole = M.Mirror(VersionedTables(spark, str(tmp_path / "w")), extract, build_entities, build_pages)
    whole.sync(chunks_of(), links_of())
    assert state_of(mirror) == state_of(whole)
    mirror.tables.roll_back(1)
    assert state_of(mirror) == old
