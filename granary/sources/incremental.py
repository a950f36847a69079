"""Incremental reading of a folder through Spark's own file systems.

``stream`` is Structured Streaming over new files: offsets in the checkpoint, a byte budget a batch. ``FolderSync`` also
sees changed and deleted files: a listing (names, sizes and times; no contents are read) is compared with the table of
known fingerprints, what is new or changed is cut into batches of a byte budget, and each batch is handed over with its
contents and then committed. A run that fails or is killed goes on with the first batch that isn't committed; a file
whose fingerprint is known is never read again. Listings and fingerprints stay tables; only one batch's paths, which its
budgets bound, reach the driver. Spark's scans skip empty files: they hold no document and are never listed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.sources.staging import file_system, release, remove, staged

BATCH_BYTES, BATCH_FILES = 256 << 20, 10_000
FILES = "path string, modificationTime timestamp, length long, content binary"
KNOWN = "id string, size long, fingerprint string, batch long, present boolean"


def stream(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES, pattern: str = "*") -> DataFrame:
    """New files below ``path`` as a stream of ``path, modificationTime, length, content``."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return reader.option("maxBytesPerTrigger", batch_bytes).load(path)


def qualified(spark: SparkSession, path: str) -> str:
    files, place = file_system(spark, path)
    return files.makeQualified(place).toString().rstrip("/")


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``id`` (path below the folder), ``path, size, fingerprint`` of each file; names that begin with . or _ are hidden."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    root = qualified(spark, path)
    time = F.unix_micros("modificationTime").cast("string")
    token = F.left(F.sha2(F.concat_ws(":", F.col("length").cast("string"), time), 256), F.lit(16))
    return files.select(F.substring("path", len(root) + 2, 1 << 30).alias("id"), "path", F.col("length").alias("size"), token.alias("fingerprint"))


def in_batches(files: DataFrame, batch_bytes: int, batch_files: int) -> DataFrame:
    """Adds ``_batch`` by a running sum over ranges of ``id``: no batch starts a file beyond either budget."""
    weight = F.greatest(F.col("size"), F.lit(-(-batch_bytes // batch_files)).cast("long"))
    dealt = files.withColumn("_w", weight).repartitionByRange("id").withColumn("_part", F.spark_partition_id())
    dealt = staged(dealt, "files-dealt")
    before, offsets = 0, []
    for r in sorted(dealt.groupBy("_part").agg(F.sum("_w").alias("n")).collect()):  # one row a partition
        offsets.append((r["_part"], before))
        before += r["n"]
    bases = files.sparkSession.createDataFrame(offsets, "_part int, _base long")
    inside = Window.partitionBy("_part").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("_base") + F.coalesce(F.sum("_w").over(inside), F.lit(0))
    return dealt.join(F.broadcast(bases), "_part").withColumn("_batch", F.floor(upto / batch_bytes)).drop("_part", "_w", "_base")


class FolderSync:
    """What a folder held when it was last read, as versions of a table below ``state``."""

    def __init__(self, spark: SparkSession, path: str, state: str, batch_bytes: int = BATCH_BYTES, batch_files: int = BATCH_FILES, pattern: str = "*"):
        self.spark, self.path, self.state, self.pattern = spark, path, state.rstrip("/"), pattern
        self.batch_bytes, self.batch_files = batch_bytes, batch_files

    def commits(self) -> list[int]:
        files, place = file_system(self.spark, self.state)
        if not files.exists(place):
            return []
        names = [s.getPath().getName() for s in files.listStatus(place)]
        done = [n for n in names if n.startswith("commit=") and files.exists(file_system(self.spark, f"{self.state}/{n}/_SUCCESS")[1])]
        return sorted(int(n.removeprefix("commit=")) for n in done)

    def known(self) -> DataFrame:
        """``id, size, fingerprint`` of the files that were there at the last commit."""
        done = self.commits()
        if not done:
            return self.spark.createDataFrame([], "id string, size long, fingerprint string")
        rows = self.spark.read.schema(KNOWN).parquet(*[f"{self.state}/commit={n}" for n in done])
        last = rows.groupBy("id").agg(F.max_by(F.struct("size", "fingerprint", "present"), "batch").alias("r"))
        return last.where("r.present").select("id", "r.size", "r.fingerprint")

    def changes(self) -> DataFrame:
        """``id, path, size, fingerprint, change`` (added, updated, deleted)."""
        here = listing(self.spark, self.path, self.pattern).alias("h")
        known = self.known().alias("k")
        both = here.join(known, F.col("h.id") == F.col("k.id"), "full_outer")
        change = F.when(F.col("k.id").isNull(), "added").when(F.col("h.id").isNull(), "deleted")
        change = change.when(F.col("h.fingerprint") != F.col("k.fingerprint"), "updated")
        rows = both.withColumn("change", change).where("change IS NOT NULL")
        return rows.select(F.coalesce("h.id", "k.id").alias("id"), "h.path", F.coalesce("h.size", "k.size").alias("size"), "h.fingerprint", "change")

    def compact(self) -> None:
        """One table instead of many commits: written as the next commit before the old ones go."""
        done = self.commits()
        if len(done) > 1:
            rows = self.known().select("*", F.lit(done[-1] + 1).cast("long").alias("batch"), F.lit(True).alias("present"))
            rows.write.mode("overwrite").parquet(f"{self.state}/commit={done[-1] + 1}")
            for n in done:
                remove(self.spark, f"{self.state}/commit={n}")

    def run(self, handle: Callable[[DataFrame, int], None], delete: bool = True) -> dict[str, int]:
        """Hand every batch (``id, size, fingerprint, change, content``) to ``handle`` with its number, and commit it.

        A batch whose handler failed comes again, with the same number, in the next run. Counts of changes are returned.
        """
        found = self.changes()
        found = found if delete else found.where("change <> 'deleted'")
        rows = in_batches(staged(found, "files-changed"), self.batch_bytes, self.batch_files)
        rows = staged(rows, "files-batches")
        number = (self.commits() or [-1])[-1] + 1
        for r in rows.select("_batch").distinct().orderBy("_batch").toLocalIterator():
            batch = rows.where(F.col("_batch") == r["_batch"]).drop("_batch")
            paths = [p["path"] for p in batch.where("path IS NOT NULL").select("path").collect()]  # at most batch_files
            content = self._contents(paths)
            handle(batch.join(content, "path", "left").drop("path"), number)
            done = batch.select("id", "size", "fingerprint", F.lit(number).cast("long").alias("batch"), (F.col("change") != "deleted").alias("present"))
            done.write.mode("overwrite").parquet(f"{self.state}/commit={number}")
            number += 1
        counts = {r["change"]: r["n"] for r in rows.groupBy("change").agg(F.count("*").alias("n")).collect()}
        release(rows)
        return counts

    def _contents(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], "path string, content binary")
        return self.spark.read.format("binaryFile").load(paths).select("path", "content")
