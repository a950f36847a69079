"""Incremental synchronisation of documents from a feed.

A feed row has ``batch, ord, id, fingerprint, doc_updated_at``; the known state has ``id, fingerprint``. The rules are
plain DataFrame functions, so a batch job and a stream's ``foreachBatch`` share them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.sources.staging import staged


def version_token(fingerprint: Column, size: Column, updated_at: Column) -> Column:
    """A fingerprint, else size and time of change, else null: then a file is always fetched."""
    own = F.when(F.coalesce(fingerprint, F.lit("")) != "", F.concat(F.lit("fp:"), fingerprint))
    changed = F.coalesce(updated_at, F.lit(""))
    return F.coalesce(own, F.when(changed != "", F.concat(F.lit("v:"), F.coalesce(size, F.lit(0)).cast("string"), F.lit(":"), changed)))


def changed_only(feed: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose fingerprint is not the stored one; a null fingerprint is always taken."""
    stored = known.select("id", F.col("fingerprint").alias("_stored"))
    return feed.join(stored, "id", "left").where(~F.coalesce(F.col("fingerprint") == F.col("_stored"), F.lit(False))).drop("_stored")


def classified(feed: DataFrame, known: DataFrame) -> DataFrame:
    """Adds ``change``: ``added`` for the first sight of an unknown id, ``updated`` for every other row."""
    seen = F.row_number().over(Window.partitionBy("id").orderBy("batch", "ord"))
    here = known.select("id").distinct().withColumn("_known", F.lit(True))
    rows = feed.withColumn("_nth", seen).join(here, "id", "left")
    change = F.when(F.col("_known").isNull() & (F.col("_nth") == 1), "added").otherwise("updated")
    return rows.withColumn("change", change).drop("_nth", "_known")


def summary(feed: DataFrame, known: DataFrame, start: str | None = None, snapshot: DataFrame | None = None, reindex: bool = False) -> DataFrame:
    """One row: ``added, updated, skipped, deleted, total, next_start``.

    Documents are stale only on an incremental run with a ``snapshot`` of all remote ids; ``next_start`` is the latest
    change taken, never before ``start``.
    """
    taken = classified(changed_only(feed, known), known)
    counts = taken.agg(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "updated").alias("updated"),
        F.greatest(F.max("doc_updated_at"), F.lit(start)).alias("next_start"),
    )
    everything = feed.agg(F.count("*").alias("n"))
    gone = F.lit(0).cast("long")
    out = counts.crossJoin(F.broadcast(everything))
    if snapshot is not None and start is not None and not reindex:
        every = known.select("id").unionByName(taken.select("id")).distinct()
        stale = every.join(snapshot.select("id").distinct(), "id", "left_anti").agg(F.count("*").alias("gone"))
        out, gone = out.crossJoin(F.broadcast(stale)), F.col("gone")
    return out.select(
        "added", "updated", (F.col("n") - F.col("added") - F.col("updated")).alias("skipped"), gone.alias("deleted"),
        (F.col("added") + F.col("updated") + gone).alias("total"), F.coalesce("next_start", F.lit(start)).alias("next_start"),
    )


def within_budget(files: DataFrame, group: str, ord_: str, size: str, most_bytes: int, most_items: int) -> DataFrame:
    """Adds ``state``: ``taken`` while a group's files in order fit its bytes, ``failed`` for the one that would not, else ``left``."""
    w = Window.partitionBy(group).orderBy(ord_)
    upto = F.sum(size).over(w)
    nth = F.row_number().over(w)
    first_over = F.min(F.when(F.col("_upto") > most_bytes, F.col("_nth"))).over(Window.partitionBy(group))
    rows = files.withColumn("_upto", upto).withColumn("_nth", nth).withColumn("_over", first_over)
    over = F.coalesce(F.col("_over"), F.lit(most_items + 1))
    state = F.when(F.col("_nth") > most_items, "left").when(F.col("_nth") < over, "taken").when(F.col("_nth") == over, "failed").otherwise("left")
    return rows.withColumn("state", state).drop("_upto", "_nth", "_over")


def with_tombstones(rows: DataFrame, markers: DataFrame, key: str, built_at: Column) -> DataFrame:
    """Rows of documents without a deletion marker younger than the last build."""
    young = markers.where(F.col("deleted_at") > built_at).select(key).distinct()
    return rows.join(young, key, "left_anti")


def unexpired(rows: DataFrame, created: str, now: Column, seconds: int) -> DataFrame:
    """Cache rows that are at most ``seconds`` old."""
    return rows.where(F.col(created).cast("timestamp") + F.make_interval(secs=F.lit(seconds)) >= now)


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each id: ``id, fingerprint, doc_updated_at``."""
    best = F.max_by(F.struct("fingerprint", "doc_updated_at"), F.struct("batch", "ord"))
    return rows.groupBy("id").agg(best.alias("b")).select("id", "b.fingerprint", "b.doc_updated_at")


class SyncState:
    """Versions of the known documents as tables in the shared folder; a stream's batch commits the next version.

    A batch that is run again after a failure starts from the version it started from before, so its result is the same.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self, number: int) -> DataFrame:
        schema = "id string, fingerprint string, doc_updated_at string"
        if number < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/version={number}")

    def apply(self, feed: DataFrame, batch_id: int) -> None:
        """``foreachBatch``: take what changed, write the next version and the batch's summary."""
        known = self.version(batch_id - 1)
        feed = staged(feed, "sync-batch")
        taken = latest(changed_only(feed, known))
        merged = known.join(taken.select("id"), "id", "left_anti").unionByName(taken)
        merged.write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")
        summary(feed, known).write.mode("overwrite").parquet(f"{self.path}/summary={batch_id}")


def start_sync(feed: DataFrame, state: SyncState, checkpoint: str):
    """Start the stream; ``availableNow`` ends it when the feed is read."""
    return feed.writeStream.foreachBatch(state.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
