"""Event-time windows over a batch or a stream of events, and state that lives for a while."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MEASURES = (F.count, F.sum)


def timed(events: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    """With a watermark on streams; batches need none."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, lateness) if lateness and events.isStreaming else events


def _grouped(events: DataFrame, window: Column, keys: list[str], value: str) -> DataFrame:
    out = events.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], value: str, lateness: str | None = None) -> DataFrame:
    return _grouped(timed(events, ts, lateness), F.window(ts, size), keys, value)


def sliding(events: DataFrame, ts: str, size: str, step: str, keys: list[str], value: str, lateness: str | None = None) -> DataFrame:
    return _grouped(timed(events, ts, lateness), F.window(ts, size, step), keys, value)


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], value: str, lateness: str | None = None) -> DataFrame:
    """Runs of events with less than ``gap`` between neighbours."""
    return _grouped(timed(events, ts, lateness), F.session_window(ts, gap), keys, value)


def distinct_events(events: DataFrame, ts: str, keys: list[str], lateness: str) -> DataFrame:
    """The first event of each key; a stream forgets keys after ``lateness``."""
    if events.isStreaming:
        return timed(events, ts, lateness).dropDuplicatesWithinWatermark(keys)
    return events.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in events.columns if c not in keys]), ts).alias("e")).select(*keys, "e.*")


def without_thoughts(tokens: DataFrame, key: str, ord_: str, token: str) -> DataFrame:
    """Tokens of a message outside ``<think>`` and ``</think>``, which may be cut anywhere: ``key, answer, thought``."""
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(ord_, token))), lambda x: x[token]), "")
    rows = tokens.groupBy(key).agg(whole.alias("_all"))
    thought = F.array_join(F.regexp_extract_all("_all", F.lit(r"(?s)<think>(.*?)(?:</think>|$)"), F.lit(1)), "")
    return rows.select(key, F.regexp_replace("_all", r"(?s)<think>.*?(?:</think>|$)", "").alias("answer"), thought.alias("thought"))
