"""Keyed state that lives for a while, as stateful streaming processors, with the batch rules they equal.

The processors need a session whose ``spark.sql.streaming.stateStore.providerClass`` is the RocksDB provider. Their state
lives in the query's checkpoint: a lost executor or a restarted query goes on where the last batch ended. A key's state
is one small row; timers in event time remove it, so the state is bounded by the keys seen within the time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPEN, CLOSE = "<think>", "</think>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Cache entries.


def cached_lookups(events: DataFrame, seconds: int) -> DataFrame:
    """``key, ts, ord, value`` of each lookup (a row without a value): the last value put before it, none if it is too old.

    An entry lives for ``seconds`` from its put on, the last second included; a later put replaces it. Rows of one
    moment are in the order of ``ord``.
    """
    put = F.when(F.col("value").isNotNull(), F.struct("value", "ts"))
    before = Window.partitionBy("key").orderBy("ts", "ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumn("_last", F.last(put, ignorenulls=True).over(before)).where(F.col("value").isNull())
    alive = F.col("_last.ts") + F.make_interval(secs=F.lit(seconds)) >= F.col("ts")
    return rows.select("key", "ts", "ord", F.when(alive, F.col("_last.value")).alias("value"))


class CacheProcessor(StatefulProcessor):
    """Puts and lookups of a key in the order of their events; a timer removes the entry when its time is over."""

    def __init__(self, seconds: int):
        self.life = seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "value string, created long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        table = pd.concat(list(rows)).sort_values(["ts", "ord"], kind="stable")
        value, created = self.entry.get() if self.entry.exists() else (None, None)
        timer, found = created, []
        for ts, nth, new in zip(table["ts"], table["ord"], table["value"], strict=True):
            now = ts.value // 1000
            if new is not None:
                value, created = new, now
            else:
                found.append((key[0], ts, nth, value if created is not None and created + self.life >= now else None))
        if created is not None and created != timer:
            if timer is not None:
                self.handle.deleteTimer(self._timer(timer))
            self.entry.update((value, created))
            self.handle.registerTimer(self._timer(created))
        if found:
            yield pd.DataFrame(found, columns=["key", "ts", "ord", "value"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.entry.exists() and self._timer(self.entry.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter(())

    def _timer(self, created: int) -> int:
        """The first moment, in milliseconds, at which no lookup can find the entry any more."""
        return (created + self.life) // 1000 + 1

    def close(self) -> None:
        pass


def cached_lookups_stream(events: DataFrame, seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """The same over a stream of ``key string, ts timestamp, ord long, value string``."""
    rows = events.withWatermark("ts", lateness).groupBy("key")
    schema = "key string, ts timestamp, ord long, value string"
    return rows.transformWithStateInPandas(CacheProcessor(seconds), schema, "Append", "EventTime")


# Thoughts in token streams.


def held_back(text: str, mark: str) -> int:
    """Length of the longest end of ``text`` that may be the beginning of ``mark``."""
    return next((n for n in range(min(len(mark) - 1, len(text)), 0, -1) if mark.startswith(text[-n:])), 0)


def split_thoughts(inside: bool, carry: str, token: str) -> tuple[bool, str, str, str]:
    """State and carry after a token, and what it adds to the answer and to the thought."""
    text, parts = carry + token, {False: [], True: []}
    while True:
        mark = CLOSE if inside else OPEN
        at = text.find(mark)
        if at < 0:
            keep = held_back(text, mark)
            parts[inside].append(text[: len(text) - keep])
            return inside, text[len(text) - keep :], "".join(parts[False]), "".join(parts[True])
        parts[inside].append(text[:at])
        inside, text = not inside, text[at + len(mark) :]


class ThoughtProcessor(StatefulProcessor):
    """Splits each message's tokens as they come; marks may be cut anywhere, also between batches.

    A null token ends its message. A message without one ends when its time to live is over; either way what was held
    back as a possible mark comes out, as ``ord`` -1 in the second case.
    """

    def __init__(self, seconds: int):
        self.life = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "inside boolean, carry string, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        table = pd.concat(list(rows)).sort_values("ord", kind="stable")
        inside, carry, timer = self.state.get() if self.state.exists() else (False, "", None)
        found, ended, last = [], False, 0
        for nth, token, ts in zip(table["ord"], table["token"], table["ts"], strict=True):
            last = max(last, ts.value // 1_000_000)
            if token is None:
                found.append((key[0], nth, *(("", carry) if inside else (carry, ""))))
                inside, carry, ended = False, "", True
            else:
                inside, carry, answer, thought = split_thoughts(inside, carry, token)
                found.append((key[0], nth, answer, thought))
                ended = False
        if timer is not None:
            self.handle.deleteTimer(timer)
        if ended:
            self.state.clear()
        else:
            timer = last + self.life
            self.state.update((inside, carry, timer))
            self.handle.registerTimer(timer)
        yield pd.DataFrame(found, columns=["key", "ord", "answer", "thought"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.state.exists():
            inside, carry, timer = self.state.get()
            if timer <= expiredTimerInfo.getExpiryTimeInMs():
                self.state.clear()
                if carry:
                    yield pd.DataFrame([(key[0], -1, *(("", carry) if inside else (carry, "")))], columns=["key", "ord", "answer", "thought"])

    def close(self) -> None:
        pass


def thoughts_stream(tokens: DataFrame, seconds: int, lateness: str = "0 seconds") -> DataFrame:
    """``key, ord, answer, thought`` pieces of a stream of ``key string, ord long, token string, ts timestamp``."""
    rows = tokens.withWatermark("ts", lateness).groupBy("key")
    schema = "key string, ord long, answer string, thought string"
    return rows.transformWithStateInPandas(ThoughtProcessor(seconds), schema, "Append", "EventTime")
