"""Packing documents into sequences by minimum bin slack (operator 4).

A document gives full windows of ``CAPACITY`` ids and one rest. A task packs the rests of its documents in groups of
``GROUP`` as they come. In a group, each sequence starts with the longest rest that is left; a
bitset subset-sum over the remaining lengths then finds the multiset that fills it closest to
capacity, and the counts are traced back. Rests in sequences that stay less than ``WELL_FILLED`` wait for the next
group; the few that a task has left in the end are packed with those of other tasks, and only they are shuffled.

Edge cases: a null or empty text is its end id alone; a very long text is cut into windows in one pass; rows with a null
``doc_id`` and rows that share one are packed each for itself, wherever they stand; an empty table gives no pieces;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import crc32
from .staging import read_table, staged
from .tokens import encoded

CAPACITY = 2048
GROUP = 4096
END_ID = 1
WELL_FILLED = 0.98
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long"


def fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """The (length, times) multiset from ``counts`` whose sum is the largest that is at most ``room``.

    Bit s of ``reach`` says that some multiset sums to s; repeats of a length enter as 1, 2, 4, ...
    of it. Walking the saved bitsets backwards tells which of them the best sum needs.
    """
    reach, inside, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left > 0:
            times = min(times, left)
            steps.append((reach, length, times))
            reach |= (reach << (length * times)) & inside
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    best, taken = reach.bit_length() - 1, {}
    for before, length, times in reversed(steps):
        if not before >> best & 1:
            taken[length] = taken.get(length, 0) + times
            best -= length * times
    return list(taken.items())


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each item; deterministic, equal lengths in their given order."""
    order = np.argsort(lengths, kind="stable")
    values, firsts, totals = np.unique(lengths[order], return_index=True, return_counts=True)
    waiting = {int(v): order[f : f + n].tolist()[::-1] for v, f, n in zip(values, firsts, totals, strict=True)}
    counts = {v: len(x) for v, x in waiting.items()}
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    while counts:
        longest = max(counts)
        chosen = [(longest, 1)]
        counts[longest] -= 1
        if not counts[longest]:
            del counts[longest]
        for length, times in fill(counts, capacity - longest):
            chosen.append((length, times))
            counts[length] -= times
            if not counts[length]:
                del counts[length]
        at = 0
        for length, times in chosen:
            for _ in range(times):
                item = waiting[length].pop()
                sequence[item], offset[item] = number, at
                at += length
        number += 1
    return sequence, offset


class Task:
    """The pieces of one task, and the numbers of its sequences: odd ones, as even ones are for rests of several tasks."""

    def __init__(self, task: int, capacity: int, with_ids: bool, patience: int):
        self.first, self.sequences, self.rows = task << 32, 0, 0
        self.capacity, self.with_ids, self.patience = capacity, with_ids, patience
        self.rests: list[tuple] = []

    def sequence_id(self, number: int) -> int:
        return (self.first + number) * 2 + 1

    def batch(self, rows: list[tuple], ids: list[np.ndarray]) -> pa.RecordBatch:
        names = [c.split(" ")[0] for c in PIECES.split(", ")]
        columns = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * (len(names) - 1))]
        columns.append(pa.array(np.arange(self.rows, self.rows + len(rows)) + self.first))
        self.rows += len(rows)
        if self.with_ids:
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def cut(self, docs: list, texts: list[np.ndarray]) -> pa.RecordBatch:
        """Full windows at once; rests wait for their group."""
        rows, ids_of = [], []
        for doc, ids in zip(docs, texts, strict=True):
            for start in range(0, len(ids), self.capacity):
                piece = ids[start : start + self.capacity]
                row = (doc, start, len(piece), crc32(piece), len(ids))
                if len(piece) == self.capacity:
                    rows.append((*row, self.sequence_id(self.sequences), 0))
                    ids_of.append(piece)
                    self.sequences += 1
                else:
                    self.rests.append((row, piece.copy() if self.with_ids else None))
        return self.batch(rows, ids_of)

    def place(self, last: bool) -> pa.RecordBatch:
        """Pack all rests at hand. Those of sequences that are not well filled wait or go without a sequence.

        They go at the end of the task, or where more than ``patience`` of them would wait: rests of other tasks may fit.
        """
        lengths = np.array([row[2] for row, _ in self.rests], np.int64)
        sequence, offset = pack_lengths(lengths, self.capacity)
        filled = np.bincount(sequence, weights=lengths) >= WELL_FILLED * self.capacity
        number = np.cumsum(filled) - 1 + self.sequences
        self.sequences += int(filled.sum())
        last = last or len(lengths) - int(filled[sequence].sum()) > self.patience
        rows, ids, waiting = [], [], []
        for rest, s, o in zip(self.rests, sequence.tolist(), offset.tolist(), strict=True):
            if filled[s]:
                rows.append((*rest[0], self.sequence_id(int(number[s])), o))
                ids.append(rest[1])
            elif last:
                rows.append((*rest[0], None, None))
                ids.append(rest[1])
            else:
                waiting.append(rest)
        self.rests = waiting
        return self.batch(rows, ids)


def pack(
    docs: DataFrame,
    tokenizer: str,
    blank_belongs: bool = True,
    capacity: int = CAPACITY,
    group: int = GROUP,
    with_ids: bool = True,
) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are the piece's tokens, at ``offset`` of its sequence; ``ids_crc32`` is their checksum. Without
    ``with_ids``, the checksum alone leaves the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task(TaskContext.get().partitionId(), capacity, with_ids, group)
        enough = group
        for part, texts in encoded(batches, tokenizer, blank_belongs, END_ID):
            yield task.cut(part.column(part.schema.get_field_index("doc_id")).to_pylist(), texts)
            if len(task.rests) >= enough:
                yield task.place(False)
                enough = group + len(task.rests)
        if task.rests:
            yield task.place(True)

    columns = PIECES + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = staged(rows.mapInArrow(run, columns), "pack-pieces")
    left = pieces.where("sequence_id IS NULL")
    groups = max(1, -(-left.count() // group))

    def place(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("row", kind="stable")
        sequence, offset = pack_lengths(table["length"].to_numpy(np.int64), capacity)
        table["sequence_id"] = ((table["bucket"].to_numpy(np.int64) << 32) + sequence) * 2
        table["offset"] = offset
        return table.drop(columns="bucket")

    packed = left.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(groups))).groupBy("bucket").applyInPandas(place, columns)
    return pieces.where("sequence_id IS NOT NULL").unionByName(packed).drop("row")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
