"""Texts in batches, and keys dealt from batches to buckets and back.

A batch is a few megabytes of documents as one row of a staged table, so its number and order are
fixed. Each step sends, for a batch, one packed value to each hash bucket (every distinct key of the
batch once, however often it occurs there); a bucket task sees its keys from all batches and answers
every batch with a packed value; the answers of a batch are joined to it by its number. A key that a
third of all documents hold costs one entry a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import Block, pack, unpack
from .staging import shuffle_width, staged

BATCH_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
#: Of zstd for the texts, which are written once but lie on disk staged and shuffled: a seventh smaller than at level 1.
LEVEL = 4
NO_ID = np.int64(-(1 << 63))

Step = Callable[[np.ndarray, Block, list[bytes]], Iterator[tuple[int, bytes]]]


def text_batches(docs: DataFrame, limit: int = BATCH_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """Staged ``batch, n_bytes, content``; documents ascend by ``doc_id`` in a batch, a null id comes first.

    With ``carry``, ``carried`` holds those columns of the batch's documents, in the same order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def done() -> pa.RecordBatch:
            held.sort(key=lambda x: x[0])
            ids = np.array([x[0] for x in held], np.int64)
            sizes = np.array([len(x[1]) for x in held], np.int64)
            data = b"".join(x[1] for x in held)
            raw = len(data).to_bytes(8, "little") + pa.Codec("zstd", LEVEL).compress(data, asbytes=True)
            head = pack(ids, sizes)
            content = len(head).to_bytes(8, "little") + head + raw
            row = {"batch": [task << 32 | number], "n_bytes": [size], "content": [content]}
            if carry:
                row["carried"] = [carried_bytes([x[2] for x in held], fields)]
            return pa.RecordBatch.from_pydict(row, schema)

        for batch in batches:
            ids = batch.column(0).fill_null(int(NO_ID)).to_pylist()
            fields = [batch.schema.field(c) for c in carry]
            others = zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True) if carry else [()] * len(ids)
            for doc, text, other in zip(ids, batch.column(1), others, strict=True):
                text = text.as_buffer().to_pybytes() if text.is_valid else b""
                if held and size + len(text) > limit:
                    yield done()
                    number, held, size = number + 1, [], 0
                held.append((doc, text, other))
                size += len(text)
        if held:
            yield done()

    names = ["batch", "n_bytes", "content", *(["carried"] if carry else [])]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=False)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    columns = "batch long, n_bytes long, content binary" + (", carried binary" if carry else "")
    return staged(rows.mapInArrow(run, columns), "text-batches")


def carried_bytes(rows: list[tuple], fields: list[pa.Field]) -> bytes:
    """Rows of further columns as one Arrow stream."""
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with pa.ipc.new_stream(sink, pa.schema(fields), options=options) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields)))
    return sink.getvalue().to_pybytes()


def carried_columns(content: bytes) -> dict[str, pa.Array]:
    """The columns of ``carried_bytes``."""
    with pa.ipc.open_stream(content) as rows:
        batch = rows.read_next_batch()
    return dict(zip(batch.schema.names, batch.columns, strict=True))


def opened(content: bytes) -> tuple[np.ndarray, Block]:
    """Document ids and texts of a batch."""
    n = int.from_bytes(content[:8], "little")
    ids, sizes = unpack(content[8 : 8 + n])
    size = int.from_bytes(content[8 + n : 16 + n], "little")
    data = pa.Codec("zstd").decompress(content[16 + n :], size, asbytes=True) if size else b""
    return ids, Block(np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(sizes))).astype(np.int64))


def bucket_bits(batches: DataFrame, size: int = BUCKET_BYTES) -> int:
    """Bits of a hash that number the buckets: each has the keys of about ``size`` bytes of text."""
    total = batches.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    return max(3, int(np.ceil(np.log2(max(total / size, shuffle_width(batches.sparkSession))))))


def with_answers(batches: DataFrame, *answers: DataFrame, carry: bool = False) -> DataFrame:
    """``batch, content, a0, a1, ...``: each batch with its answers of every step, ordered by bucket.

    With ``carry``, what the batches carry comes last.
    """
    out = batches.select("batch", "content", *(["carried"] if carry else []))
    for i, found in enumerate(answers):
        by_batch = found.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias(f"_{i}"))
        out = out.join(by_batch, "batch", "left").withColumn(f"a{i}", F.col(f"_{i}.answer")).drop(f"_{i}")
    if carry:
        out = out.withColumn("carry", F.col("carried")).drop("carried")
    return out


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, Block, list[list[bytes]]]]:
    for i in range(len(batch)):
        ids, block = opened(batch.column(1)[i].as_py())
        yield batch.column(0)[i].as_py(), ids, block, [batch.column(j)[i].as_py() or [] for j in range(2, batch.num_columns)]


def scatter(batches: DataFrame, step: Callable) -> DataFrame:
    """``bucket, batch, payload`` from ``step(ids, block, *answers)``, which yields (bucket, payload)."""

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow:
            for number, ids, block, answers in rows_of(part):
                found = list(step(ids, block, *answers))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([number] * len(found), pa.int64()),
                        pa.array([x[1] for x in found], pa.binary()),
                    ],
                    ["bucket", "batch", "payload"],
                )

    return batches.mapInArrow(run, "bucket long, batch long, payload binary")


def gather(rows: DataFrame, step: Callable, name: str) -> DataFrame:
    """Staged ``batch, bucket, answer`` from ``step(batch numbers, payloads)``, one answer for each payload."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        numbers = table.column("batch").to_numpy()
        answers = step(numbers, table.column("payload").to_pylist())
        return pa.table(
            {"batch": table.column("batch"), "bucket": table.column("bucket"), "answer": pa.array(answers, pa.binary())}
        )

    return staged(rows.groupBy("bucket").applyInArrow(run, "batch long, bucket long, answer binary"), name)


def slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Runs of ascending 64-bit keys with the same top bits."""
    if len(keys):
        top = (keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(top)) + 1, [len(top)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield int(top[a]), slice(a, b)


def bits_of(answers: list[bytes], column: int, n: int) -> np.ndarray:
    """The flags that the buckets sent back, in the order of the batch's ascending keys."""
    parts = [unpack(x) for x in answers]
    flags = [np.unpackbits(p[column], count=int(p[0][0])) for p in parts]
    out = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError(f"{len(out)} answers for {n} keys")
    return out


def flag_answer(*flags: np.ndarray) -> bytes:
    return pack(np.array([len(flags[0])], np.int64), *(np.packbits(f) for f in flags))


class FirstOccurrence:
    """For windows of a batch: which of them started earlier, in the batch or anywhere else.

    ``hashes`` are 64-bit keys of windows in ascending (document, start) order, ``checks`` further bits.
    """

    def __init__(self, hashes: np.ndarray, checks: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        ordered, further = hashes[order], checks[order]
        new = np.ones(len(order), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        if np.any(~new[1:] & (further[1:] != further[:-1])):
            order = np.lexsort((checks, hashes))
            ordered, further = hashes[order], checks[order]
            new[1:] = (ordered[1:] != ordered[:-1]) | (further[1:] != further[:-1])
        self.keys, self.checks, self.first = ordered[new], further[new], order[new]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1

    def payloads(self, docs: np.ndarray, starts: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
        for bucket, part in slices(self.keys, bits):
            at = self.first[part]
            yield bucket, pack(self.keys[part], self.checks[part], docs[at], starts[at].astype(np.uint32))

    def repeats(self, lost: np.ndarray) -> np.ndarray:
        """``lost[key]``: the batch's first window of the key isn't the first of all."""
        again = np.ones(len(self.group), bool)
        again[self.first] = False
        return again | lost[self.group]


def decide_first(numbers: np.ndarray, payloads: list[bytes]) -> list[bytes]:
    """Bucket step: for each batch's keys and checks, whether an earlier window elsewhere has the key."""
    parts = [unpack(p) for p in payloads]
    sizes = np.array([len(p[0]) for p in parts])
    keys, checks, docs, starts = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((np.repeat(numbers, sizes), starts, docs, checks, keys))
    lost = np.zeros(len(keys), bool)
    lost[order[1:]] = (keys[order[1:]] == keys[order[:-1]]) & (checks[order[1:]] == checks[order[:-1]])
    return [flag_answer(x) for x in np.split(lost, np.cumsum(sizes)[:-1])]
