"""Token ids as frequency-ranked, byte-aligned variable-length codes (operator 6).

Ids are renumbered by how often the corpus has them, so that most ranks fit one byte. A block
file has a header, the ids of its documents and their lengths, then *control* bytes (two bits for
each rank: its number of bytes less one) apart from the *data* bytes. Decoding looks each control
byte up in a table of four lengths, so it is numpy from end to end.

Blocks are written in ascending ``doc_id`` order as the one binary column of a Parquet table, which
gives them Spark's committers: a lost executor leaves no half-written block. That table is the file format.

Edge cases: a null or empty text is its end id alone; null ids come first, spread over parts by their content; rows
that share a ``doc_id`` are documents of their own, in the order of their ids; a text of any length stays in one block;
an empty table gives no blocks; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fingerprint import split_points
from .kernels import crc32, pack, unpack
from .staging import read_table, shuffle_width, staged
from .tokens import encoded, words_of

MAGIC = b"GVB1"
END_ID = 1
BLOCK_IDS = 1 << 18
#: Text of a part, so that parts grow in number and not in size.
PART_BYTES = 16 << 20
NO_ID = np.int64(-(1 << 63))
#: Bytes of each of the four ranks that a control byte speaks for.
LENGTHS = np.array([[1 + (c >> 2 * i & 3) for i in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control and data bytes."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = ((ranks > 0xFF).view(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    four = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    four[: len(ranks)] = extra
    four = four.reshape(-1, 4)
    return four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6, data


def decode_ranks(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    lengths = LENGTHS[control].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = data
    return out.view("<u4").ravel()


def write_block(doc_ids: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_ranks(ranks)
    head = np.array([len(doc_ids), len(ranks), len(control), len(data)], "<i8")
    return b"".join(
        (MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), sizes.astype("<i8").tobytes(), control.tobytes(), data.tobytes())
    )


def read_block(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ranks."""
    if raw[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    docs, n, controls, size = np.frombuffer(raw, "<i8", 4, 4).tolist()
    at = 36 + 16 * docs
    control = np.frombuffer(raw, np.uint8, controls, at)
    data = np.frombuffer(raw, np.uint8, size, at + controls)
    return (
        np.frombuffer(raw, "<i8", docs, 36),
        np.frombuffer(raw, "<i8", docs, 36 + 8 * docs),
        decode_ranks(control, data, n),
    )


def id_counts(runs: DataFrame) -> DataFrame:
    """``id, n`` over all documents: no more rows than the vocabulary has entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                counts = np.bincount(unpack(raw.as_py())[2])
                if len(counts) > len(total):
                    counts[: len(total)] += total
                    total = counts
                else:
                    total[: len(counts)] += counts
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["id", "n"])

    return runs.select("run").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def rank_table(counts: DataFrame) -> np.ndarray:
    """``table[rank] = id``, most frequent first; bounded by the tokenizer's vocabulary."""
    rows = counts.collect()
    return np.array([r["id"] for r in sorted(rows, key=lambda r: (-r["n"], r["id"]))], np.uint32)


def id_type(tokenizer: str) -> np.dtype:
    """Two bytes an id where the whole vocabulary fits them, else four."""
    return np.dtype("<u2" if len(words_of(tokenizer, False).begins) <= 1 << 16 else "<u4")


def encoded_rows(docs: DataFrame, tokenizer: str, blank_belongs: bool, end_id: int) -> tuple[DataFrame, int]:
    """``doc_id, part, ids`` (little-endian) and the number of parts, which ascend with ``doc_id``.

    Null ids come first, dealt to parts by their ids' checksum.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    parts = max(1, min(size["rows"], max(shuffle_width(docs.sparkSession), -(-(size["n"] or 0) // PART_BYTES))))
    points = np.array(split_points(docs, "doc_id", parts) or [0], np.int64)
    kind = id_type(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in encoded(batches, tokenizer, blank_belongs, end_id):
            doc = rows.column(rows.schema.get_field_index("doc_id"))
            none = doc.is_null().to_numpy(zero_copy_only=False)
            part = np.searchsorted(points, doc.fill_null(0).to_numpy(), side="right") - 1 + parts
            part[none] = [crc32(texts[i]) % parts for i in np.flatnonzero(none).tolist()]
            sizes = np.cumsum([0, *(kind.itemsize * len(t) for t in texts)]).astype(np.int64)
            flat = pa.py_buffer(np.concatenate(texts).astype(kind))
            ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(sizes), flat])
            yield pa.RecordBatch.from_arrays(
                [doc, pa.array(part, pa.int32()), ids.cast(pa.binary())], ["doc_id", "part", "ids"]
            )

    return docs.mapInArrow(run, "doc_id long, part int, ids binary"), parts + len(points)


def raw_runs(dealt: DataFrame, block_ids: int, kind: np.dtype) -> DataFrame:
    """``part, block, n_ids, run``: documents in order, about ``block_ids`` ids to a row, their ids as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block, docs, texts, held = None, 0, [], [], 0

        def done() -> pa.RecordBatch:
            sizes = np.array([len(t) // kind.itemsize for t in texts], np.int64)
            body = pack(np.array(docs, np.int64), sizes, np.frombuffer(b"".join(texts), kind))
            columns = [pa.array([x], pa.int64()) for x in (here, block, held)] + [pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "n_ids", "run"])

        for batch in batches:
            ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc, at, text in zip(ids, parts, batch.column(2), strict=True):
                text = text.as_buffer().to_pybytes()
                if held and (at != here or held + len(text) // kind.itemsize > block_ids):
                    yield done()
                    block, docs, texts, held = (block + 1 if at == here else 0), [], [], 0
                elif at != here:
                    block = 0
                here = at
                docs.append(NO_ID if doc is None else doc)
                texts.append(text)
                held += len(text) // kind.itemsize
        if held:
            yield done()

    return dealt.mapInArrow(run, "part long, block long, n_ids long, run binary")


def write_ids(
    docs: DataFrame, tokenizer: str, blank_belongs: bool = False, end_id: int = END_ID, block_ids: int = BLOCK_IDS
) -> tuple[DataFrame, np.ndarray]:
    """Write the blocks; returns the table of blocks (``part, block, n_ids, blob``) and the rank table.

    Each text is encoded once. Its ids are dealt to ranges of ``doc_id``, staged in order, counted, and written by rank.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, parts = encoded_rows(docs, tokenizer, blank_belongs, end_id)
    dealt = rows.repartitionById(parts, "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    runs = staged(raw_runs(dealt, block_ids, id_type(tokenizer)), "token-runs")
    table = rank_table(id_counts(runs))
    rank_of = np.zeros(int(table.max()) + 1 if len(table) else 1, np.uint32)
    rank_of[table] = np.arange(len(table), dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for raw in batch.column(3):
                ids, sizes, tokens = unpack(raw.as_py())
                blobs.append(write_block(ids, sizes, rank_of[tokens]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(blobs, pa.binary())], ["part", "block", "n_ids", "blob"])

    return staged(runs.mapInArrow(run, "part long, block long, n_ids long, blob binary"), "token-ids"), table


def read_ids(blocks: DataFrame, table: np.ndarray) -> DataFrame:
    """One row a document, from the blocks alone: ``doc_id, start, n_tokens, ids_crc32``."""
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0)))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    index = blocks.select("part", "block", "n_ids").withColumn("_at", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    index = index.join(parts, "part").select("part", "block", (F.col("base") + F.col("_at")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, first in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                docs, sizes, ranks = read_block(raw.as_py())
                ids = table[ranks]
                ends = np.cumsum(sizes)
                sums = [crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, pa.int64(), mask=docs == NO_ID),
                        pa.array(first + ends - sizes, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return (
        blocks.join(index, ["part", "block"])
        .select("blob", "first")
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    )


def op6_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    blocks, table = write_ids(docs, public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(blocks, table)
