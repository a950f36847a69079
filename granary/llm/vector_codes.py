"""Product codes of vectors with exact integer codebooks (operator 12).

Each component x becomes the integer floor(256 * x). Vectors are cut into 16 equal parts; a part's codebook starts as
that part of the 64 vectors with the smallest ids, is moved twice to the floored means of its parts, and codes every
vector by the nearest entries.

Nearest entries come from a float32 matrix product: for a part x and an entry c, ``|c|^2 - 2 x.c`` differs from its
float32 value by no more than ``(2 d + 16) u (|x|^2 + 2 |c|^2)``, with d components and u = 2**-24: the two conversions
and a product of d terms in any order, fused or not, err by ``(d + 2) u / (1 - (d + 2) u)`` of ``sum |x_i c_i|``, which
is at most ``(|x|^2 + |c|^2) / 2``; the norm, its conversion and the last subtraction add ``3 u`` of the terms, and
what is left over covers the rounding of the bounds themselves. Entries whose interval overlaps the best one's are
compared again in int64; equal distances go to the lower index. Components too large for int64 distances (from about
2**28 / sqrt(d) on) are compared with Python's integers alone.

Only codebooks (64 entries of every part) and their sums reach the driver. A codebook needs one pass over the vectors.

Edge cases: a vector that is null, empty, or holds a null or non-finite component is dropped, as is one of another
length than the first kept vector's (in the order below). A length that is no multiple of 16 is filled up with zeros.
Vectors are ordered by id, null ids last, rows that share an id by their components; fewer than 64 vectors give
smaller codebooks. Rows that repeat are coded each. An error, or a sum of errors, beyond a long is the largest long.
An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import read_table, staged

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE = 256
LONGEST = (1 << 63) - 1
ROWS_AT_ONCE = 4096
#: Sums of this many labels (about 40 bytes each) may be broadcast; more are joined by shuffle.
BROADCAST_LABELS = 100_000


def scaled(values: np.ndarray, wide: bool) -> np.ndarray:
    """``floor(256 * x)``: int64, or Python's integers if ``wide``."""
    if not wide:
        return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)
    whole = [int(x) * SCALE if abs(x) >= 1 << 60 else math.floor(x * SCALE) for x in values.ravel().tolist()]
    out = np.empty(len(whole), object)
    out[:] = whole
    return out.reshape(values.shape)


def vectors(batch: pa.RecordBatch, length: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and finite vectors of one length (all lengths in turn where none is given)."""
    lists = batch.column(1)
    lists = lists.cast(pa.large_list(lists.type.value_type))
    offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    values = lists.values
    if values.null_count:
        values = values.fill_null(math.nan)
    flat = values.cast(pa.float64()).to_numpy() if not pa.types.is_floating(values.type) else values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    here = np.array(lists.is_valid(), bool) & (sizes > 0)
    for size in np.unique(sizes[here]).tolist() if length is None else [length]:
        rows = np.flatnonzero(here & (sizes == size))
        for i in range(0, len(rows), ROWS_AT_ONCE):
            some = rows[i : i + ROWS_AT_ONCE]
            found = flat[offsets[some][:, None] + np.arange(size)]
            finite = np.isfinite(found).all(axis=1)
            yield some[finite], found[finite]


def in_parts(values: np.ndarray, parts: int) -> np.ndarray:
    """``[row, part, place]``, filled up with zeros."""
    width = -(-values.shape[1] // parts)
    out = np.zeros((len(values), parts * width), values.dtype)
    out[:, : values.shape[1]] = values
    return out.reshape(len(values), parts, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, ties to the lower index, and its squared distance (both integers, exact)."""
    if x.dtype == object:
        away = ((x[:, None, :] - book[None]) ** 2).sum(axis=-1)
        at = np.array([min(range(len(book)), key=row.__getitem__) for row in away], np.int64)
        return at, away[np.arange(len(x)), at]
    norms, own = (book * book).sum(axis=1), (x * x).sum(axis=1)
    score = norms.astype(np.float32) - np.float32(2) * (x.astype(np.float32) @ book.astype(np.float32).T)
    unit = np.float32((2 * x.shape[1] + 16) * 2.0**-24)
    half = unit * (own.astype(np.float32)[:, None] + np.float32(2) * norms.astype(np.float32))
    near = score - half <= (score + half).min(axis=1, keepdims=True)
    row, entry = np.nonzero(near)
    many = np.bincount(row, minlength=len(x)) > 1
    at = np.empty(len(x), np.int64)
    at[row] = entry  # right where one entry is left
    doubt = many[row]
    if doubt.any():
        row, entry = row[doubt], entry[doubt]
        exact = ((x[row] - book[entry]) ** 2).sum(axis=1)
        first = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.repeat(np.minimum.reduceat(exact, first), np.diff(np.append(first, len(row))))
        hit = np.flatnonzero(exact == best)[::-1]  # entries ascend in a row: the lowest is set last
        at[row[hit]] = entry[hit]
    return at, ((x - book[at]) ** 2).sum(axis=1)


def part_sums(x: np.ndarray, at: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    if len(first):
        there = at[order[first]]
        sums[there] += np.add.reduceat(x[order], first, axis=0)
        counts[there] += np.diff(np.append(first, len(order)))


def first_vectors(table: DataFrame, entries: int) -> list[tuple]:
    """``vec_id, values`` of the first kept vectors of one length, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by length: the right length is that of the first vector of all
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for rows, found in vectors(batch, None):
                size = found.shape[1] if len(found) else 0
                keys = [(ids[r] is None, ids[r] or 0, v) for r, v in zip(rows.tolist(), found.tolist(), strict=True)]
                held[size] = sorted(held.get(size, []) + keys)[:entries]
        for keys in held.values():
            yield pa.RecordBatch.from_pydict(
                {"vec_id": [None if k[0] else k[1] for k in keys], "v": [k[2] for k in keys]},
                pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))]),
            )

    own = table.mapInArrow(run, "vec_id long, v array<double>")
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    first = own.orderBy(*order).limit(1).collect()
    if not first:
        return []
    return own.where(F.size("v") == len(first[0]["v"])).orderBy(*order).limit(entries).collect()


def largest(table: DataFrame, length: int) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            for _, found in vectors(batch, length):
                most = max(most, float(np.abs(found).max(initial=0)))
        yield pa.RecordBatch.from_pydict({"most": [most]})

    return table.mapInArrow(run, "most double").agg(F.max("most").alias("most")).first()["most"] or 0.0


def moved(table: DataFrame, book: np.ndarray, length: int) -> np.ndarray:
    """The codebooks after one round; ``book[part, entry, place]``."""
    parts, entries, width = book.shape
    wide = book.dtype == object

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(book.shape, book.dtype), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for _, found in vectors(batch, length):
                x = in_parts(scaled(found, wide), parts)
                for p in range(parts):
                    part_sums(x[:, p], nearest(x[:, p], book[p])[0], sums[p], counts[p])
        slot = np.flatnonzero(counts.ravel())
        rows = sums.reshape(-1, width)[slot]
        yield pa.RecordBatch.from_pydict(
            {"slot": slot, "n": counts.ravel()[slot], "sums": [[str(v) for v in row] for row in rows.tolist()]},
            pa.schema([("slot", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))]),
        )

    partial = table.mapInArrow(run, "slot long, n long, sums array<string>")
    if wide:

        def total(rows: pa.Table) -> pa.Table:
            sums = [str(sum(map(int, v))) for v in zip(*rows["sums"].to_pylist(), strict=True)]
            return pa.table({"slot": rows["slot"][:1], "n": [sum(rows["n"].to_pylist())], "sums": [sums]})

        found = partial.groupBy("slot").applyInArrow(total, "slot long, n long, sums array<string>").collect()
    else:
        columns = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).cast("string") for i in range(width)]
        found = partial.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*columns).alias("sums")).collect()
    out = book.copy()
    for row in found:
        out[row["slot"] // entries, row["slot"] % entries] = [int(v) // row["n"] for v in row["sums"]]
    return out


def train(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray | None, int]:
    """Codebooks ``[part, entry, place]`` of ``vec_id, vector`` rows, and the length of their vectors."""
    first = first_vectors(table, entries)
    if not first:
        return None, 0
    length = len(first[0]["v"])
    most = SCALE * largest(table, length) + 1
    width = -(-length // parts)
    # distances of means and vectors, and the sums of a task's vectors, stay far below 2**63
    wide = 4 * width * most * most >= 2.0**61 or most >= 2.0**30
    values = in_parts(scaled(np.array([r["v"] for r in first]), wide), parts)
    book = np.ascontiguousarray(values.transpose(1, 0, 2))
    for _ in range(rounds):
        book = moved(table, book, length)
    return book, length


def codebooks_sha256(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def coded(table: DataFrame, book: np.ndarray, length: int) -> DataFrame:
    """``vec_id, label, code, error`` of each kept row; ``code`` has a byte for each part."""
    parts = len(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, found in vectors(batch, length):
                x = in_parts(scaled(found, book.dtype == object), parts)
                codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), book.dtype)
                for p in range(parts):
                    codes[:, p], away = nearest(x[:, p], book[p])
                    error = error + away
                at = pa.array(rows)
                code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(x), [None, pa.py_buffer(codes)])
                error = pa.array([min(int(e), LONGEST) for e in error.tolist()], pa.int64())
                columns = [batch.column(0).take(at), batch.column(2).take(at), code.cast(pa.binary()), error]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    label = table.schema["label"].dataType.simpleString()
    return table.mapInArrow(run, f"vec_id long, label {label}, code binary, error long")


def compress(
    docs: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, vector: str = "embedding"
) -> tuple[DataFrame, np.ndarray | None]:
    """Codes of all kept rows (``vec_id, label, code, error``) and the codebooks."""
    rows = docs.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.col("label"))
    book, length = train(rows, parts, entries, rounds)
    if book is None:
        label = rows.schema["label"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"vec_id long, label {label}, code binary, error long"), None
    return coded(rows, book, length), book


def decoded(codes: DataFrame, book: np.ndarray) -> DataFrame:
    """``vec_id, vector``: each part's entry, scaled back."""
    parts, _, width = book.shape
    values = book.astype(np.float64) / SCALE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            flat = values[np.arange(parts), code].reshape(len(batch), parts * width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(flat), pa.list_(pa.float64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<double>")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """``label_error``: errors summed over rows of one label, null labels together."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    sums = staged(codes.groupBy("label").agg(total.alias("label_error")), "label-errors")
    small = sums.count() <= BROADCAST_LABELS
    sums = sums.withColumnRenamed("label", "_label")
    return codes.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book = compress(read_table(spark, sf_dir, "embeddings"))
    if book is not None:
        codes = staged(codes, "vector-codes")
    found = with_label_errors(codes)
    digest = codebooks_sha256(book) if book is not None else None
    code = F.lower(F.hex("code")).alias("code")
    return found.select("vec_id", code, "error", "label_error", F.lit(digest).cast("string").alias("codebooks_sha256"))
