"""Near-duplicates by HyperMinHash registers, banding and exact confirmation (operator 10).

A text's set is its distinct three-word shingles (``width`` sets another number). Links need a Jaccard
similarity of 85 percent (``near`` sets another). 128 registers
hold, for each bucket of the hash space, the leading zeros and ten further bits of the smallest
hash. Texts with equal sets are one class; classes that share a band of four registers are
candidates; a collision-corrected estimate of Jaccard similarity discards the hopeless ones by a
margin of 4.5 standard errors; links are confirmed on the full sets. Empty registers borrow from
the next full one for the bands (short texts), never for the estimate.

Components need a link between two groups, not all links inside one: a candidate pair is confirmed
only while its ends are in different components, each class's likeliest partners first, until no
untested pair between two components is left. Groups of more than 16 members are cut into chunks
first, and of these every fourth band is looked at first; what this leaves apart is confirmed over all
bands, block by block of sets.

Edge cases: a null, empty or blank text has an empty set and no links; a text with fewer words
than a shingle is one shingle; rows that share a ``doc_id`` are one document, linked if any of
their texts is; a null ``doc_id`` is never linked (component null, kept). An empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.operators.components import connected_components

from .kernels import U64, Block, blocks, mix
from .staging import read_table, shuffle_width, staged, with_ids

P, MANTISSA = 7, 10
M = 1 << P
ROWS = 4
BANDS = M // ROWS
EMPTY = np.uint16(0xFFFF)
SMALL = 16
CHUNK = 1024
BLOCK_SETS = 512
FIRST_BANDS = 4
MARGIN = 4.5
#: Sets, and band keys, that one task handles with ease; fewer tasks than shuffle partitions suffice for few.
SETS_A_TASK, KEYS_A_TASK = 1_000, 200_000
NEAR, OF = 85, 100


def shingle_sets(block: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct shingle, both ascending."""
    _, _, owner, words = block.words(lower=True)
    if not len(words):
        return owner, words
    per = np.bincount(owner, minlength=len(block.lengths))
    first = np.cumsum(per) - per
    span = np.minimum(per, width)[owner]
    place = np.arange(len(words)) - first[owner]
    whole = place + span <= per[owner]
    h = np.zeros(len(words), U64)
    for j in range(width):
        inside = j < span
        at = np.minimum(np.arange(len(words)) + j, len(words) - 1)
        h = np.where(inside, mix(h ^ words[at]) + U64(j + 1), h)
    h, doc = mix(h)[whole], owner[whole]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def registers(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """HyperMinHash registers; ``doc, h`` ascending."""
    out = np.full((n_docs, M), EMPTY, np.uint16)
    if not len(h):
        return out
    bucket = (h >> U64(64 - P)).astype(np.int64)
    first = np.ones(len(h), bool)
    first[1:] = (bucket[1:] != bucket[:-1]) | (doc[1:] != doc[:-1])
    rest = (h[first] << U64(P)) >> U64(11)  # 53 bits: exact as a double
    part, exponent = np.frexp(rest.astype(np.float64))
    zeros = np.minimum(53 - exponent, 62)
    bits = np.where(rest > 0, (part * 2 - 1) * (1 << MANTISSA), 0)
    out[doc[first], bucket[first]] = (zeros << MANTISSA | bits.astype(np.int64)).astype(np.uint16)
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One key for each band of each row; an empty register takes the next full one and its distance."""
    n = len(regs)
    full = regs != EMPTY
    twice = np.concatenate((full, full), axis=1)
    at = np.where(twice, np.arange(2 * M), 4 * M)
    nearest = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :M]
    nearest = np.minimum(nearest, 2 * M - 1)
    gap = nearest - np.arange(M)
    value = np.take_along_axis(regs, nearest % M, axis=1).astype(U64) | gap.astype(U64) << U64(16)
    value = value.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=U64), (n, BANDS)).copy()
    for r in range(ROWS):
        key = mix(key ^ value[:, :, r] * U64(0x9E3779B97F4A7C15))
    return key


def expected_collisions(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Registers that two disjoint sets of sizes n >= m share by chance."""
    ratio = (1.0 + n) / np.maximum(m, 1)
    phi = 4 * ((1.0 + n) / np.maximum(m, 1)) / (1 + ratio) ** 2
    return 0.169919487159739 * 2.0 ** (P - MANTISSA) * phi


def estimates(
    a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, near: int = NEAR
) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates, and the least estimate with which a pair stays a candidate."""
    used = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(-1), 1)
    same = ((a == b) & (a != EMPTY)).sum(-1)
    by_chance = np.minimum(expected_collisions(np.maximum(na, nb), np.minimum(na, nb)), same)
    share = near / OF
    return (same - by_chance) / used, share - MARGIN * np.sqrt(share * (1 - share) / used)


def similar_size(na: np.ndarray, nb: np.ndarray, near: int = NEAR) -> np.ndarray:
    return OF * np.minimum(na, nb) >= near * np.maximum(na, nb)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, k1, k2, regs``: set size, 128-bit set key, registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for at, to, block in blocks(batch, "text"):
                doc, h = shingle_sets(block, width)
                n = np.bincount(doc, minlength=to - at)
                keys = []
                for salt in (0x51, 0xA7):
                    total = np.zeros(len(h) + 1, U64)
                    np.cumsum(mix(h ^ U64(salt)), out=total[1:])
                    ends = np.cumsum(n)
                    keys.append((total[ends] - total[ends - n]).view(np.int64))
                regs = registers(doc, h, to - at)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, to - at).cast(pa.int64()),
                        pa.array(n, pa.int64()),
                        *(pa.array(k, pa.int64()) for k in keys),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    ["doc_id", "n", "k1", "k2", "regs"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long, regs binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, M)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            keys = band_keys(_matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.ravel().view(np.int64)),
                    pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)),
                    pa.array(np.repeat(batch.column(1).to_numpy(), BANDS)),
                ],
                ["key", "id", "n"],
            )


def _groups(batches: Iterator[pa.RecordBatch], schema: list[str]) -> tuple[pa.Table, np.ndarray]:
    """All rows of a partition by group, and the groups' bounds; the partition is small by construction."""
    table = pa.Table.from_batches(list(batches)) if batches else None
    table = table.sort_by([(c, "ascending") for c in schema])
    keys = [table.column(c).to_numpy() for c in schema if c != "id"]
    new = np.ones(len(table), bool)
    if len(table):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return table, np.append(np.flatnonzero(new), len(table))


def _pair_batch(a: list, b: list) -> pa.RecordBatch:
    x = np.concatenate(a) if a else np.zeros(0, np.int64)
    y = np.concatenate(b) if b else np.zeros(0, np.int64)
    pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _small_pairs(batches: Iterator[pa.RecordBatch], near: int = NEAR) -> Iterator[pa.RecordBatch]:
    """All pairs of groups of at most SMALL members, once a partition."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    table, bounds = _groups(held, ["key", "id"])
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    sizes, a, b = np.diff(bounds), [], []
    for size in np.unique(sizes):
        starts = bounds[:-1][sizes == size]
        for i in range(size):
            for j in range(i + 1, size):
                x, y = starts + i, starts + j
                fit = similar_size(n[x], n[y], near) & (ids[x] != ids[y])
                a.append(ids[x][fit])
                b.append(ids[y][fit])
    yield _pair_batch(a, b)


def _mixed_groups(table: pa.Table, bounds: np.ndarray, near: int) -> Iterator[tuple]:
    """For each block of members outside a group's largest component: start of the group, block, components,
    registers, plausible partners, and the estimates."""
    n, comp = table.column("n").to_numpy(), table.column("comp").to_numpy()
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        labels, at = np.unique(comp[start:end], return_inverse=True)
        if len(labels) < 2:
            continue
        regs = _matrix(table.column("regs").slice(start, end - start))
        own = n[start:end]
        minor = np.flatnonzero(at != np.bincount(at).argmax())
        step = max(1, (2 << 20) // ((end - start) * M))
        for lo in range(0, len(minor), step):
            x = minor[lo : lo + step]
            guess, least = estimates(regs[x][:, None, :], regs[None, :, :], own[x][:, None], own[None, :], near)
            good = (guess >= least) & similar_size(own[x][:, None], own[None, :], near) & (at[None, :] != at[x][:, None])
            yield start, x, minor, regs, good, guess


def _first_shared(bands: np.ndarray, x: np.ndarray, y: np.ndarray, key: int) -> np.ndarray:
    """Whether ``key`` is the first band that members x and y share: each pair counts in one group only."""
    one, two = bands[x], bands[y]
    return one[np.arange(len(x)), (one == two).argmax(axis=1)] == key


def _large_pairs(best: int, by: list[str], near: int):
    """Pairs of large groups: each member outside the largest component with its ``best`` partners by estimate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table, bounds = _groups(held, [*by, "id"])
        ids, key = table.column("id").to_numpy(), table.column("key").to_numpy()
        last, bands = -1, None
        for start, x, _, regs, good, guess in _mixed_groups(table, bounds, near):
            if start != last:
                last, bands = start, band_keys(regs).view(np.int64)
            order = np.argsort(np.where(good, -guess, 1.0), axis=1, kind="stable")[:, :best]
            row, col = np.nonzero(np.take_along_axis(good, order, axis=1))
            one, two = x[row], order[row, col]
            if len(by) == 1:
                mine = _first_shared(bands, one, two, key[start])
                row, one, two = row[mine], one[mine], two[mine]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[start + one]), pa.array(ids[start + two]), pa.array(guess[row, two])], ["x", "y", "guess"]
            )

    return run


def block_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(U64)) % U64(n)).astype(np.int64)


def _open_lists(n_blocks: int, near: int):
    """All partners between components of a mixed group, each pair in the first band it shares: ``block, id, partners``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table, bounds = _groups(held, ["key", "id"])
        ids, key = table.column("id").to_numpy(), table.column("key").to_numpy()
        last, bands = -1, None
        for start, x, minor, regs, good, _ in _mixed_groups(table, bounds, near):
            if start != last:
                last, bands = start, band_keys(regs).view(np.int64)
                outside = np.zeros(len(regs), bool)
                outside[minor] = True
            row, col = np.nonzero(good & ~(outside[None, :] & (np.arange(len(regs))[None, :] < x[:, None])))
            for lo in range(0, len(row), 1 << 16):
                r, c = row[lo : lo + (1 << 16)], col[lo : lo + (1 << 16)]
                mine = _first_shared(bands, x[r], c, key[start])
                r, c = ids[start + x[r[mine]]], ids[start + c[mine]]
                block = block_of(c, n_blocks)
                order = np.lexsort((c, r, block))
                r, c, block = r[order], c[order], block[order]
                cut = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (block[1:] != block[:-1]))) if len(r) else []
                parts = np.split(c, cut[1:]) if len(r) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block[cut] if len(r) else [], pa.int64()),
                        pa.array(r[cut] if len(r) else [], pa.int64()),
                        pa.array([p.tobytes() for p in parts], pa.binary()),
                    ],
                    ["block", "id", "partners"],
                )

    return run


def alike(x: np.ndarray, y: np.ndarray, near: int = NEAR) -> bool:
    both = np.concatenate((x, y))
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return OF * inter >= near * (len(both) - inter)


def _confirm_block(asks: pa.Table, held: pa.Table, near: int = NEAR) -> pa.Table:
    sets = dict(zip(held.column("id").to_pylist(), held.column("hashes").to_pylist(), strict=True))
    a, b = [], []
    for one, partners, own in zip(*(asks.column(c).to_pylist() for c in ("id", "partners", "hashes")), strict=True):
        own = np.frombuffer(own, U64)
        for other in np.frombuffer(b"".join(partners), np.int64).tolist():
            if alike(own, np.frombuffer(sets[other], U64), near):
                a.append(min(one, other))
                b.append(max(one, other))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _confirm(batches: Iterator[pa.RecordBatch], near: int = NEAR) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        keep = [alike(np.frombuffer(x, U64), np.frombuffer(y, U64), near) for x, y in pairs]
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, to, block in blocks(batch, "text"):
                doc, h = shingle_sets(block, width)
                ends = np.cumsum(np.bincount(doc, minlength=to - at))
                parts = np.split(h, ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, to - at), pa.array([p.tobytes() for p in parts], pa.binary())], ["id", "hashes"]
                )

    return run


class NearDuplicates:
    """One run: the classes, their candidates, and the links confirmed so far."""

    def __init__(self, docs: DataFrame, width: int = 3, near: int = NEAR):
        self.docs, self.width, self.near = docs, width, near
        self.spark = docs.sparkSession
        self.all = staged(sketches(docs, width), "near-sketches")
        linked = self.all.where("n > 0 AND doc_id IS NOT NULL")
        self.classes = linked.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("id"), F.min("regs").alias("regs"))
        self.classes = staged(self.classes, "near-classes")
        self.tasks = max(16, -(-self.classes.count() * BANDS // KEYS_A_TASK))
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None

    def labelled(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """Adds the component of ``key``: itself while it has no link."""
        if self.roots is None:
            return rows.withColumn(name, F.col(key))
        roots = self.roots.select(F.col("id").alias(key), F.col("component").alias(name))
        return rows.join(roots, key, "left").withColumn(name, F.coalesce(name, key))

    def confirm(self, pairs: DataFrame) -> None:
        """Check ``pairs`` (staged) on the full sets and renew the components."""
        ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
        ids = staged(ids.coalesce(self.tasks), "near-ids")
        sets = with_ids(self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids)
        sets = staged(sets.mapInArrow(_sets(self.width), "id long, hashes binary"), "near-sets")
        x = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x"))
        y = sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
        tasks = max(16, -(-ids.count() // SETS_A_TASK))
        found = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").coalesce(tasks)
        found = staged(found.mapInArrow(partial(_confirm, near=self.near), "a long, b long").distinct().coalesce(tasks), "near-links")
        self.linked(found)

    def linked(self, found: DataFrame) -> None:
        self.links = found if self.links is None else self.links.unionByName(found)
        self.roots = staged(connected_components(self.links, "a", "b", self.tasks).coalesce(self.tasks), "near-roots")

    def settle(self, pairs: DataFrame) -> None:
        """Confirm ``pairs`` (with ``guess``): first each class's likeliest partner, then what still joins two components."""
        ends = pairs.select("a", "b", F.col("a").alias("x"), "guess").unionByName(
            pairs.select("a", "b", F.col("b").alias("x"), "guess")
        )
        first = ends.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("guess", "a", "b")).alias("p"))
        first = staged(first.select("p.a", "p.b").distinct().coalesce(self.tasks), "near-chosen")
        self.confirm(first)
        rest = self.apart(pairs.select("a", "b")).join(first, ["a", "b"], "left_anti")
        rest = staged(rest, "near-chosen")
        if not rest.isEmpty():
            self.confirm(rest)

    def apart(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are in different components."""
        return self.labelled(self.labelled(pairs, "a", "ca"), "b", "cb").where("ca <> cb").select("a", "b")

    def members(self, large: DataFrame, by: list[str]) -> DataFrame:
        """Rows of the groups that hold more than one component, with components and registers."""
        rows = self.labelled(large, "id", "comp")
        mixed = rows.groupBy(by).agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p <> q").select(by)
        rows = rows.join(mixed, by, "left_semi").join(self.classes.select("id", "regs"), "id")
        return rows.select(*by, "id", "n", "comp", "regs")

    def run(self) -> DataFrame:
        width = shuffle_width(self.spark)
        keys = self.classes.select("id", "n", "regs").mapInArrow(_bands, "key long, id long, n long")
        crowd = keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        shared = staged(keys.join(crowd, "key").coalesce(self.tasks), "near-bands")
        pairs = shared.where(F.col("m") <= SMALL).drop("m").repartition(width, "key")
        pairs = pairs.mapInArrow(partial(_small_pairs, near=self.near), "a long, b long").distinct()
        pairs = staged(self.guessed(pairs, self.classes.select("id", "n", "regs")), "near-pairs")
        if not pairs.isEmpty():
            self.settle(pairs)
        large = shared.where(F.col("m") > SMALL).withColumn(
            "salt", F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / CHUNK).cast("long"))
        )
        large = staged(large, "near-large")
        if not large.isEmpty():
            # near copies share many bands: a few join most components, and exhaust() takes all that are left
            few = large.where(F.pmod(F.xxhash64("key"), F.lit(FIRST_BANDS)) == 0)
            for by, best in ((["key", "salt"], 1), (["key"], 4)):
                rows = self.members(few, by).repartition(width, *by)
                found = rows.mapInArrow(_large_pairs(best, by, self.near), "x long, y long, guess double")
                likely = Window.partitionBy("x").orderBy(F.desc("guess"), "y")
                found = found.withColumn("r", F.row_number().over(likely)).where(F.col("r") <= best)
                found = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
                found = staged(found, "near-chosen")
                if not found.isEmpty():
                    self.confirm(found)
            self.exhaust(large)
        every = self.all.join(self.classes.select("k1", "k2", "n", "id"), ["k1", "k2", "n"], "left")
        found = self.labelled(every, "id", "component_id")
        shown = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
        return found.select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            shown.alias("component_id"),
            F.coalesce(shown == F.col("doc_id"), F.lit(True)).alias("kept"),
        )

    def exhaust(self, large: DataFrame) -> None:
        """Confirm every pair that large groups still leave between components, block against block.

        A class outside its group's largest component lists its remaining partners; the lists travel by
        block of partners with one copy of the set for each block, never as one row a pair.
        """
        rows = staged(self.members(large, ["key"]), "near-open")
        ids = staged(rows.select(F.col("id").alias("doc_id")).distinct().coalesce(self.tasks), "near-ids")
        count = ids.count()
        if not count:
            return
        blocks_ = -(-count // BLOCK_SETS)
        lists = rows.repartition(shuffle_width(self.spark), "key").mapInArrow(
            _open_lists(blocks_, self.near), "block long, id long, partners binary"
        )
        lists = staged(lists, "near-lists")
        sets = with_ids(self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ids)
        sets = staged(sets.mapInArrow(_sets(self.width), "id long, hashes binary"), "near-sets")
        lists = lists.groupBy("block", "id").agg(F.collect_list("partners").alias("partners"))  # at most one a band
        asks = lists.join(sets, "id").groupBy("block")

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = block_of(batch.column(0).to_numpy(), blocks_)
                yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], ["block", "id", "hashes"])

        held = sets.mapInArrow(numbered, "block long, id long, hashes binary").groupBy("block")
        near = self.near

        def confirmed(asks: pa.Table, held: pa.Table) -> pa.Table:
            return _confirm_block(asks, held, near)

        found = asks.cogroup(held).applyInArrow(confirmed, "a long, b long").distinct()
        found = staged(found.coalesce(self.tasks), "near-links")
        if not found.isEmpty():
            self.linked(found)

    def guessed(self, pairs: DataFrame, regs: DataFrame) -> DataFrame:
        """Adds the estimate ``guess`` and drops pairs far below the limit."""
        near = self.near
        x = regs.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
        y = regs.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                    guess, least = estimates(_matrix(batch.column(4)), _matrix(batch.column(5)), na, nb, near)
                    keep = pa.array((guess >= least) & similar_size(na, nb, near))
                    out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(guess)], ["a", "b", "guess"])
                    yield out.filter(keep)

        both = pairs.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ra", "rb").coalesce(self.tasks)
        return both.mapInArrow(run, "a long, b long, guess double")


def near_duplicates(docs: DataFrame, width: int = 3, near: int = NEAR) -> DataFrame:
    """One row a document: ``doc_id, n_shingles, component_id, kept``; links from ``near`` percent similarity on."""
    return NearDuplicates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, near).run()


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
