"""Nearest neighbours and near pairs of vectors: an inverted file of cells, its search, and blockwise exact joins.

Vectors are compared by cosine. Centroids are trained on a bounded sample (``SAMPLE`` rows, the smallest hashes of the
key); every vector is placed in the cell of its nearest centroid, and a cell with more than ``BLOCK`` vectors is dealt
to several blocks, so that one common vector doesn't fill one task. A block is one row: its keys and their unit vectors
as a matrix. Queries and partner blocks travel to blocks, never the other way round by broadcast.

Vectors that are null, zero, hold a null or non-finite number, or have another length than the sample's are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.staging import staged

SAMPLE, MOST_CELLS, BLOCK = 20_000, 1024, 2048
#: Of ``near_pairs``: a block travels to at most ``GROUPS`` groups of blocks, until a group would pass ``GROUP_ROWS`` vectors.
GROUPS, GROUP_ROWS = 24, 65_536
#: Queries whose true neighbours tell how many cells a wanted recall needs.
TUNING_QUERIES = 64
ROUNDING = 1e-9


def matrix_of(lists: pa.ListArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of usable vectors, and these as unit vectors (float64)."""
    lists = lists.cast(pa.large_list(pa.float64()))
    offsets = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    rows = np.flatnonzero(np.array(lists.is_valid(), bool) & (np.diff(offsets) == length))
    values = lists.values.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    found = values[offsets[rows][:, None] + np.arange(length)] if len(rows) else np.zeros((0, length))
    size = np.sqrt((found * found).sum(axis=1))
    good = np.isfinite(size) & (size > 0)
    return rows[good], found[good] / size[good, None]


def spherical_means(unit: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Centroids of a sample: k-means by cosine from evenly spaced rows; empty cells stay where they were."""
    centre = unit[np.linspace(0, len(unit) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        at = np.concatenate([(unit[i : i + 4096] @ centre.T).argmax(axis=1) for i in range(0, len(unit), 4096)])
        total = np.zeros_like(centre)
        np.add.at(total, at, unit)
        size = np.linalg.norm(total, axis=1)
        centre[size > 0] = total[size > 0] / size[size > 0, None]
    return centre


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


@dataclass
class Cells:
    """Centroids, the widest angle of a cell's vectors, the number of its blocks (numbered from ``first``) and of its vectors."""

    centre: np.ndarray
    radius: np.ndarray
    blocks: np.ndarray
    size: np.ndarray | None = None

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(self.blocks) - self.blocks

    def reach(self, unit: np.ndarray) -> np.ndarray:
        """``[vector, cell]``: the greatest cosine that a vector of the cell can have."""
        return np.cos(np.maximum(angle(unit @ self.centre.T) - self.radius - ROUNDING, 0))


def trained(vectors: DataFrame, key: str, column: str, cells: int | None = None) -> np.ndarray:
    """Centroids from a bounded sample; about one cell for the square root of the rows."""
    rows = vectors.select(key, F.col(column).alias("_v")).where(F.size("_v") > 0)
    some = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE).select("_v").toArrow()
    if not len(some):
        return np.zeros((0, 0))
    lists = some.column(0).combine_chunks()
    unit = matrix_of(lists, len(lists[0]))[1]
    wanted = cells or int(min(MOST_CELLS, max(1, vectors.count() ** 0.5)))
    return spherical_means(unit, max(1, min(wanted, len(unit) // 4)))


def placed(vectors: DataFrame, key: str, column: str, centre: np.ndarray) -> tuple[DataFrame, Cells]:
    """Staged ``key, _v, _cell`` of the usable vectors, and the cells."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = matrix_of(batch.column(1), centre.shape[1])
            likeness = unit @ centre.T
            cell = likeness.argmax(axis=1) if len(unit) else np.zeros(0, np.int64)
            away = angle(likeness[np.arange(len(unit)), cell])
            flat = pa.array(np.ascontiguousarray(unit).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, unit.shape[1]), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), lists, pa.array(cell, pa.int32()), pa.array(away)],
                [key, "_v", "_cell", "_away"],
            )

    found = vectors.select(key, column).mapInArrow(run, f"`{key}` {kind}, _v array<double>, _cell int, _away double")
    found = staged(found, "vector-cells")
    radius, size = np.zeros(len(centre)), np.zeros(len(centre), np.int64)
    for r in found.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_away").alias("away")).collect():  # no more than cells
        radius[r["_cell"]], size[r["_cell"]] = r["away"], r["n"]
    return found, Cells(centre, radius, -(-size // BLOCK), size)


def blocked(rows: DataFrame, key: str, cells: Cells) -> DataFrame:
    """``cell, block, keys, vectors`` (a float64 matrix) of placed rows."""
    first, blocks = ([int(x) for x in v] for v in (cells.first, cells.blocks))
    numbers = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(max(b, 1)).alias("b")) for a, b in zip(first, blocks, strict=True)])
    own = numbers[F.col("_cell")]
    block = own["a"] + F.pmod(F.xxhash64(key), own["b"]).cast("int")
    kind = rows.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        keys, lists = table[key].combine_chunks(), table["_v"].combine_chunks()
        keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.table({"cell": table["_cell"][:1], "block": table["_block"][:1], "keys": keys, "vectors": [lists.flatten().to_numpy().tobytes()]})

    return rows.withColumn("_block", block).groupBy("_block").applyInArrow(run, f"cell int, block int, keys array<{kind}>, vectors binary")


def opened(keys: pa.ListScalar, raw: bytes) -> tuple[pa.Array, np.ndarray]:
    keys = keys.values
    return keys, np.frombuffer(raw, np.float64).reshape(len(keys), -1)


class CellIndex:
    """An inverted file: blocks as a Parquet table with a folder for each cell, beside its centroids."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = sorted(spark.read.parquet(f"{self.path}/cells").collect(), key=lambda r: r["cell"])  # no more than MOST_CELLS
        self.cells = Cells(np.array([r["centre"] for r in rows]), np.array([r["radius"] for r in rows]), np.array([r["blocks"] for r in rows], np.int64))
        self.blocks = spark.read.parquet(f"{self.path}/blocks")
        self.kind = self.blocks.schema["keys"].dataType.elementType.simpleString()

    @classmethod
    def build(cls, vectors: DataFrame, key: str, column: str, path: str, cells: int | None = None) -> CellIndex:
        """Every usable vector is indexed; only the centroids come from a sample."""
        spark, path = vectors.sparkSession, path.rstrip("/")
        rows, found = placed(vectors, key, column, trained(vectors, key, column, cells))
        blocked(rows, key, found).write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
        table = [(i, c.tolist(), float(r), int(b)) for i, (c, r, b) in enumerate(zip(found.centre, found.radius, found.blocks, strict=True))]
        spark.createDataFrame(table, "cell int, centre array<double>, radius double, blocks long").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return cls(spark, path)

    def _routed(self, queries: DataFrame, query: str, column: str, cells_of) -> DataFrame:
        """``block, cell, query, vector``: each query once for each block of the cells that ``cells_of`` picks for it."""
        kind, first, blocks = queries.schema[query].dataType.simpleString(), self.cells.first, self.cells.blocks
        length = self.cells.centre.shape[1]
        extra = [c for c in queries.columns if c == "_floor"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 512):
                    part = batch.slice(at, 512)
                    rows, unit = matrix_of(part.column(1), length)
                    floor = part.column(2).to_numpy()[rows] if extra else None
                    row, cell = np.nonzero(cells_of(unit, floor))
                    many = blocks[cell]
                    row, cell = np.repeat(row, many), np.repeat(cell, many)
                    block = first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(many) - many, many)
                    vectors = [v.tobytes() for v in unit]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(block, pa.int32()),
                            pa.array(cell, pa.int32()),
                            part.column(0).take(pa.array(rows[row])),
                            pa.array([vectors[i] for i in row.tolist()], pa.binary()),
                        ],
                        ["block", "cell", "query", "vector"],
                    )

        chosen = queries.select(query, column, *extra)
        return chosen.mapInArrow(run, f"block int, cell int, query {kind}, vector binary")

    def _scored(self, routed: DataFrame, k: int) -> DataFrame:
        """``query, key, cell, score``: the k best of each block for each query, of cells that some query needs."""
        routed = staged(routed, "routed-queries")
        needed = [r["cell"] for r in routed.select("cell").distinct().collect()]  # no more than cells; prunes folders
        kind = routed.schema["query"].dataType.simpleString()

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out = {"query": [], "key": [], "cell": [], "score": []}
            if len(left) and len(right):
                keys, matrix = opened(right["keys"][0], right["vectors"][0].as_py())
                for at in range(0, len(left), 1024):
                    part = left.slice(at, 1024)
                    asked = np.frombuffer(b"".join(part["vector"].to_pylist()), np.float64).reshape(len(part), -1)
                    score = asked @ matrix.T
                    most = min(k, len(keys))
                    # all that tie with the k-th best stay: the key decides between them later
                    floor = -np.partition(-score, most - 1, axis=1)[:, most - 1 : most]
                    row, column = np.nonzero(score >= floor - ROUNDING)
                    out["query"].append(part["query"].combine_chunks().take(pa.array(row)))
                    out["key"].append(keys.take(pa.array(column)))
                    out["cell"].append(pa.array(np.full(len(row), right["cell"][0].as_py()), pa.int32()))
                    out["score"].append(pa.array(score[row, column]))
            types = {"query": left["query"].type, "key": right["keys"].type.value_type, "cell": pa.int32(), "score": pa.float64()}
            return pa.table({c: pa.chunked_array(v, types[c]) for c, v in out.items()})

        blocks = self.blocks.where(F.col("cell").isin(needed)) if needed else self.blocks.where("false")
        both = routed.groupBy("block").cogroup(blocks.select("block", "cell", "keys", "vectors").groupBy("block"))
        return both.applyInArrow(run, f"query {kind}, key {self.kind}, cell int, score double")

    @staticmethod
    def _best(scored: DataFrame, k: int) -> DataFrame:
        """``query, key, cell, score, rank`` (from 0); scores are rounded so that ties are ties everywhere."""
        rows = scored.withColumn("score", F.round("score", 9))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "key")
        return rows.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank") < k)

    def search(self, queries: DataFrame, query: str, column: str, k: int, probes: int) -> DataFrame:
        """``query, key, score, rank`` of the k best in each query's ``probes`` nearest cells."""
        centre, used = self.cells.centre, self.cells.blocks > 0

        def nearest(unit: np.ndarray, _) -> np.ndarray:
            likeness = np.where(used, unit @ centre.T, -np.inf)
            order = np.argsort(-likeness, axis=1, kind="stable")[:, :probes]
            out = np.zeros(likeness.shape, bool)
            np.put_along_axis(out, order, True, axis=1)
            return out & used

        return self._best(self._scored(self._routed(queries, query, column, nearest), k), k).drop("cell")

    def search_exact(self, queries: DataFrame, query: str, column: str, k: int, probes: int = 4) -> DataFrame:
        """The same over all vectors: then only cells that can hold a better one than a query's k-th are looked at."""
        first = staged(self.search(queries, query, column, k, probes), "first-neighbours")
        floors = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-2.0).alias("_floor"))
        asked = queries.select(F.col(query).alias("query"), F.col(column).alias("_q"))
        asked = asked.join(floors, "query", "left").select("query", "_q", F.coalesce("_floor", F.lit(-2.0)).alias("_floor"))
        cells, used = self.cells, self.cells.blocks > 0

        def open_cells(unit: np.ndarray, floor: np.ndarray) -> np.ndarray:
            return (cells.reach(unit) >= floor[:, None] - 2 * ROUNDING) & used

        return self._best(self._scored(self._routed(asked, "query", "_q", open_cells), k), k).drop("cell")

    def probes_for(self, queries: DataFrame, query: str, column: str, k: int, recall: float) -> int:
        """Least number of cells that hold the wanted share of the true neighbours of ``TUNING_QUERIES`` queries."""
        some = staged(queries.orderBy(F.xxhash64(query), query).limit(TUNING_QUERIES).select(query, column), "tuning-queries")
        used = self.cells.blocks > 0
        every = self._routed(some, query, column, lambda unit, _: np.broadcast_to(used, (len(unit), len(used))))
        truth = self._best(self._scored(every, k), k).select("query", "cell").toPandas()  # k rows a query
        if truth.empty:
            return 1
        asked = some.toArrow()
        rows, unit = matrix_of(asked.column(1).combine_chunks(), self.cells.centre.shape[1])
        likeness = np.where(used, unit @ self.cells.centre.T, -np.inf)
        place = np.empty(likeness.shape, np.int64)
        np.put_along_axis(place, np.argsort(-likeness, axis=1, kind="stable"), np.arange(len(used))[None], axis=1)
        number = {q: i for i, q in enumerate(asked.column(0).take(pa.array(rows)).to_pylist())}
        needed = np.sort([place[number[q], c] for q, c in zip(truth["query"], truth["cell"], strict=True)])
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def groups_of(cells: Cells, order: np.ndarray) -> np.ndarray:
    """A group for each cell: neighbours in ``order``, of about as many vectors each."""
    every = int(cells.size.sum())
    groups = max(min(GROUPS, -(-every // BLOCK)), -(-every // GROUP_ROWS), 1)
    before = np.cumsum(cells.size[order]) - cells.size[order]
    out = np.empty(len(order), np.int64)
    out[order] = before * groups // max(every, 1)
    return out


def meeting_cells(cells: Cells, least: float) -> np.ndarray:
    """``[cell, cell]``: whether two vectors of these cells can have a cosine of ``least``."""
    gap = angle(cells.centre @ cells.centre.T) - cells.radius[:, None] - cells.radius[None]
    used = cells.blocks > 0
    return (gap <= np.arccos(min(1.0, max(-1.0, least))) + ROUNDING) & used[:, None] & used[None]


def dealt_blocks(rows: DataFrame, key: str, cells: Cells, meets: np.ndarray, group: np.ndarray) -> DataFrame:
    """``low, high, cell, block, keys, vectors``: each block once for each group that holds a cell it meets."""
    kind = rows.schema[key].dataType.simpleString()
    near = np.zeros((len(group), int(group.max()) + 1), bool)
    for g in range(near.shape[1]):
        near[:, g] = meets[:, group == g].any(axis=1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                cell = batch.column(0)[i].as_py()
                other = np.flatnonzero(near[cell])
                same = [batch.column(c).slice(i, 1).take(pa.array(np.zeros(len(other), np.int64))) for c in range(4)]
                low, high = np.minimum(other, group[cell]), np.maximum(other, group[cell])
                yield pa.RecordBatch.from_arrays([pa.array(low, pa.int32()), pa.array(high, pa.int32()), *same], ["low", "high", "cell", "block", "keys", "vectors"])

    return blocked(rows, key, cells).mapInArrow(deal, f"low int, high int, cell int, block int, keys array<{kind}>, vectors binary")


def near_pairs(vectors: DataFrame, key: str, column: str, least: float) -> DataFrame:
    """``a < b, similarity``: every pair of a cosine of at least ``least``; equal vectors meet once (see ``equal_vectors``).

    Blocks meet only where the angle between their cells' centroids, less both cells' radii, can still give ``least``.
    They travel in groups of neighbouring cells, and two groups are one task: a block is copied once for a group that it
    meets, not for each block in it, so what is shuffled grows with the vectors up to ``GROUPS * GROUP_ROWS`` of them.
    Two blocks that meet are compared in two steps: the first part of rotated vectors (their heaviest directions) and
    the norms of the rest bound the cosine from above, and only pairs that the bound lets through are computed in full.
    """
    centre = trained(vectors, key, column)
    kind = vectors.schema[key].dataType.simpleString()
    out = f"a {kind}, b {kind}, similarity double"
    if not len(centre):
        return vectors.sparkSession.createDataFrame([], out)
    rows, cells = placed(vectors, key, column, centre)
    rotation, prefix = heavy_directions(rows, centre.shape[1])
    meets = meeting_cells(cells, least)
    group = groups_of(cells, np.argsort(cells.centre @ rotation[:, 0], kind="stable"))

    def compare(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        cell, block = table["cell"].to_numpy(), table["block"].to_numpy()
        sides = [opened(table["keys"][i], table["vectors"][i].as_py()) for i in range(len(table))]
        turned = [rotated(v, rotation, prefix) for _, v in sides]
        found = [(sides[0][0].slice(0, 0), sides[0][0].slice(0, 0), np.zeros(0))]
        for x in np.flatnonzero(group[cell] == low).tolist():
            for y in np.flatnonzero((group[cell] == high) & meets[cell[x]][cell]).tolist():
                if low == high and block[x] > block[y]:
                    continue
                i, j = bounded(turned[x], turned[y], least)
                if block[x] == block[y]:
                    i, j = i[i < j], j[i < j]
                cosine = (sides[x][1][i] * sides[y][1][j]).sum(axis=1)
                good = cosine >= least - ROUNDING
                found.append((sides[x][0].take(pa.array(i[good])), sides[y][0].take(pa.array(j[good])), cosine[good]))
        a, b, cosine = zip(*found, strict=True)
        return pa.table({"a": pa.chunked_array(a), "b": pa.chunked_array(b), "similarity": np.concatenate(cosine)})

    found = dealt_blocks(rows, key, cells, meets, group).groupBy("low", "high").applyInArrow(compare, out)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def heavy_directions(rows: DataFrame, length: int) -> tuple[np.ndarray, int]:
    """A rotation to directions of falling weight (from a bounded sample; any rotation gives right results), and its cut."""
    some = rows.orderBy(F.xxhash64("_v")).limit(SAMPLE // 4).select("_v").toArrow()
    sample = matrix_of(some.column(0).combine_chunks(), length)[1] if len(some) else np.zeros((0, length))
    _, directions = np.linalg.eigh(sample.T @ sample)
    return directions[:, ::-1].copy(), max(1, 3 * length // 4)


def rotated(x: np.ndarray, rotation: np.ndarray, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """The first directions of rotated vectors, and the norms of the rest."""
    p = x @ rotation
    return np.ascontiguousarray(p[:, :prefix]), np.sqrt((p[:, prefix:] ** 2).sum(axis=1))


def bounded(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ``rotated`` vectors whose cosine can reach ``least``."""
    return np.nonzero(x[0] @ y[0].T + np.outer(x[1], y[1]) >= least - ROUNDING)


def surviving(x: np.ndarray, y: np.ndarray, rotation: np.ndarray, prefix: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose cosine can reach ``least`` by their first directions and the norms of the rest."""
    return bounded(rotated(x, rotation, prefix), rotated(y, rotation, prefix), least)


def equal_vectors(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """``key, class``: the least key of all rows with the very same vector."""
    same = vectors.groupBy(column).agg(F.min(key).alias("class"))
    return vectors.select(key, column).join(same, column).select(key, "class")


# Near groups: bands of signs, verified.
BAND_BITS, BAND_RECALL, MOST_BANDS = 16, 0.98, 256


def bands_for(least: float) -> int:
    """Bands of ``BAND_BITS`` signs of random projections in which a pair of that cosine meets with ``BAND_RECALL``."""
    same = 1 - np.arccos(least) / np.pi
    bands = int(np.ceil(np.log(1 - BAND_RECALL) / np.log1p(-(same**BAND_BITS))))
    if bands > MOST_BANDS:
        raise ValueError(f"a cosine of {least} needs {bands} bands: near_pairs compares all blocks instead")
    return bands


def signed(vectors: DataFrame, key: str, column: str, length: int, bands: int, seed: int) -> DataFrame:
    """``key, _v`` (unit vector), ``_bands`` (a key for each band), both as bytes."""
    projection = np.random.default_rng(seed).standard_normal((length, bands * BAND_BITS))
    weight = 1 << np.arange(BAND_BITS)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, unit = matrix_of(batch.column(1), length)
            signs = (unit @ projection > 0).reshape(len(unit), bands, BAND_BITS)
            keys = signs @ weight + (np.arange(bands) << BAND_BITS)
            columns = [[v.tobytes() for v in unit], [k.astype(np.int64).tobytes() for k in keys]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), *[pa.array(c, pa.binary()) for c in columns], pa.array(list(keys), pa.list_(pa.int64()))],
                [key, "_v", "_bands", "_keys"],
            )

    return staged(vectors.select(key, column).mapInArrow(run, f"`{key}` {kind}, _v binary, _bands binary, _keys array<long>"), "signed-vectors")


def roots_of(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Least number in each number's component of the links ``i, j``."""
    root = np.arange(n)
    while len(i):
        least = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def near_groups(vectors: DataFrame, key: str, column: str, least: float, seed: int = 1) -> DataFrame:
    """``key, class_id, links`` of every row: the least key reachable over near vectors, and how many different vectors are near.

    Equal vectors are one from the start. Vectors meet in bands of signs (a link of the least cosine is found with a
    chance of ``BAND_RECALL``, closer ones nearly always) and are compared in full. A band's group is cut into blocks that
    meet block by block; of a pair that meets in several bands only the first counts. Rows without a usable vector are
    their own class.
    """
    from granary.operators.components import connected_components

    kind = vectors.schema[key].dataType.simpleString()
    members = staged(equal_vectors(vectors.where(F.col(column).isNotNull()), key, column), "equal-vectors")
    heads = vectors.join(members.where(F.col(key) == F.col("class")).select(key), key, "left_semi").dropDuplicates([key])
    first = heads.where(F.size(column) > 0).orderBy(F.xxhash64(key), key).select(F.size(column).alias("n")).first()
    length = first["n"] if first else 1
    rows = signed(heads, key, column, length, bands_for(least), seed)
    places = rows.select(key, F.explode("_keys").alias("_band"))
    sizes = staged(places.groupBy("_band").agg(F.count("*").alias("_n")).where("_n > 1"), "band-sizes")
    parts = F.ceil(F.col("_n") / BLOCK).cast("int")
    met = places.join(sizes, "_band").withColumn("_parts", parts).withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda o: F.struct(F.least("_part", o).alias("low"), F.greatest("_part", o).alias("high")))
    dealt = met.select(key, "_band", "_part", F.explode(others).alias("_at")).select(key, "_band", "_part", "_at.*")
    dealt = dealt.join(rows.select(key, "_v", "_bands"), key)

    def compare(table: pa.Table) -> pa.Table:
        keys = table[key].combine_chunks()
        unit = np.frombuffer(b"".join(table["_v"].to_pylist()), np.float64).reshape(len(keys), -1)
        bands = np.frombuffer(b"".join(table["_bands"].to_pylist()), np.int64).reshape(len(keys), -1)
        part, low, high = table["_part"].to_numpy(), table["low"][0].as_py(), table["high"][0].as_py()
        here = int(np.flatnonzero(bands[0] == table["_band"][0].as_py())[0])
        x, y = np.flatnonzero(part == low), np.flatnonzero(part == high)
        links = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(x), 256):
            i, j = np.nonzero(unit[x[at : at + 256]] @ unit[y].T >= least - ROUNDING)
            i, j = x[at + i], y[j]
            if low == high:
                i, j = i[i < j], j[i < j]
            new = (bands[i, :here] != bands[j, :here]).all(axis=1)
            links.append(np.stack((i[new], j[new])))
        i, j = np.concatenate(links, axis=1)
        count = np.bincount(i, minlength=len(keys)) + np.bincount(j, minlength=len(keys))
        linked = np.flatnonzero(count)
        root = roots_of(i, j, len(keys))[linked]
        return pa.table({"a": keys.take(pa.array(linked)), "b": keys.take(pa.array(root)), "links": count[linked]})

    found = staged(dealt.groupBy("_band", "low", "high").applyInArrow(compare, f"a {kind}, b {kind}, links long"), "near-links")
    counts = found.groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    group = connected_components(found.where("a <> b").select("a", "b"), "a", "b").withColumnsRenamed({"id": "class", "component": "class_id"})
    known = members.join(counts, "class", "left").join(group, "class", "left")
    known = known.select(key, F.coalesce("class_id", "class").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    rest = vectors.where(F.col(column).isNull()).select(key, F.col(key).alias("class_id"), F.lit(0).cast("long").alias("links"))
    return known.unionByName(rest)
