"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 3).

The mix is counted in words. Sources get blocks of ``BLOCK`` words by highest quotients, each
source deals its blocks to its shards in the same way, and a shard picks blocks of its documents
in a seeded order until its quota is met (whole passes first, so no document is taken more than
twice). What the blocks leave of a source's target is settled by one partial block.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its own,
after all others; an empty table gives an empty mix; rows that share a ``doc_id`` are separate
documents; further columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import text_of, word_array
from .staging import read_table, staged

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BLOCK = 64
SHARD_DOCS = 16384
SEED = 20_240_601


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Seats by highest quotients ``weight / (2 * held + 1)``, none above ``most``; ties go to the first."""
    weights, most = np.asarray(weights, float), np.asarray(most, np.int64)
    held = np.zeros(len(weights), np.int64)
    seats = int(min(seats, most[weights > 0].sum()))
    total = weights.sum()
    if seats <= 0 or total <= 0:
        return held
    # What everyone holds before the last rounds: a divisor a little too large gives too few seats.
    divisor = total / seats * (1 + len(weights) / (2.0 * seats))
    held = np.minimum(np.maximum(np.floor(weights / divisor - 0.5), 0).astype(np.int64), most)
    while held.sum() > seats:
        divisor *= 2
        held = np.minimum(np.maximum(np.floor(weights / divisor - 0.5), 0).astype(np.int64), most)
    queue = [(-w / (2 * h + 1), i) for i, (w, h, m) in enumerate(zip(weights, held, most, strict=True)) if w > 0 and h < m]
    heapq.heapify(queue)
    for _ in range(seats - int(held.sum())):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        held[i] += 1
        if held[i] < most[i]:
            heapq.heappush(queue, (-weights[i] / (2 * held[i] + 1), i))
    return held


def with_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Adds ``target``: the share by weight, none above ``MOST`` times the size, the excess reshared.

    ``sources`` has one row a source (``source``, ``source_size``), so its windows see no documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(MOST))
    out = sources.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", cap)
    everything = Window.partitionBy()
    low_first = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(low_first), F.lit(0.0))
    others = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(low_first), F.lit(0.0))
    out = out.withColumn("_level", left / others)
    # The water level: the first source, by cap per weight, that the level does not fill.
    level = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "_level")))
    level = level.over(everything)["_level"]
    target = F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))
    return out.withColumn("target", target).drop("_level")


def _source_quotas(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    table = pd.concat(list(frames))
    if len(table):
        table = table.sort_values("rank")
        blocks = int(round(table["target"].sum() / BLOCK))
        most = np.floor(table["cap"].to_numpy() / BLOCK).astype(np.int64)
        table["blocks"] = sainte_lague(table["target"].to_numpy(), blocks, most)
        yield table


def _shard_quotas(table: pd.DataFrame) -> pd.DataFrame:
    """Words that each shard of one source gives."""
    table = table.sort_values("shard").reset_index(drop=True)
    size = table["shard_size"].to_numpy(np.int64)
    words = int(round(float(table["target"].iloc[0])))
    blocks = sainte_lague(size.astype(float), int(table["blocks"].iloc[0]), MOST * size // BLOCK)
    quota = np.minimum(blocks * BLOCK, MOST * size)
    over = int(quota.sum()) - words
    if over > 0:  # blocks rounded up: take back from the last shards
        back = np.minimum(quota[::-1], np.maximum(0, over - np.concatenate(([0], np.cumsum(quota[::-1])[:-1]))))
        quota = quota - back[::-1]
    elif over < 0:
        room = MOST * size - quota
        quota = quota + np.minimum(room, np.maximum(0, -over - np.concatenate(([0], np.cumsum(room)[:-1]))))
    table["quota"] = quota
    return table


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    seed: int = SEED,
    row_id: str | None = None,
) -> DataFrame:
    """One row a document: ``row_id, doc_id, source, size, source_size, target, taken, passes, spans``.

    ``taken`` counts words, repeats included: ``passes`` times the whole document, and once more the words of
    ``spans`` (``start``, ``length``, ascending), the blocks that the seeded order picked.
    ``row_id`` names a column of distinct row numbers (long); without it the rows are numbered here.
    """
    sized = docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.size(word_array(text_of())).cast("long").alias("size"),
        (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("row_id"),
        F.xxhash64(F.lit(seed), "doc_id", "text").alias("_deal"),
    )
    # rows that share an id part by their text, rows without one by their number as well
    deal = F.when(F.col("doc_id").isNull(), F.xxhash64("_deal", "row_id")).otherwise(F.col("_deal"))
    sized = staged(sized.withColumn("_deal", deal), "mix-sizes")
    shards = max(1, -(-sized.count() // SHARD_DOCS))
    sized = sized.withColumn("shard", F.pmod("_deal", F.lit(shards))).drop("_deal")
    by_shard = sized.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"))
    sources = with_targets(by_shard.groupBy("source").agg(F.sum("shard_size").alias("source_size")), weights, share)
    quotas = sources.coalesce(1).mapInPandas(_source_quotas, "source string, source_size long, rank int, weight double, cap double, target double, blocks long")
    s, q = by_shard.alias("s"), quotas.alias("q")
    joined = s.join(q, F.expr("s.source <=> q.source")).select(
        "s.source", "shard", "shard_size", "source_size", "target", "blocks"
    )
    plan = joined.groupBy("source").applyInPandas(
        _shard_quotas,
        "source string, shard long, shard_size long, source_size long, target double, blocks long, quota long",
    )
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0)
    plan = staged(
        plan.withColumn("passes", passes.cast("long")).withColumn(
            "rest", F.col("quota") - F.col("passes") * F.col("shard_size")
        ),
        "mix-plan",
    )
    d, p = sized.alias("d"), plan.alias("p")
    both = d.join(p, F.expr("d.source <=> p.source AND d.shard = p.shard")).select(
        "d.*", "source_size", "target", "passes", "rest"
    )
    cut = F.when(
        (F.col("rest") > 0) & (F.col("size") > 0),
        F.transform(
            F.sequence(F.lit(0), F.floor((F.col("size") - 1) / BLOCK)),
            lambda b: F.struct(b.alias("at"), F.least(F.lit(BLOCK).cast("long"), F.col("size") - b * BLOCK).alias("len")),
        ),
    )
    cells = both.select("row_id", "doc_id", "source", "shard", "rest", F.explode(cut).alias("b"))
    order = (
        Window.partitionBy("source", "shard")
        .orderBy(F.xxhash64(F.lit(seed), "doc_id", "b.at"), "doc_id", "b.at", "row_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = F.coalesce(F.sum("b.len").over(order), F.lit(0))
    cells = cells.withColumn("_got", F.greatest(F.lit(0).cast("long"), F.least(F.col("b.len"), F.col("rest") - before)))
    span = F.struct((F.col("b.at") * BLOCK).cast("long").alias("start"), F.col("_got").cast("long").alias("length"))
    picked = cells.where(F.col("_got") > 0).groupBy("row_id")
    picked = picked.agg(F.sum("_got").alias("picked"), F.sort_array(F.collect_list(span)).alias("spans"))
    return both.join(picked, "row_id", "left").select(
        "row_id",
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("passes") * F.col("size") + F.coalesce("picked", F.lit(0))).cast("long").alias("taken"),
        "passes",
        F.coalesce("spans", F.array().cast("array<struct<start:long,length:long>>")).alias("spans"),
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "passes", "spans")
