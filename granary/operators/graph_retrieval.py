"""Entities and relations of a graph for a question: similarity times rank, with decay over hops.

All inputs are tables: ``seeds`` (``node, sim``, entities like the question), ``typed`` (``node``, entities of the wanted
types), ``relations`` (``src, dst, sim``, relations like the question), ``edges`` (``src, dst, weight``) and ``ranks``
(``node, rank``, such as ``graphs.pagerank``). Edges have no direction; a pair is named by its smaller end first, repeated
edges keep the largest weight. Many questions at once: give every table but ``edges`` and ``ranks`` a column ``query``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.sources.staging import staged

HOPS, MOST_PATHS = 2, 64


def pairs(edges: DataFrame) -> DataFrame:
    rows = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    return rows.groupBy("src", "dst").agg(F.max("weight").alias("weight"))


def weighted_paths(edges: DataFrame, seeds: DataFrame, hops: int = HOPS, most: int = MOST_PATHS) -> DataFrame:
    """``query, node, path, weights``: each seed's heaviest ``most`` simple paths of one to ``hops`` edges.

    Heaviest by total weight, then the longer, then by its nodes: the bound is by weight, so it never depends on chance.
    """
    links = staged(pairs(edges), "graph-pairs")
    both = links.select(F.col("src").alias("_from"), F.col("dst").alias("_to"), "weight")
    both = both.unionByName(links.select(F.col("dst").alias("_from"), F.col("src").alias("_to"), "weight"))
    now = seeds.select("query", "node", F.array("node").alias("path"), F.array().cast("array<double>").alias("weights"))
    found = None
    for _ in range(hops):
        step = now.withColumn("_from", F.element_at("path", -1)).join(both, "_from").where(~F.array_contains("path", F.col("_to")))
        now = step.select("query", "node", F.concat("path", F.array("_to")).alias("path"), F.concat("weights", F.array(F.col("weight").cast("double"))).alias("weights"))
        found = now if found is None else found.unionByName(now)
    total = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)
    order = Window.partitionBy("query", "node").orderBy(F.desc(total), F.desc(F.size("path")), "path")
    return found.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= most).drop("_nth")


def with_query(df: DataFrame) -> DataFrame:
    return df if "query" in df.columns else df.withColumn("query", F.lit(0))


def entity_scores(seeds: DataFrame, typed: DataFrame, ranks: DataFrame) -> DataFrame:
    """``query, node, score``: similarity, twice for a wanted type, times rank."""
    wanted = with_query(typed).select("query", "node").distinct().withColumn("_typed", F.lit(2.0))
    rows = with_query(seeds).join(wanted, ["query", "node"], "left").join(ranks, "node")
    return rows.select("query", "node", (F.col("sim") * F.coalesce("_typed", F.lit(1.0)) * F.col("rank")).alias("score"))


def relation_scores(
    edges: DataFrame, seeds: DataFrame, typed: DataFrame, relations: DataFrame, hops: int = HOPS, most: int = MOST_PATHS
) -> DataFrame:
    """``query, src, dst, score``: of relations like the question and of those on paths from its entities.

    A path's i-th edge (from 0) gets its seed's similarity over ``2 + i``. A relation like the question has its similarity
    times one plus these and plus one for each end of a wanted type; one on paths alone has their sum times one plus its
    typed ends. Both are multiplied by the edge's weight.
    """
    seeds, typed, relations = with_query(seeds), with_query(typed).select("query", F.col("node").alias("_n")).distinct(), with_query(relations)
    paths = weighted_paths(edges, seeds, hops, most).join(seeds.select("query", "node", "sim"), ["query", "node"])
    steps = F.sequence(F.lit(0), F.size("path") - 2)
    ends = F.transform(steps, lambda i: F.struct(i.alias("i"), F.get("path", i).alias("a"), F.get("path", i + 1).alias("b")))
    each = paths.select("query", "sim", F.explode(ends).alias("e"))
    near = each.groupBy("query", F.least("e.a", "e.b").alias("src"), F.greatest("e.a", "e.b").alias("dst"))
    near = near.agg(F.sum(F.col("sim") / (F.col("e.i") + 2)).alias("_near"))
    like = relations.select("query", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "sim")
    like = like.groupBy("query", "src", "dst").agg(F.max("sim").alias("sim"))
    rows = like.join(near, ["query", "src", "dst"], "full_outer").join(pairs(edges), ["src", "dst"])
    for end in ("src", "dst"):
        rows = rows.join(typed.withColumnRenamed("_n", end).withColumn(f"_{end}", F.lit(1.0)), ["query", end], "left")
    ends = F.coalesce("_src", F.lit(0.0)) + F.coalesce("_dst", F.lit(0.0))
    score = F.when(F.col("sim").isNotNull(), F.col("sim") * (1 + F.coalesce("_near", F.lit(0.0)) + ends)).otherwise(F.col("_near") * (1 + ends))
    return rows.select("query", "src", "dst", (score * F.col("weight")).alias("score"))
