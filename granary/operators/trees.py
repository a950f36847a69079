"""Search in trees of clusters: a beam goes down level by level, for many queries at once.

Trees are tables (``tree, node, parent, vector``; a root has no parent). A step joins each query's kept nodes with their
children, scores these by cosine and keeps the best ``beam`` of each query, so a query sees about ``beam`` times the
number of a node's children on each level, and not the whole tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import vectors as V
from granary.sources.staging import staged


def best(rows: DataFrame, k: int) -> DataFrame:
    """Each query's k best by score (rounded to nine digits), ties by node; adds ``rank`` from 0."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    return rows.withColumn("rank", (F.row_number().over(order) - 1).cast("long")).where(F.col("rank") < k)


def beam_search(nodes: DataFrame, queries: DataFrame, beam: int, k: int) -> DataFrame:
    """``query, node, score, rank``: the k best leaves that the beam reaches in each query's ``tree``.

    ``queries``: ``query, tree, vector``. A leaf that the beam keeps on any level is a result; of the rest only kept nodes
    go on. Vectors of another length score 0; a cycle of parents has no root and is never entered.
    """
    own = nodes.select("tree", "node", "parent", F.col("vector").alias("_v"))
    asked = queries.select("query", "tree", F.col("vector").alias("_q"))
    parents = own.where("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct().withColumn("_inner", F.lit(True))
    own = staged(own.join(parents, ["tree", "node"], "left").withColumn("_inner", F.coalesce("_inner", F.lit(False))), "tree-nodes")
    score = F.round(V.cosine(F.col("_v"), F.col("_q")), 9)
    front = asked.join(own.where("parent IS NULL"), "tree").select("query", "tree", "node", "_inner", score.alias("score"))
    found = None
    while True:
        kept = staged(best(front, beam).drop("rank"), "tree-beam")
        leaves = kept.where("NOT _inner").select("query", "node", "score")
        found = leaves if found is None else found.unionByName(leaves)
        inner = kept.where("_inner").select("query", "tree", F.col("node").alias("parent"))
        if inner.isEmpty():
            return best(found, k)
        front = inner.join(own, ["tree", "parent"]).join(asked, ["query", "tree"]).select("query", "tree", "node", "_inner", score.alias("score"))


def collapsed_search(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of all nodes of a query's tree, whatever their level."""
    rows = queries.select("query", "tree", F.col("vector").alias("_q")).join(nodes.select("tree", "node", F.col("vector").alias("_v")), "tree")
    return best(rows.select("query", "node", F.round(V.cosine(F.col("_v"), F.col("_q")), 9).alias("score")), k)


def mean_vectors(leaves: DataFrame, places: list[str]) -> DataFrame:
    """``node, parent, vector`` of a tree over ``node, vector`` leaves: ``places`` names the columns of their clusters, lowest first.

    A cluster is named by its column and value; its vector is the mean of its leaves'. The last column's clusters have no
    parent.
    """
    name = lambda c: F.concat(F.lit(f"{c}:"), F.col(c).cast("string"))
    up = [*places[1:], None]
    out = leaves.select(F.concat(F.lit("leaf:"), F.col("node").cast("string")).alias("node"), name(places[0]).alias("parent"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    each = leaves.select(*places, F.posexplode("vector").alias("_i", "_x"))
    for place, above in zip(places, up, strict=True):
        keys = [place] if above is None else [place, above]
        means = each.groupBy(*keys, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
        rows = means.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("vector"))
        parent = F.lit(None).cast("string") if above is None else name(above)
        out = out.unionByName(rows.select(name(place).alias("node"), parent.alias("parent"), "vector"))
    return out
