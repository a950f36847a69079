"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.staging import staged

#: Edges that one task handles with ease; fewer tasks than shuffle partitions suffice for few edges.
EDGES_A_TASK = 50_000


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", tasks: int | None = None) -> DataFrame:
    """``id, component`` for every node with an edge to another; ``component`` is the smallest id reached.

    Each pass joins the edges with one minimum a node, so a hub's neighbours are never gathered in
    one place. The passes needed grow with the logarithm of the longest path. Null ends are ignored.
    ``tasks``: as many suffice for the first, unknown number of edges.
    """
    now = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    now = staged(now.coalesce(tasks) if tasks else now, "components")
    seen = _signature(now)
    while seen[0]:
        tasks = max(8, -(-seen[0] // EDGES_A_TASK))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.coalesce(tasks).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")
        now = staged(small.coalesce(tasks).distinct().coalesce(tasks), "components")
        before, seen = seen, _signature(now)
        if before == seen:
            break
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
