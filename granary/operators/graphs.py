"""Graphs as edge tables ``src, dst, weight``: degrees, paths, page rank, chains, levels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.staging import staged


def spread(edges: DataFrame, *keys: str) -> DataFrame:
    """Edges by their keys in all of the session's shuffle partitions, before they are grouped by the same keys.

    Edges are so few bytes that adaptive execution would join millions of them into a task by size, and the groups of a
    task are entries of its hash tables.
    """
    return edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, self-loops and repeats removed."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    ends = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return spread(pairs, "src", "dst").distinct().select(F.inline(ends))


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def merge(edges: DataFrame) -> DataFrame:
    """Parallel edges as one, weights added."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``node, distance`` of nodes at most ``hops`` steps from a seed (breadth first)."""
    links = undirected(edges)
    reached = seeds.select("node").distinct().withColumn("distance", F.lit(0))
    front = reached
    for step in range(1, hops + 1):
        nxt = front.join(links, front["node"] == links["src"]).select(F.col("dst").alias("node")).distinct()
        front = staged(nxt.join(reached, "node", "left_anti").withColumn("distance", F.lit(step)), "hops")
        reached = reached.unionByName(front)
    return reached


def simple_paths(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Paths ``n0 .. nK`` of ``hops`` edges from the seeds, no node twice."""
    links = undirected(edges)
    out = seeds.select(F.col("node").alias("n0"))
    for i in range(1, hops + 1):
        step = links.select(F.col("src").alias(f"n{i - 1}"), F.col("dst").alias(f"n{i}"))
        out = out.join(step, f"n{i - 1}")
        for j in range(i - 1):
            out = out.where(F.col(f"n{j}") != F.col(f"n{i}"))
    return out.select(*[f"n{i}" for i in range(hops + 1)])


def pagerank(edges: DataFrame, alpha: float = 0.85, steps: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """``node, rank``: a dangling node adds ``alpha / n`` to all, ranks are scaled to sum one after each step.

    Steps end when the ranks change by less than ``tolerance`` in all.
    """
    nodes = staged(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct(), "rank-nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    total = edges.groupBy("src").agg(F.sum("weight").alias("_sum"))
    shares = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w")).join(total, "src")
    shares = staged(shares.where("_sum > 0").select("src", "dst", (F.col("w") / F.col("_sum")).alias("share")), "rank-shares")
    dangling = n - shares.select("src").distinct().count()
    base = alpha * dangling / n + (1 - alpha) / n
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(steps):
        sent = shares.join(ranks, shares["src"] == ranks["node"]).groupBy(F.col("dst").alias("node"))
        sent = sent.agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        raw = nodes.join(sent, "node", "left").select("node", (F.lit(base) + alpha * F.coalesce("got", F.lit(0.0))).alias("rank"))
        raw = staged(raw, "rank-step")
        size = raw.agg(F.sum("rank")).first()[0]
        new = raw.select("node", (F.col("rank") / size).alias("rank"))
        if tolerance > 0:
            both = new.join(ranks.select("node", F.col("rank").alias("old")), "node")
            if both.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] < tolerance:
                return new
        ranks = new
    return ranks


def _spread(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``id, label``: the largest label among a node's own and those of the nodes before it, until nothing changes."""
    while True:
        sent = links.join(labels, links["src"] == labels["id"]).select(F.col("dst").alias("id"), "label")
        new = staged(labels.unionByName(sent).groupBy("id").agg(F.max("label").alias("label")), "scc-labels")
        changed = new.join(labels.select("id", F.col("label").alias("old")), "id").where("label <> old")
        labels = new
        if changed.isEmpty():
            return labels


def strong_components(edges: DataFrame) -> DataFrame:
    """``id, component`` of every node; ``component`` is the smallest id of its strongly connected component.

    Rounds of colours: a node's colour is the largest id that reaches it; the nodes of a colour that reach the node of that
    id backwards, inside the colour, are its component and leave the graph. Nodes without open edges leave at once.
    """
    links = staged(edges.where("src <> dst").select("src", "dst").distinct(), "scc-links")
    left = staged(edges.select(F.col("src").alias("id")).union(edges.select("dst")).where("id IS NOT NULL").distinct(), "scc-nodes")
    parts = []
    while not left.isEmpty():
        colour = _spread(left.withColumn("label", F.col("id")), links)
        c = colour.select("id", "label")
        inside = links.join(c.select(F.col("id").alias("src"), F.col("label").alias("a")), "src")
        inside = inside.join(c.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        back = staged(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "scc-back")
        front = c.where("id = label").select("id")
        reached = front
        while True:
            more = back.join(front, back["src"] == front["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
            front = staged(more.join(reached, "id", "left_anti"), "scc-front")
            if front.isEmpty():
                break
            reached = staged(reached.unionByName(front), "scc-reached")
        found = staged(reached.join(c, "id"), "scc-found")
        parts.append(found)
        left = staged(left.join(found, "id", "left_anti"), "scc-nodes")
        ends = found.select(F.col("id").alias("src")), found.select(F.col("id").alias("dst"))
        links = staged(links.join(ends[0], "src", "left_anti").join(ends[1], "dst", "left_anti").select("src", "dst"), "scc-links")
    if not parts:
        return left.select("id", F.col("id").alias("component"))
    every = reduce(DataFrame.unionByName, parts)
    least = every.groupBy("label").agg(F.min("id").alias("component"))
    return every.join(least, "label").select("id", "component")


def chain_issues(edges: DataFrame) -> DataFrame:
    """``node, issue``: self-loops, fan-in and fan-out above one, and cycles of a chain that should be linear."""
    plain = edges.where("src <> dst").select("src", "dst").distinct()
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.lit("self_loop").alias("issue")).distinct()
    fan = lambda c, name: plain.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("node", F.lit(name).alias("issue"))
    of = strong_components(edges)
    large = of.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    cycles = of.join(large, "component", "left_semi").select(F.col("id").alias("node"), F.lit("cycle").alias("issue"))
    return loops.unionByName(fan("dst", "fan_in")).unionByName(fan("src", "fan_out")).unionByName(cycles)


def tree_levels(parents: DataFrame) -> DataFrame:
    """``node, level`` from ``node, parent`` rows; a null parent is a root at level 0; levels until none is left."""
    level = parents.where("parent IS NULL").select("node", F.lit(0).alias("level"))
    out, kids, step = level, parents.where("parent IS NOT NULL"), 0
    while True:
        step += 1
        level = kids.join(level.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", F.lit(step).alias("level"))
        level = staged(level, "tree-level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def topological_levels(edges: DataFrame) -> DataFrame:
    """``node, level`` by peeling nodes without open predecessors; members of cycles get level -1."""
    left = staged(edges.where("src <> dst").select("src", "dst").distinct(), "topo-edges")
    nodes = staged(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct(), "topo-nodes")
    out, step = None, 0
    while True:
        free = staged(nodes.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"), "topo-free")
        if free.isEmpty():
            break
        found = free.withColumn("level", F.lit(step))
        out = found if out is None else out.unionByName(found)
        nodes = staged(nodes.join(free, "node", "left_anti"), "topo-nodes")
        left = staged(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"), "topo-edges")
        step += 1
    cyclic = nodes.withColumn("level", F.lit(-1))
    return cyclic if out is None else out.unionByName(cyclic)
