"""Retrieval metrics, latency and usage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def case_metrics(retrieved: Column, relevant: Column) -> dict[str, Column]:
    """Precision, recall, F1, hit rate and reciprocal rank of one case; null without anything relevant."""
    hits = F.size(F.array_intersect(F.array_distinct(retrieved), F.array_distinct(relevant))).cast("double")
    found, wanted = F.size(F.array_distinct(retrieved)), F.size(F.array_distinct(relevant))
    precision = F.when(found == 0, F.lit(0.0)).otherwise(hits / F.greatest(found, F.lit(1)))
    recall = hits / F.greatest(wanted, F.lit(1))
    both = precision + recall
    first = F.array_position(F.transform(retrieved, lambda x: F.array_contains(relevant, x)), True)
    columns = {
        "precision": precision,
        "recall": recall,
        "f1_score": F.when(both > 0, 2 * precision * recall / F.nullif(both, F.lit(0.0))).otherwise(0.0),
        "hit_rate": (hits > 0).cast("double"),
        "mrr": F.when(first > 0, 1.0 / F.nullif(first.cast("double"), F.lit(0.0))).otherwise(0.0),
    }
    return {k: F.when(wanted > 0, v) for k, v in columns.items()}


def ranked_metrics(run: DataFrame, qrels: DataFrame, k: int = 10, k_map: int = 5) -> DataFrame:
    """``query, ndcg, ap, rr``: nDCG@k and RR@k with log2 discounts, AP@k_map over min(relevant, k_map).

    ``run``: query, doc, rank (from 1); ``qrels``: query, doc, rel.
    """
    ideal_rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rel"), "doc"))
    ideal = qrels.where("rel > 0").withColumn("i", ideal_rank)
    ideal = ideal.groupBy("query").agg(
        F.sum(F.when(F.col("i") <= k, F.col("rel") / F.log2(F.col("i") + 1))).alias("idcg"), F.count("*").alias("n_rel")
    )
    hits = run.join(qrels, ["query", "doc"], "left").withColumn("rel", F.coalesce(F.col("rel"), F.lit(0.0)))
    seen = F.sum((F.col("rel") > 0).cast("int")).over(Window.partitionBy("query").orderBy("rank"))
    hits = hits.withColumn("seen", seen)
    per = hits.groupBy("query").agg(
        F.sum(F.when(F.col("rank") <= k, F.col("rel") / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when((F.col("rank") <= k_map) & (F.col("rel") > 0), F.col("seen") / F.col("rank")).otherwise(0.0)).alias("hits"),
        F.min(F.when((F.col("rel") > 0) & (F.col("rank") <= k), F.col("rank"))).alias("first"),
    )
    out = per.join(ideal, "query", "left")
    return out.select(
        "query",
        F.coalesce(F.col("dcg") / F.col("idcg"), F.lit(0.0)).alias("ndcg"),
        F.coalesce(F.col("hits") / F.least(F.col("n_rel"), F.lit(k_map)), F.lit(0.0)).alias("ap"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"),
    )


def nearest_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, p50, p95 and maximum by the nearest-rank rule ``round((n - 1) * p)``."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(value)) - 1
    n = F.count("*").over(w)
    rows = df.withColumn("_r", rank).withColumn("_n", n)
    pick = lambda p: F.max(F.when(F.col("_r") == F.round((F.col("_n") - 1) * F.lit(p)), F.col(value)))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), pick(0.5).alias("p50"), pick(0.95).alias("p95"), F.max(value).alias("most")
    )


def split_budget(df: DataFrame, group: str, ord_: str, signal: str, budget: int) -> DataFrame:
    """Largest-remainder split of an integer budget by signal (a signal of zero or less counts as 1)."""
    size = F.when(F.col(signal) > 0, F.col(signal).cast("double")).otherwise(1.0)
    w = Window.partitionBy(group)
    raw = df.withColumn("_raw", F.lit(abs(budget)) * size / F.sum(size).over(w))
    raw = raw.withColumn("_part", F.floor("_raw"))
    left = F.lit(abs(budget)) - F.sum("_part").over(w)
    rank = F.row_number().over(w.orderBy(F.round(F.col("_raw") - F.col("_part"), 9).desc(), ord_))
    share = F.col("_part") + (rank <= left).cast("long")
    return raw.withColumn("delta", share if budget >= 0 else -share).drop("_raw", "_part")
