"""Clusters and near pairs of vectors, summaries of clusters, groups of names."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions import vectors as V
from granary.sources.staging import staged

def average_link(matrix: np.ndarray, least: float, most: int) -> list[list[int]]:
    """Greedy merging of the most similar clusters by average cosine, while it reaches ``least`` and sizes stay in ``most``."""
    size = np.linalg.norm(matrix, axis=1, keepdims=True)
    unit = np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)
    total = unit @ unit.T  # sums of similarities between clusters
    members = [[i] for i in range(len(matrix))]
    count = np.ones(len(matrix))
    alive = np.ones(len(matrix), bool)
    while alive.sum() > 1:
        mean = total / np.outer(count, count)
        bad = ~np.outer(alive, alive) | (np.add.outer(count, count) > most)
        mean[bad | np.tri(len(matrix), dtype=bool)] = -np.inf
        i, j = divmod(int(np.argmax(np.round(mean, 12))), len(matrix))
        if not mean[i, j] >= least or mean[i, j] <= 0:
            break
        members[i] += members[j]
        total[i] += total[j]
        total[:, i] += total[:, j]
        count[i] += count[j]
        alive[j] = False
    return [m for m, a in zip(members, alive, strict=True) if a]


def agglomerate(vectors: DataFrame, group: str, key: str, column: str, least: float = 0.5, most: int = 10) -> DataFrame:
    """``group, key, cluster`` (number of the cluster by its first member) of small groups, such as a document's chunks."""

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(key).reset_index(drop=True)
        found = average_link(np.array(table[column].tolist(), float), least, most)
        number = np.zeros(len(table), np.int64)
        for n, members in enumerate(sorted(found, key=min)):
            number[members] = n
        return pd.DataFrame({group: table[group], key: table[key], "cluster": number})

    types = {c: vectors.schema[c].dataType.simpleString() for c in (group, key)}
    return vectors.select(group, key, column).groupBy(group).applyInPandas(run, f"{group} {types[group]}, {key} {types[key]}, cluster long")


def extract_summary(texts: list[str]) -> str:
    """First sentences of up to five texts; of none that is long enough, the first 200 characters."""
    found = []
    for text in texts[:5]:
        first = pd.Series([text]).str.split(r"[.。!?\n]", n=1, regex=True)[0][0].strip()
        if len(first) > 5:
            found.append(first)
    return ". ".join(found) + "." if found else (texts[0][:200] if texts else "")


def summaries(rows: DataFrame, keys: list[str], ord_: str, text: str) -> DataFrame:
    """``keys, summary``: first sentences of the first five members of each cluster."""
    first = F.slice(F.sort_array(F.collect_list(F.struct(ord_, F.col(text).alias("_t")))), 1, 5)
    head = lambda x: F.trim(F.split(x["_t"], r"[.。!?\n]", 2)[0])
    out = rows.groupBy(*keys).agg(first.alias("_m"))
    sentences = F.filter(F.transform("_m", head), lambda x: F.length(x) > 5)
    whole = F.when(F.size(sentences) > 0, F.concat(F.array_join(sentences, ". "), F.lit("."))).otherwise(F.left(F.col("_m")[0]["_t"], F.lit(200)))
    return out.select(*keys, whole.alias("summary"))


def summary_tree(
    chunks: DataFrame, group: str, key: str, text: str, column: str, least: float, most: int, depth: int,
    summarise: Callable[[list[str]], str] = extract_summary,
) -> DataFrame:
    """``group, node, level, parent, text``: chunks at level 0, then clusters of each level with the mean of their vectors.

    Levels end when a group has one node, when nothing merges, or at ``depth``. A group is one document's chunks.
    """

    def run(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values(key)
        name, rows = table[group].iloc[0], []
        names = [f"0:{k}" for k in table[key]]
        vectors, texts = np.array(table[column].tolist(), float), table[text].fillna("").tolist()
        rows += [[name, n, 0, None, t] for n, t in zip(names, texts, strict=True)]
        for level in range(1, depth + 1):
            found = sorted(average_link(vectors, least, most), key=min)
            if len(names) == 1 or len(found) == len(names):
                break
            parents = [f"{level}:{i}" for i in range(len(found))]
            place = {names[i]: p for p, members in zip(parents, found, strict=True) for i in members}
            for row in rows:
                if row[3] is None and row[1] in place:
                    row[3] = place[row[1]]
            texts = [summarise([texts[i] for i in members]) for members in found]
            vectors = np.array([vectors[members].mean(axis=0) for members in found])
            names = parents
            rows += [[name, n, level, None, t] for n, t in zip(names, texts, strict=True)]
        return pd.DataFrame(rows, columns=[group, "node", "level", "parent", "text"])

    kind = chunks.schema[group].dataType.simpleString()
    out = chunks.select(group, key, text, column).groupBy(group).applyInPandas(run, f"{group} {kind}, node string, level int, parent string, text string")
    return out


def balanced_clusters(vectors: DataFrame, key: str, column: str, k: int, seed: int = 1, rounds: int = 10) -> DataFrame:
    """``key, cluster`` by k-means; a cluster above its even share passes its farthest members to the next best with room.

    Centres start far apart. The share is checked over all rows: members are ranked by distance in their cluster, and
    those beyond the capacity look for room in the clusters left, nearest first, round by round.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = staged(vectors.select(key, F.transform(column, lambda x: x.cast("double")).alias("_v")), "cluster-rows")
    n = rows.count()
    capacity = -(-n // max(k, 1))
    model = KMeans(k=k, seed=seed, maxIter=20, featuresCol="_f").fit(rows.select(array_to_vector("_v").alias("_f")))
    centres = [c.tolist() for c in model.clusterCenters()]
    away = [F.round(F.aggregate(F.zip_with("_v", V.literal(c), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x), 9) for c in centres]
    order = F.transform(F.sort_array(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(away)])), lambda x: x)
    waiting = staged(rows.select(key, order.alias("_o")).withColumn("_try", F.lit(0)), "cluster-order")
    placed, used = None, dict.fromkeys(range(len(centres)), 0)
    for _ in range(rounds * len(centres)):
        room = F.create_map(*[x for i, u in used.items() for x in (F.lit(i), F.lit(capacity - u))])
        options = F.filter("_o", lambda x: F.element_at(room, x["i"]) > 0)
        best = waiting.withColumn("_b", options[0])
        rank = F.row_number().over(Window.partitionBy("_b.i").orderBy("_b.d", key))
        taken = best.withColumn("_r", rank).where(F.col("_r") <= F.element_at(room, F.col("_b.i"))).select(key, F.col("_b.i").alias("cluster"))
        taken = staged(taken, "cluster-taken")
        placed = taken if placed is None else placed.unionByName(taken)
        for r in taken.groupBy("cluster").count().collect():
            used[r["cluster"]] += r["count"]
        waiting = staged(waiting.join(taken, key, "left_anti"), "cluster-order")
        if waiting.isEmpty():
            break
    return placed


def similar_names(names: DataFrame, key: str, column: str, least: float) -> DataFrame:
    """``a < b, similarity``: bigram Jaccard of lower-cased names; names meet by one of their rarest bigrams.

    Different names with the same bigrams are a class; its members pair with each other and with those of similar classes.
    """
    from granary.operators.merging import classes_of, hashed_sets, near_set_pairs

    sets, copies = hashed_sets(names.select(F.col(key).alias("_key"), T.char_bigrams(F.lower(column)).alias("_g")), "_key", "_g")
    of = classes_of(sets, copies, "_key")
    x, y = of.select(F.col("id").alias("a"), F.col("_key").alias("_x")), of.select(F.col("id").alias("b"), F.col("_key").alias("_y"))
    across = near_set_pairs(sets, copies, "_key", least).join(x, "a").join(y, "b")
    within = x.join(y, F.col("a") == F.col("b")).where("_x < _y").select("_x", "_y", F.lit(1.0).alias("similarity"))
    pairs = across.select("_x", "_y", "similarity").unionByName(within)
    return pairs.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "similarity")


def name_groups(names: DataFrame, key: str, column: str, least: float = 0.7) -> DataFrame:
    """``key, group_id``: names linked by similar pairs; names with equal bigrams are one from the start."""
    from granary.operators.components import connected_components
    from granary.operators.merging import classes_of, hashed_sets, near_set_pairs

    rows = names.select(F.col(key).alias("_key"), T.char_bigrams(F.lower(column)).alias("_g"))
    sets, copies = hashed_sets(rows, "_key", "_g")
    members = staged(classes_of(sets, copies, "_key").select(F.col("_key").alias(key), F.col("id").alias("_class")), "name-classes")
    of = connected_components(near_set_pairs(sets, copies, "_key", least), "a", "b").select(F.col("id").alias("_class"), F.col("component").alias("_c"))
    joined = members.join(of, "_class", "left")
    out = joined.select(key, F.coalesce("_c", "_class").alias("group_id"))
    rest = names.join(members, key, "left_anti").select(key, F.col(key).alias("group_id"))
    return out.unionByName(rest)
