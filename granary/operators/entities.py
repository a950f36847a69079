"""Entities from records: equal names first, then near vectors, then one row for each entity and its members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.components import connected_components
from granary.operators.neighbours import near_groups, near_pairs
from granary.sources.staging import staged


def normalised(name: str):
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def resolved(records: DataFrame, least: float, exact: bool = False) -> DataFrame:
    """``id, entity_id``: records with one name are one, and so are names whose vectors have a cosine of ``least``.

    ``records``: ``id, name, vector``. A name's vector is that of its first record that has one; ``entity_id`` is the least id.
    ``exact`` compares all blocks of vectors (``near_pairs``), else bands of signs choose what is compared. A name
    without a vector, and a record without a name, is near nothing.
    """
    rows = staged(records.select("id", F.coalesce(normalised("name"), F.concat(F.lit("\u0000"), F.col("id").cast("string"))).alias("_name"), "vector"), "entity-records")
    first = F.min_by("vector", F.when(F.col("vector").isNotNull(), F.col("id")))
    names = staged(rows.groupBy("_name").agg(F.min("id").alias("first"), first.alias("vector")), "entity-names")
    if exact:
        groups = connected_components(near_pairs(names, "first", "vector", least), "a", "b")
        groups = groups.select(F.col("id").alias("first"), F.col("component").alias("entity_id"))
    else:
        groups = near_groups(names, "first", "vector", least).select("first", F.col("class_id").alias("entity_id"))
    keyed = names.join(groups, "first", "left").select("_name", F.coalesce("entity_id", "first").alias("entity_id"))
    return rows.select("id", "_name").join(keyed, "_name").select("id", "entity_id")


def reduced(records: DataFrame, members: DataFrame) -> DataFrame:
    """``entity_id, name, description, mentions, n``: the most mentioned record's name, the longest description, sums.

    Ties go to the smaller id. Every measure is aggregated before the shuffle, so a large entity is no large group.
    """
    rows = records.join(members, "id")
    named = F.struct(F.coalesce("mentions", F.lit(0)), -F.col("id"))
    text = F.when(F.col("description").isNotNull(), F.struct(F.length("description"), -F.col("id")))
    return rows.groupBy("entity_id").agg(
        F.max_by("name", named).alias("name"), F.max_by("description", text).alias("description"), F.sum("mentions").alias("mentions"), F.count("*").alias("n")
    )
