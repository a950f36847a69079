"""Reading tables, and what the operators share of the library's staging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.staging import release, shared_folder, staged

__all__ = ["read_table", "release", "shared_folder", "shuffle_width", "staged", "with_ids"]

#: Ids of this many rows (about 16 bytes each) may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is among the (staged, distinct) ``ids``."""
    small = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids.hint("shuffle_hash"), key, "left_semi")
