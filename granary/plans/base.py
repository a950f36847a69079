"""Registration of queries, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL twin where SQL can express it."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the source is the knowledge base, source and language name the document."""
    labels = table(spark, sf_dir, "labels")
    return (
        table(spark, sf_dir, "documents")
        .join(labels, "doc_id", "left")
        .select(
            F.col("doc_id").alias("chunk_id"),
            F.col("source").alias("kb_id"),
            F.concat_ws("/", "source", "lang").alias("doc_name"),
            F.col("text").alias("content"),
            "lang",
            "n_chars",
            F.col("quality").cast("string").alias("available_int"),
            "quality",
            "toxic",
        )
    )


#: The same, as a common table expression.
CHUNKS = """chunks AS (SELECT d.doc_id AS chunk_id, d.source AS kb_id, d.source || '/' || d.lang AS doc_name,
 d.text AS content, d.lang, d.n_chars, CAST(l.quality AS VARCHAR) AS available_int, l.quality, l.toxic
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

#: Search tokens of a text in SQL (the test tables hold no CJK).
STOPS = "('the','and','for','with','this','that','are','was','were','been','have','has','had','not','but','from','they','will','would','could','should','can','may','might','shall','its','his','her','our','your','their','them')"


def sql_tokens(text: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN {STOPS})"


def sql_token_count(text: str) -> str:
    visible = rf"length(regexp_replace({text}, '[\s!-/:-@\[-`{{-~]', '', 'g'))"
    return f"CAST(CASE WHEN {visible} = 0 AND length(trim({text})) > 0 THEN 1 ELSE ceil({visible} / 4.0) END AS BIGINT)"
