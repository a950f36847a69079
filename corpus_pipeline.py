"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``. What a stage drops or cuts, the next one never sees. Rows are told apart by row, not by
``doc_id``: a null id passes through all stages, and rows that share an id stay separate rows (only ``near_dedup``
takes them for one document, which goes or stays as a whole). A null or empty text has no words and goes in ``quality``;
a text of any length stays whole until ``mix``; ties between equal texts go to the smallest id; columns besides those of
``documents`` are dropped, whatever their names; an empty table gives an empty result.

1. ``quality``: documents that the line rules reject go; surviving documents lose their failed lines.
2. ``near_dedup``: one document of each near-duplicate group (five-word shingles, Jaccard 0.80) stays.
3. ``suffix_dedup``: bytes covered by a 100-byte string that stood earlier go; a character that loses
   a byte goes whole; a document that loses all its text goes.
4. ``mix``: sources are weighted; a document appears once for each whole pass of its shard, and once
   more with the blocks of words, and the blanks before them, that the seeded order of its shard's last pass picked.
5. ``pack``: the mixed texts as pieces of 2048-id sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import minhash, mixing, packing, quality, suffix_dedup
from granary.llm.staging import read_table, release, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE = 5
NEAR = 80
WORD_ENDS = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"


def _columns(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(docs.select("doc_id", "text", "lang", "source"))
    # a row number keeps the optimizer from moving the filter below the measures and computing them twice
    judged = judged.withColumn("_row", F.monotonically_increasing_id()).where("kept")
    return _columns(judged.withColumn("text", F.col("clean_text")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicates(docs, SHINGLE, NEAR).where("NOT kept").select("doc_id").distinct()
    gone = staged(gone, "near-gone")
    small = gone.count() <= 1_000_000
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeated_bytes(docs, whole_characters=True, carry=("lang", "source"))
    return _columns(left.withColumn("text", F.col("kept").cast("string")).where(F.length("text") > 0))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = staged(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "mix-rows")
    taken = mixing.mix(docs, row_id="_row").where("taken > 0").select(F.col("row_id").alias("_row"), "passes", "spans")
    both = docs.join(taken, "_row")
    words = F.split("text", WORD_ENDS)  # each with the blanks before it: line breaks stay
    blocks = F.transform("spans", lambda s: F.slice(words, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    picked = F.array_join(F.flatten(blocks), "")
    copies = F.array_repeat(F.col("text"), F.col("passes").cast("int"))
    copies = F.when(F.size("spans") > 0, F.concat(copies, F.array(picked))).otherwise(copies)
    return _columns(both.select("doc_id", F.explode(copies).alias("text"), "lang", "source"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mix", mix_stage),
    ("pack", pack_stage),
]

#: The stages' searches over all substrings and their packing have no SQL form; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            release(before)
        before = docs
    return docs
