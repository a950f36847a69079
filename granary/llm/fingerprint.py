"""Bottom-k sketches of shingle hashes, as DataFrame expressions only (operator 2).

A document's fingerprint is the ``k`` smallest distinct 63-bit hashes of its five-word
shingles (a shorter text is one shingle; a text without words has an empty sketch).
Sketches merge by union, and estimate distinct shingles, resemblance and containment.

Edge cases: a null text is empty; equal texts have equal fingerprints; two empty sketches
resemble each other fully (1.0), an empty and a full one not at all; a null ``doc_id`` comes
first in the order of documents; rows that share a ``doc_id`` are ordered by their text;
further columns are ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .quality import bound, text_of, word_array
from .staging import read_table, shuffle_width

K = 128
SHINGLE = 5
SPAN = float(1 << 63)


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """One non-negative 63-bit hash a shingle, in text order."""

    def of(words: Column) -> Column:
        n = F.size(words)
        whole = F.xxhash64(words).bitwiseAND(F.lit((1 << 63) - 1))
        each = F.transform(
            F.sequence(F.lit(1), n - width + 1),
            lambda i: F.xxhash64(F.slice(words, i, width)).bitwiseAND(F.lit((1 << 63) - 1)),
        )
        none = F.array().cast("array<bigint>")
        return F.when(n >= width, each).when(n > 0, F.array(whole)).otherwise(none)

    return bound(word_array(text), of)


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    """The ``k`` smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(column: str, k: int = K) -> Column:
    """Aggregate that merges the sketches of a group; its state never exceeds the distinct hashes it met."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_set(column)))), 1, k)


def merge_groups(df: DataFrame, keys: list[str], column: str, k: int = K, salts: int = 64) -> DataFrame:
    """Merge sketches by group in two steps, so that a group with most of the rows is spread over ``salts`` tasks.

    Each step keeps the ``k`` smallest hashes of its part by rank, never a list of all of them.
    """
    part = df.select(*keys, F.explode(column).alias("_h")).withColumn("_salt", F.pmod(F.col("_h"), F.lit(salts)))
    part = part.dropDuplicates([*keys, "_h"])
    near = Window.partitionBy(*keys, "_salt").orderBy("_h")
    part = part.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k)
    return part.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(column))


def distinct_estimate(s: Column, k: int = K) -> Column:
    n = F.size(s)
    return F.when(n < k, n.cast("double")).otherwise(F.lit(k - 1.0) * F.lit(SPAN) / F.element_at(s, -1).cast("double"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's bottom-k that both sketches hold: an estimate of Jaccard similarity."""

    def share(u: Column) -> Column:
        both = F.size(F.array_intersect(u, F.array_intersect(a, b)))
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(both / F.size(u))

    return bound(merged(a, b, k), share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too."""
    j = resemblance(a, b, k)
    both = j * distinct_estimate(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_estimate(a, k)))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def split_points(docs: DataFrame, key: str, parts: int) -> list[int]:
    """First keys of at most ``parts`` ranges with about as many rows each; real values, ascending."""
    quantiles = [i / parts for i in range(parts)]
    low = docs.agg(F.min(key).alias("low"), F.percentile_approx(key, quantiles, 20 * parts).alias("at")).first()
    return sorted({low["low"], *low["at"]} - {None}) if low["low"] is not None else []


def with_next(docs: DataFrame, key: str, carried: list[str], parts: int) -> DataFrame:
    """Adds ``next_<c>`` of the document that follows by ``key``, after the last the first.

    Documents are dealt to ranges of the key, and the first of each range is dealt to the range
    before it as well, so one exchange suffices and no task sees more than one range.
    """
    points = split_points(docs, key, parts)
    if not points or not docs.where(F.col(key).isNull()).isEmpty():
        points = [(points[0] if points else 1) - 1, *points]  # a null key is a range before all others
    own = F.coalesce(F.col(key), F.lit(int(points[0])))
    starts = F.array(*[F.lit(int(p)) for p in points])
    at = F.greatest(F.lit(1), F.size(F.filter(starts, lambda p: p <= own)))
    with_nulls = docs.withColumn("_part", at).withColumn("_echo", F.lit(False))
    first = own.isin([int(p) for p in points])
    before = F.when(F.col("_part") == 1, F.lit(len(points))).otherwise(F.col("_part") - 1)
    dealt = with_nulls.withColumn(
        "_copies",
        F.when(
            first,
            F.array(
                F.struct(F.col("_part").alias("part"), F.lit(False).alias("echo")),
                F.struct(before.alias("part"), F.lit(True).alias("echo")),
            ),
        ).otherwise(F.array(F.struct(F.col("_part").alias("part"), F.lit(False).alias("echo")))),
    )
    dealt = dealt.select(*docs.columns, F.explode("_copies").alias("_c"))
    order = Window.partitionBy("_c.part").orderBy(
        F.col("_c.echo"), F.col(key).asc_nulls_first(), *[F.col(c) for c in carried]
    )
    return (
        dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
        .where(~F.col("_c.echo"))
        .drop("_c")
    )


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    parts = 4 * shuffle_width(spark)
    out = with_next(docs, "doc_id", ["text"], parts)
    out = out.select("doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))
    out = out.withColumn("edited_text", edited(F.col("text"), F.col("next_text")))
    out = out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        sketch(F.col("text")).alias("_own"),
        sketch(F.col("edited_text")).alias("_edited"),
        sketch(F.col("next_text")).alias("_next"),
    )
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("_own")).alias("fingerprint"),
        as_text(F.col("_edited")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_edited")).alias("near_edited"),
        resemblance(F.col("_own"), F.col("_next")).alias("near_next"),
        distinct_estimate(F.col("_own")).alias("distinct_shingles"),
        containment(F.col("_own"), F.col("_edited")).alias("contained_in_edited"),
    )
