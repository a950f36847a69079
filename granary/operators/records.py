"""Records of a knowledge graph: parsing, pruning, and relations of a question's entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extraction_records(text: Column) -> Column:
    """``struct<kind, a, b, description, weight>`` of delimited records.

    An entity has a name, a type and a description; a relation has two ends, a description, keywords and a weight (1 if
    it is no number). Names and types are upper case. Records of another shape are skipped.
    """
    records = F.split(text, r"##|<\|COMPLETE\|>")
    bodies = F.filter(F.transform(records, lambda r: F.regexp_extract(r, r"(?s)\((.*)\)", 1)), lambda b: b != F.lit(""))

    def of(body: Column) -> Column:
        parts = F.transform(F.split(body, r"<\|>"), lambda p: F.regexp_replace(F.trim(p), '^"|"$', ""))
        entity = (parts[0] == "entity") & (F.size(parts) >= 4)
        relation = (parts[0] == "relationship") & (F.size(parts) >= 5)
        weight = F.coalesce(F.element_at(parts, -1).try_cast("double"), F.lit(1.0))
        return F.when(
            entity | relation,
            F.struct(
                F.when(entity, "entity").otherwise("relation").alias("kind"), F.upper(parts[1]).alias("a"), F.upper(parts[2]).alias("b"),
                parts[3].alias("description"), F.when(relation, weight).alias("weight"),
            ),
        )

    return F.filter(F.transform(bodies, of), lambda x: x.isNotNull())


def named_edges(edges: DataFrame, column: str, question: str) -> DataFrame:
    """Edges whose end is named in a question."""
    return edges.where((F.col(column) != "") & F.contains(F.lit(question.lower()), F.lower(column)))


def distinct_claims(rows: DataFrame, subject: str, claim: str, ord_: str) -> DataFrame:
    """One row for each subject and claim in lower case without outer blanks: ``claim, subject, n, first``."""
    return rows.groupBy(F.lower(F.trim(claim)).alias("claim"), subject).agg(F.count("*").alias("n"), F.min(ord_).alias("first"))


def relation_scores(edges: DataFrame, seeds: DataFrame, typed: DataFrame) -> DataFrame:
    """``src, dst, score``: half the similarity of a seed for its edges, times one more for each end of a wanted type."""
    near = edges.join(seeds, "src").select("src", "dst", (F.col("sim") / 2).alias("near"))
    marks = typed.select("dst").distinct().withColumn("_hit", F.lit(1))
    both = near.join(marks, "dst", "left")
    return both.select("src", "dst", (F.col("near") * (1 + F.coalesce("_hit", F.lit(0)))).alias("score"))


def tidy(nodes: DataFrame, description: str, source: str) -> DataFrame:
    """Nodes with a description and a source."""
    return nodes.where((F.coalesce(F.col(description).cast("string"), F.lit("")) != "") & F.col(source).isNotNull())
