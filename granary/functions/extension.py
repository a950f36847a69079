"""Functions that users bring: embedders, rerankers, parsers, chunkers and retrievers, called with whole batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def embedder(embed: Callable[[list[str]], list[list[float]]]):
    """A column function from texts to vectors; ``embed`` is called once a batch in each task."""

    @F.pandas_udf("array<double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = embed(texts.tolist())
            if len(found) != len(texts) or len({len(v) for v in found}) > 1:
                raise ValueError("an embedder gives one vector a text, all of one length")
            yield pd.Series(found)

    return of


def reranker(score: Callable[[list[str], list[str]], list[float]]):
    """A column function from questions and texts to scores."""

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, texts in batches:
            yield pd.Series(score(questions.tolist(), texts.tolist()), dtype=float)

    return of


def parser(parse: Callable[[bytes, str], str]):
    """A column function from contents and kinds to text; what ``parse`` cannot read is null."""

    @F.pandas_udf("string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for contents, kinds in batches:
            yield pd.Series([_or_none(parse, c, k) for c, k in zip(contents, kinds, strict=True)], dtype=object)

    return of


def _or_none(parse: Callable[[bytes, str], str], content: bytes, kind: str) -> str | None:
    try:
        return None if content is None else parse(content, kind)
    except (ValueError, KeyError, IndexError):
        return None


def chunk_function(cut: Callable[[str, int], Iterable[str]]):
    """A table function ``(text, size) -> position, content``."""

    class Chunks:
        def eval(self, text: str, size: int):
            yield from enumerate(cut(text, size)) if text else ()

    return F.udtf(Chunks, returnType="position int, content string")


def run_questions(spark: SparkSession, retrieve: Callable[[str], DataFrame], questions: list[str]) -> DataFrame:
    """``question`` and the rows of a retriever for each of a few questions."""
    found = None
    for q in questions:
        rows = retrieve(q).withColumn("question", F.lit(q))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no questions")
    return found
