"""Several questions to the same documents: texts are cut into tokens once."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import ranking as R

TEXTS = ["alpha beta the alpha", "Beta-gamma, 东京 tower", "", None, "the and for", "alpha " * 30 + "delta", "éclair ALPHA 東京都"]


def test_scores_of_staged_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    tokens = R.staged_tokens(docs, "doc_id", ["text"])
    blank = docs.withColumn("text", F.lit(""))  # texts are not read again
    for terms in (["alpha"], ["beta", "alpha", "alpha", "东京"], ["none"], []):
        want = sorted(map(tuple, R.field_bm25(docs, "doc_id", {"text": 1.0}, terms).collect()))
        assert sorted(map(tuple, R.field_bm25(blank, "doc_id", {"text": 1.0}, terms, tokens).collect())) == want
    assert {i for i, _ in R.field_bm25(blank, "doc_id", {"text": 1.0}, ["alpha", "东京"], tokens).collect()} == {0, 1, 5, 6}


def test_tokens_with_and_without_cjk(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string").select("k", T.rag_tokens(F.col("t")).alias("w")).collect()
    found = {r["k"]: r["w"] for r in rows}
    assert found[1] == ["beta", "gamma", "东", "京", "东京", "tower"]
    assert found[6] == ["éclair", "alpha", "東", "京", "都", "東京", "京都"]
    assert (found[0], found[2], found[3]) == (["alpha", "beta", "the", "alpha"], [], None)
