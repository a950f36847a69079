"""Retrieval over several steps, the document store's score, and functions that users plug in."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import extension as Ext
from granary.functions import text as T
from granary.operators import ranking as R

from .base import query, table
from .search import COS, QUESTION, query_vector


def occurrences(text: str, word: str) -> str:
    return f"(length(lower({text})) - length(replace(lower({text}), '{word}', ''))) / {len(word)}"


@query(
    "docstore_score",
    f"""WITH {COS} SELECT d.doc_id, round({occurrences('text', 'oring')} + {occurrences('text', 'the')} + {occurrences('source', 'the')} + {occurrences('source', 'oring')}
 + 1 / (1 + greatest(coalesce(c.score, 0), 0)) * (CASE WHEN c.score IS NULL THEN 0 ELSE 1 END) + CASE source WHEN 'src3' THEN 2 WHEN 'src1' THEN 0.5 ELSE 0 END, 6) AS score FROM documents d LEFT JOIN cos c ON c.doc_id = d.doc_id""",
)
def docstore_score(spark, d):
    """Occurrences in two fields, the inverted distance, and a boost by knowledge base."""
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id").select("doc_id", "embedding")
    rows = table(spark, d, "documents").join(e, "doc_id", "left")
    score = R.store_score(
        [F.col("text"), F.col("source")], "oring, the", F.col("embedding"), query_vector(spark, d), "l2", [(F.col("source"), {"src3": 2.0, "src1": 0.5})]
    )
    return rows.select("doc_id", F.round(score, 6).alias("score"))


@query("narrow")
def narrow(spark, d):
    """Documents narrowed to a few words, without those that have none."""
    rows = table(spark, d, "documents").select("doc_id", R.narrowed(F.col("text"), ["oring", "Keit", "v1.2"]).alias("content"))
    return rows.where("content IS NOT NULL")


@query("grep_search")
def grep_search(spark, d):
    return R.grep_search(table(spark, d, "documents"), "doc_id", "text", QUESTION, 20)


@query("multi_hop")
def multi_hop(spark, d):
    """Three rounds over BM25 scores scaled by their maximum; texts are cut into tokens once for all."""
    docs = table(spark, d, "documents")
    tokens = R.staged_tokens(docs, "doc_id", ["text"])
    retrieve = lambda q: R.field_bm25(docs, "doc_id", {"text": 1.0}, R.query_tokens(spark, q), tokens)
    return R.multi_hop(docs, "doc_id", "text", retrieve, QUESTION)


@query("skill_search", "SELECT p_partkey, round(3 * CAST(contains(lower(p_name), 'steel') AS INT) + CAST(contains(lower(p_type), 'promo') AS INT), 6) AS score FROM part WHERE contains(lower(p_name), 'steel') OR contains(lower(p_type), 'promo')")
def skill_search(spark, d):
    """A search with weights of one's own for each field."""
    hit = lambda c, w: F.lower(c).contains(w).cast("int")
    return table(spark, d, "part").select("p_partkey", (3 * hit("p_name", "steel") + hit("p_type", "promo")).cast("double").alias("score")).where("score > 0")


@query(
    "rerank_window",
    f"""WITH {COS}, r AS (SELECT doc_id, score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank FROM cos QUALIFY rank < 64), w AS (SELECT r.doc_id, rank, round(0.3 * score + 0.7 * coalesce(quality, 0), 6) AS s FROM r LEFT JOIN labels USING (doc_id))
 SELECT doc_id, s AS score, n - 1 AS rank FROM (SELECT *, row_number() OVER (ORDER BY s DESC, doc_id) AS n FROM w) WHERE n BETWEEN 11 AND 20""",
)
def rerank_window(spark, d):
    """The second page of ten after the 64 best are ranked anew."""
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    near = R.vector_scores(e, "doc_id", "embedding", query_vector(spark, d)).withColumn("near", F.col("score")).withColumn("score", F.round("score", 6))
    best = R.top(near, 64).drop("rank").join(table(spark, d, "labels"), "doc_id", "left")
    anew = best.select("doc_id", F.round(0.3 * F.col("near") + 0.7 * F.coalesce("quality", F.lit(0)), 6).alias("score"))
    return R.top(anew, 20).where("rank >= 10")


@query("embed_rows", "SELECT doc_id, length(text) % 97 AS first, 2 AS dims FROM documents")
def embed_rows(spark, d):
    """Vectors by a user's function that takes a batch of texts."""
    embed = Ext.embedder(lambda texts: [[float(len(t) % 97), 1.0] for t in texts])
    rows = table(spark, d, "documents").select("doc_id", embed(F.coalesce("text", F.lit(""))).alias("v"))
    return rows.select("doc_id", F.col("v")[0].cast("long").alias("first"), F.size("v").cast("long").alias("dims"))


@query("rerank_rows", "SELECT doc_id, CASE WHEN contains(text, 'oring') THEN 1.0 ELSE 0.0 END AS score FROM documents")
def rerank_rows(spark, d):
    """Scores by a user's function that takes batches of questions and texts."""
    rerank = Ext.reranker(lambda questions, texts: [1.0 if q in t else 0.0 for q, t in zip(questions, texts, strict=True)])
    return table(spark, d, "documents").select("doc_id", rerank(F.lit("oring"), F.coalesce("text", F.lit(""))).alias("score"))


@query("chunk_table_function", "SELECT doc_id, unnest(range(0, CAST(ceil(length(text) / 500) AS BIGINT))) AS position FROM documents WHERE length(text) > 0")
def chunk_table_function(spark, d):
    """Chunks of 500 characters by a user's table function."""
    cut = Ext.chunk_function(lambda text, size: (text[i : i + size] for i in range(0, len(text), size)))
    spark.udtf.register("granary_cut", cut)
    docs = table(spark, d, "documents")
    found = docs.lateralJoin(cut(F.col("text").outer(), F.lit(500)))
    return found.select("doc_id", F.col("position").cast("long").alias("position"))


@query("parse_rows", "SELECT doc_id, length(text) AS n FROM documents WHERE doc_id % 2 = 0")
def parse_rows(spark, d):
    """Texts by a user's parser of bytes; a failure gives null."""

    def parse(content: bytes, kind: str) -> str:
        if kind != "txt":
            raise ValueError(kind)
        return content.decode()

    kind = F.when(F.col("doc_id") % 2 == 0, "txt").otherwise("bin")
    rows = table(spark, d, "documents").select("doc_id", Ext.parser(parse)(F.encode("text", "UTF-8"), kind).alias("t"))
    return rows.where("t IS NOT NULL").select("doc_id", F.length("t").cast("long").alias("n"))


@query("evaluate_runner", "SELECT 2 AS cases, 1.0 AS precision")
def evaluate_runner(spark, d):
    """A user's retriever run over two questions: the share of documents found that hold the word."""
    docs = table(spark, d, "documents")
    retrieve = lambda q: R.top(R.bm25(docs, "doc_id", "text", R.query_tokens(spark, q)), 5)
    found = Ext.run_questions(spark, retrieve, ["oring", "theand"])
    rows = found.join(docs.select("doc_id", "text"), "doc_id")
    good = F.array_contains(T.tokens(F.col("text")), F.col("question"))
    return rows.agg(F.countDistinct("question").alias("cases"), F.round(F.avg(good.cast("double")), 6).alias("precision"))
