"""Retrieval, ranking, scalar functions and graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions import vectors as V
from granary.operators import graph_retrieval as GR
from granary.operators import graphs as Gr
from granary.operators import metrics as X
from granary.operators import neighbours as N
from granary.operators import ranking as R
from granary.operators.components import connected_components
from granary.sources.staging import shared_folder

from .base import query, sql_token_count, sql_tokens, table

QUESTION = "Theand oring anthat the"
TERMS = ("theand", "oring", "anthat")

# ── lexical and vector search ────────────────────────────────────────────────

BM25 = f"""tok AS (SELECT doc_id, {sql_tokens('text')} AS t FROM documents),
 tf AS (SELECT doc_id, len(t) AS dl, len(list_filter(t, lambda x: x = 'theand')) AS f0, len(list_filter(t, lambda x: x = 'oring')) AS f1,
 len(list_filter(t, lambda x: x = 'anthat')) AS f2 FROM tok),
 st AS (SELECT count(*) AS n, avg(dl) AS a, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1, count(*) FILTER (WHERE f2 > 0) AS d2 FROM tf),
 bm AS (SELECT doc_id, {' + '.join(f"greatest(0, ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1)) * (f{i} / greatest(dl, 1)) * 2.2 / ((f{i} / greatest(dl, 1)) + 1.2 * (0.25 + 0.75 * dl / a))" for i in range(3))} AS score
 FROM tf, st WHERE f0 + f1 + f2 > 0)"""


@query("bm25_stats", f"WITH {BM25} SELECT n, a AS avgdl, d0, d1, d2 FROM st")
def bm25_stats(spark, d):
    rows = R.token_stats(table(spark, d, "documents"), "doc_id", "text")
    held = {f"d{i}": F.count_if(F.array_contains("tokens", w)).alias(f"d{i}") for i, w in enumerate(TERMS)}
    return rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *held.values())


@query(
    "bm25_topk",
    f"""WITH {BM25}, top AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM bm QUALIFY rank < 10)
 SELECT doc_id, round(score, 9) AS score, rank, regexp_replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'),
 '(?i)(anthat|theand|oring)', '<em>\\1</em>', 'g') AS marked FROM top JOIN documents USING (doc_id)""",
)
def bm25_topk(spark, d):
    """Ten best documents for a question, marked; the ten are fetched from the table after ranking."""
    docs = table(spark, d, "documents")
    best = R.top(R.bm25(docs, "doc_id", "text", R.query_tokens(spark, QUESTION)), 10)
    rows = docs.join(F.broadcast(best), "doc_id")
    return rows.select("doc_id", F.round("score", 9).alias("score"), "rank", T.highlight(F.col("text"), list(TERMS)).alias("marked"))


@query("bm25_blend", f"WITH {BM25} SELECT doc_id, round(score / (score + 5), 9) AS score FROM bm")
def bm25_blend(spark, d):
    s = R.bm25(table(spark, d, "documents"), "doc_id", "text", list(TERMS))
    return s.select("doc_id", F.round(F.col("score") / (F.col("score") + 5), 9).alias("score"))


FIELDS = (("text", "text", 1), ("title", "source", 2), ("keywords", "lang", 5), ("question", "split_part(text, chr(10), 1)", 6))


def sql_field(name: str, text: str) -> str:
    """Score of one field, as a common table expression ``name``."""
    score = " + ".join(f"greatest(0, ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1)) * (f{i} / greatest(dl, 1)) * 2.2 / ((f{i} / greatest(dl, 1)) + 1.2 * (0.25 + 0.75 * dl / CASE WHEN a > 0 THEN a ELSE 100 END))" for i in range(3))
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(("src3", "oring", "theand")))
    held = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(3))
    return f"""{name} AS (WITH tok AS (SELECT doc_id, {sql_tokens(text)} AS t FROM documents), tf AS (SELECT doc_id, len(t) AS dl, {counts} FROM tok),
 st AS (SELECT count(*) AS n, avg(dl) AS a, {held} FROM tf) SELECT doc_id, f0 + f1 + f2 AS f, {score} AS score FROM tf, st)"""


@query(
    "field_bm25",
    f"""WITH {", ".join(sql_field(name, text) for name, text, _ in FIELDS)}, s AS (SELECT doc_id, {" + ".join(f"{w} * {name}.score" for name, _, w in FIELDS)} AS score FROM text
 {" ".join(f"JOIN {name} USING (doc_id)" for name, _, _ in FIELDS[1:])} WHERE {" + ".join(f"{name}.f" for name, _, _ in FIELDS)} > 0)
 SELECT doc_id, round(score / (SELECT max(score) FROM s), 9) AS score FROM s""",
)
def field_bm25(spark, d):
    """Text, source, language and first line with weights 1, 2, 5 and 6."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("source").alias("title"), F.col("lang").alias("keywords"), F.split("text", "\n")[0].alias("question"))
    s = R.field_bm25(docs, "doc_id", {name: float(w) for name, _, w in FIELDS}, ["src3", "oring", "theand"])
    return s.select("doc_id", F.round("score", 9).alias("score"))


def query_vector(spark, d):
    """The vector of the smallest id stands for an embedded question: one row."""
    return list(table(spark, d, "embeddings").orderBy("vec_id").limit(1).first()["embedding"])


COS = """cos AS (SELECT vec_id AS doc_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)) AS score FROM embeddings)"""


@query("vector_topk", f"WITH {COS} SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) - 1 AS rank FROM cos QUALIFY rank < 20")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    s = R.vector_scores(e, "doc_id", "embedding", query_vector(spark, d)).withColumn("score", F.round("score", 6))
    return R.top(s, 20)


def asked(spark, d):
    """Every hundredth vector is a query against all."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select("vec_id", "embedding")


def cell_index(spark, d):
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/cells-{uuid.uuid4().hex}"
    return N.CellIndex.build(table(spark, d, "embeddings"), "vec_id", "embedding", folder)


@query("vector_ann")
def vector_ann(spark, d):
    """Ten neighbours from as many cells as a recall of 0.95 needs; a test measures 0.9 against the exact scan."""
    index = cell_index(spark, d)
    return index.search(asked(spark, d), "vec_id", "embedding", 10, index.probes_for(asked(spark, d), "vec_id", "embedding", 10, 0.95))


@query(
    "vector_knn",
    """SELECT q.vec_id AS query, e.vec_id AS key, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) - 1 AS rank
 FROM embeddings q JOIN embeddings e ON q.vec_id % 100 = 0 QUALIFY rank < 10""",
)
def vector_knn(spark, d):
    """The same without loss: cells whose widest angle rules them out are skipped."""
    found = cell_index(spark, d).search_exact(asked(spark, d), "vec_id", "embedding", 10)
    return found.withColumn("score", F.round("score", 6))


@query(
    "hybrid_search",
    f"""WITH {BM25}, {COS}, f AS (SELECT coalesce(b.doc_id, c.doc_id) AS doc_id, round(0.7 * coalesce(b.score, 0) / (SELECT max(score) FROM bm) + 0.3 * coalesce(c.score, 0), 6) AS score
 FROM bm b FULL JOIN cos c ON b.doc_id = c.doc_id) SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM f WHERE score > 0 QUALIFY rank < 20""",
)
def hybrid_search(spark, d):
    docs = table(spark, d, "documents")
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return R.hybrid_search(docs, e, QUESTION, query_vector(spark, d), 0.3, 20).select("doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    "fuse_knn_text",
    f"""WITH {COS}, t AS (SELECT doc_id, (CAST(contains(lower(text), 'oring') AS INT) + CAST(contains(lower(text), 'erand') AS INT)) / 2 AS cov FROM documents),
 b AS (SELECT coalesce(c.doc_id, t.doc_id) AS doc_id, round(0.6 * coalesce(score, 0) + 0.4 * coalesce(cov, 0), 6) AS score FROM cos c FULL JOIN t ON c.doc_id = t.doc_id)
 SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS rank FROM b WHERE score > 0 QUALIFY rank < 50""",
)
def fuse_knn_text(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    knn = R.vector_scores(e, "doc_id", "embedding", query_vector(spark, d))
    hit = lambda t: F.lower("text").contains(t).cast("int")
    text = table(spark, d, "documents").select("doc_id", ((hit("oring") + hit("erand")) / 2).alias("score"))
    return R.fuse_named(knn, text, "doc_id", 0.6, 50)


@query("coverage", "SELECT doc_id, (CAST(contains(lower(text), 'oring') AS INT) + CAST(contains(lower(text), 'erand') AS INT) + CAST(contains(lower(text), 'the') AS INT)) / 3 AS share FROM documents")
def coverage(spark, d):
    hits = sum((F.lower("text").contains(t).cast("int") for t in ("oring", "erand", "the")), F.lit(0))
    return table(spark, d, "documents").select("doc_id", (hits / 3).alias("share"))


@query(
    "rank_feature",
    """SELECT o_orderkey, round(o_totalprice / 100000 + 10 * (2 * w1 + 1 * w2) / sqrt(w1 * w1 + w2 * w2 + w3 * w3) / sqrt(5), 6) AS score
 FROM (SELECT o_orderkey, o_totalprice, 1.0 AS w1, length(o_orderpriority) * 1.0 AS w2, 3.0 AS w3 FROM orders)""",
)
def rank_feature(spark, d):
    tags = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.length("o_orderpriority").cast("double"), F.lit("c"), F.lit(3.0))
    score = R.rank_feature(F.col("o_totalprice") / 100000, tags, {"a": 2.0, "b": 1.0})
    return table(spark, d, "orders").select("o_orderkey", F.round(score, 6).alias("score"))


KEYS = {"theand": 0.4, "oring": 0.4, "anthat": 0.4, "theandoring": 0.6, "oringanthat": 0.6}


def sql_similarity(bag: str, keys: dict[str, float] = KEYS) -> str:
    """Similarity of a bag of tokens to terms of equal weight: terms count 0.4, adjacent pairs 0.6."""
    pairs = f"list_transform(range(1, len({bag})), lambda i: {bag}[i] || {bag}[i + 1])"
    hits = " + ".join(f"CASE WHEN list_contains({bag}, '{k}') OR list_contains({pairs}, '{k}') THEN {w} ELSE 0 END" for k, w in keys.items())
    terms = sum(w == 0.4 for w in keys.values())
    return f"((1e-9::DOUBLE + ({hits}) / {terms}::DOUBLE) / (1e-9::DOUBLE + {sum(keys.values())} / {terms}::DOUBLE))"


SIM = f"sim AS (SELECT doc_id, {sql_similarity('t')} AS sim FROM (SELECT doc_id, {sql_tokens('text')} AS t FROM documents))"


def token_sims(spark, d):
    wanted = R.query_weights(spark, list(TERMS))
    return table(spark, d, "documents").select("doc_id", R.token_similarity(T.tokens(F.col("text")), wanted).alias("sim"))


@query("token_sim", f"WITH {SIM} SELECT doc_id, round(sim, 6) AS sim FROM sim")
def token_sim(spark, d):
    return token_sims(spark, d).select("doc_id", F.round("sim", 6).alias("sim"))


@query("hybrid_sim", f"WITH {SIM}, {COS} SELECT sim.doc_id, round(round(CASE WHEN (SELECT sum(score) FROM cos) = 0 THEN sim ELSE 0.7 * sim + 0.3 * coalesce(score, 0) END, 9), 6) AS score FROM sim LEFT JOIN cos USING (doc_id)")
def hybrid_sim(spark, d):
    """Tokens alone where all vector similarities sum to zero."""
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    v = R.vector_scores(e, "doc_id", "embedding", query_vector(spark, d))
    total = v.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("all"))
    rows = token_sims(spark, d).join(v, "doc_id", "left").crossJoin(F.broadcast(total))
    blend = F.when(F.col("all") == 0, F.col("sim")).otherwise(0.7 * F.col("sim") + 0.3 * F.coalesce("score", F.lit(0.0)))
    return rows.select("doc_id", F.round(F.round(blend, 9), 6).alias("score"))  # a tie at the sixth digit falls the same way everywhere


BAG = f"""list_concat({sql_tokens('text')}, {', '.join([sql_tokens('source')] * 2 + [sql_tokens('lang')] * 5 + [sql_tokens('split_part(text, chr(10), 1)')] * 6)})"""


@query("rerank_lexical", f"""WITH b AS (SELECT doc_id, {BAG} AS t FROM documents)
 SELECT doc_id, round({sql_similarity('t', {"oring": 0.4, "en": 0.4, "oringen": 0.6})}, 6) AS score FROM b""")
def rerank_lexical(spark, d):
    """Content once, source twice, language five times and the first line six times in the bag."""
    bag = R.weighted_bag(F.col("text"), F.col("source"), F.col("lang"), F.split("text", "\n")[0])
    wanted = {"oring": 0.4, "en": 0.4, "oringen": 0.6}
    return table(spark, d, "documents").select("doc_id", F.round(R.token_similarity(bag, wanted), 6).alias("score"))


@query("rerank_blend", f"WITH {SIM} SELECT doc_id, round(0.3 * sim + 0.7 * coalesce(quality, 0) + n_chars / 100000 + 10 * 2 / sqrt(5) / sqrt(2), 6) AS score FROM sim JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id)")
def rerank_blend(spark, d):
    """Token similarity, an external model's score (here the label) and the rank feature."""
    rows = token_sims(spark, d).join(table(spark, d, "labels"), "doc_id", "left").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    tags = F.create_map(F.lit("a"), F.lit(1.0), F.lit("c"), F.lit(1.0))
    feature = R.rank_feature(F.col("n_chars") / 100000, tags, {"a": 2.0, "b": 1.0})
    return rows.select("doc_id", F.round(0.3 * F.col("sim") + 0.7 * F.coalesce("quality", F.lit(0)) + feature, 6).alias("score"))


@query("rerank_cli", f"WITH {COS} SELECT doc_id, round(0.3 * score + 0.7 * coalesce(quality, 0), 6) AS score FROM cos LEFT JOIN labels USING (doc_id)")
def rerank_cli(spark, d):
    e = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    rows = R.vector_scores(e, "doc_id", "embedding", query_vector(spark, d)).join(table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.round(0.3 * F.col("score") + 0.7 * F.coalesce("quality", F.lit(0)), 6).alias("score"))


@query(
    "key_terms",
    f"""WITH t AS (SELECT conv_id * 1000 + turn AS id, {sql_tokens('text')} AS t FROM conversations), e AS (SELECT id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM t),
 s AS (SELECT id, term, round(count(*) * (1 + 1 / (1 + min(pos))) * CASE least(length(term), 4) WHEN 1 THEN 0.7 WHEN 2 THEN 1.0 WHEN 3 THEN 1.1 ELSE 1.2 END::DOUBLE
 * CASE WHEN regexp_matches(term, '^[A-Za-z]+$') THEN 0.9 ELSE 1.0 END::DOUBLE, 9) AS score FROM e WHERE NOT regexp_matches(term, '^[0-9]+$') GROUP BY id, term)
 SELECT id, term, round(score, 6) AS score, row_number() OVER (PARTITION BY id ORDER BY score DESC, term) AS rank FROM s QUALIFY rank <= 5""",
)
def key_terms(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return R.key_terms(rows, "id", "text", 5).withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


RUN = """q AS (SELECT d.doc_id AS query, d.source AS kb FROM documents d), run AS (SELECT o_custkey AS query, o_orderkey AS doc,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
 qrels AS (SELECT o_custkey AS query, o_orderkey AS doc, CASE o_orderstatus WHEN 'F' THEN 2.0 WHEN 'P' THEN 1.0 ELSE 0.0 END AS rel FROM orders)"""


def run_and_qrels(spark, d):
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    run = o.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), F.row_number().over(w).alias("rank"))
    rel = F.when(F.col("o_orderstatus") == "F", 2.0).when(F.col("o_orderstatus") == "P", 1.0).otherwise(0.0)
    return run, o.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), rel.alias("rel"))


@query(
    "ir_metrics",
    f"""WITH {RUN}, h AS (SELECT r.query, r.rank, rel, sum(CASE WHEN rel > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY r.query ORDER BY rank) AS seen FROM run r JOIN qrels USING (query, doc)),
 i AS (SELECT query, rel, row_number() OVER (PARTITION BY query ORDER BY rel DESC, doc) AS i FROM qrels WHERE rel > 0),
 id AS (SELECT query, sum(CASE WHEN i <= 10 THEN rel / log2(i + 1) END) AS idcg, count(*) AS n FROM i GROUP BY query),
 p AS (SELECT query, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 5 AND rel > 0 THEN seen / rank ELSE 0 END) AS ap,
 min(CASE WHEN rel > 0 AND rank <= 10 THEN rank END) AS first FROM h GROUP BY query)
 SELECT p.query, round(coalesce(dcg / idcg, 0), 6) AS ndcg, round(coalesce(ap / least(n, 5), 0), 6) AS ap, round(coalesce(1 / first, 0), 6) AS rr FROM p LEFT JOIN id USING (query)""",
)
def ir_metrics(spark, d):
    m = X.ranked_metrics(*run_and_qrels(spark, d))
    return m.select("query", *[F.round(c, 6).alias(c) for c in ("ndcg", "ap", "rr")])


@query(
    "ir_metrics_alt",
    f"""WITH {RUN}, h AS (SELECT r.query, r.rank, rel FROM run r JOIN qrels USING (query, doc)), n AS (SELECT query, count(*) FILTER (WHERE rel > 0) AS n FROM qrels GROUP BY query)
 SELECT h.query, count(*) FILTER (WHERE rank <= 5 AND rel > 0) / 5 AS p5, count(*) FILTER (WHERE rank <= 5 AND rel > 0) / greatest(max(n), 1) AS r5,
 round(sum(CASE WHEN rank <= 10 AND rel > 0 THEN 3 / ln(rank + 1) ELSE 0 END) / (3 * least(10, greatest(max(n), 1))), 6) AS ndcg FROM h JOIN n USING (query) GROUP BY h.query""",
)
def ir_metrics_alt(spark, d):
    run, qrels = run_and_qrels(spark, d)
    rows = run.join(qrels, ["query", "doc"])
    good = F.col("rel") > 0
    n = F.greatest(F.count_if(good), F.lit(1))
    gain = F.sum(F.when((F.col("rank") <= 10) & good, 3 / F.log(F.col("rank") + 1)).otherwise(0.0))
    five = F.count_if((F.col("rank") <= 5) & good)
    return rows.groupBy("query").agg((five / 5).alias("p5"), (five / n).alias("r5"), F.round(gain / (3 * F.least(F.lit(10), n)), 6).alias("ndcg"))


@query(
    "eval_case",
    """WITH r AS (SELECT o_custkey AS c, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:5] AS got, list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS want FROM orders GROUP BY 1),
 h AS (SELECT c, got, want, len(list_intersect(got, want)) AS hits FROM r WHERE len(coalesce(want, [])) > 0)
 SELECT c AS case_id, round(hits / len(got), 6) AS precision, round(hits / len(want), 6) AS recall, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit_rate,
 round(CASE WHEN hits > 0 THEN 2 * (hits / len(got)) * (hits / len(want)) / ((hits / len(got)) + (hits / len(want))) ELSE 0 END, 6) AS f1_score FROM h""",
)
def eval_case(spark, d):
    cases = eval_cases(spark, d)
    return cases.select("case_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "hit_rate", "f1_score")])


def eval_cases(spark, d):
    rows = F.sort_array(F.collect_list(F.struct(-F.col("o_totalprice"), "o_orderkey")))
    got = F.slice(F.transform(rows, lambda x: x["o_orderkey"]), 1, 5)
    want = F.collect_list(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
    cases = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(got.alias("got"), want.alias("want"))
    m = X.case_metrics(F.col("got"), F.col("want"))
    return cases.where(F.size("want") > 0).select("case_id", *[v.alias(k) for k, v in m.items()])


@query(
    "eval_summary",
    """WITH r AS (SELECT o_custkey AS c, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey)[1:5] AS got, list(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS want FROM orders GROUP BY 1)
 SELECT count(*) AS cases, round(avg(len(list_intersect(got, want)) / len(got)), 6) AS avg_precision, round(avg(len(list_intersect(got, want)) / len(want)), 6) AS avg_recall FROM r WHERE len(coalesce(want, [])) > 0""",
)
def eval_summary(spark, d):
    return eval_cases(spark, d).agg(F.count("*").alias("cases"), F.round(F.avg("precision"), 6).alias("avg_precision"), F.round(F.avg("recall"), 6).alias("avg_recall"))


# ── scalar functions ─────────────────────────────────────────────────────────


@query(
    "text_functions",
    f"""SELECT doc_id, {sql_token_count('text')} AS tokens, len({sql_tokens('text')}) AS words, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS blanks,
 regexp_matches(text, '^[0-9]+(\\.[0-9]+)?$') AS is_number, length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) >= length(text) * 0.7 AS english,
 replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM documents""",
)
def text_functions(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", T.token_count(t).alias("tokens"), F.size(T.tokens(t)).cast("long").alias("words"), T.single_blanks(t).alias("blanks"),
        T.is_number(t).alias("is_number"), T.is_english(t).alias("english"), T.html_escape(t).alias("escaped"),
    )


@query(
    "similarity_functions",
    """WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part),
 g AS (SELECT *, list_distinct(list_transform(range(1, length(a)), lambda i: a[i:i+1])) AS x, list_distinct(list_transform(range(1, length(b)), lambda i: b[i:i+1])) AS y FROM p)
 SELECT p_partkey, levenshtein(a, b) AS edits, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS bigram FROM g""",
)
def similarity_functions(spark, d):
    a, b = F.lower("p_name"), F.lower("p_type")
    share = T.jaccard(T.char_bigrams(a), T.char_bigrams(b))
    return table(spark, d, "part").select("p_partkey", F.levenshtein(a, b).cast("long").alias("edits"), F.round(share, 6).alias("bigram"))


@query(
    "date_functions",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(epoch(o_orderdate) AS BIGINT) AS seconds, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days FROM orders""",
)
def date_functions(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.unix_timestamp("o_orderdate").alias("seconds"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).cast("long").alias("days"),
    )


@query("math_functions", "SELECT event_id, round(2 / pi() * atan(value), 9) AS squashed, round((value - min(value) OVER (PARTITION BY event_type)) / (max(value) OVER (PARTITION BY event_type) - min(value) OVER (PARTITION BY event_type)), 9) AS scaled FROM events")
def math_functions(spark, d):
    e = table(spark, d, "events")
    ends = e.groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = e.join(F.broadcast(ends), "event_type")
    return rows.select("event_id", F.round(V.atan_normalised(F.col("value")), 9).alias("squashed"), F.round((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")), 9).alias("scaled"))


@query(
    "column_types",
    """WITH v AS (SELECT 'c_acctbal' AS col, CAST(c_custkey AS VARCHAR) AS s FROM customer UNION ALL SELECT 'c_name', c_name FROM customer)
 SELECT col, count(*) FILTER (WHERE regexp_matches(s, '^(0|-?[1-9][0-9]*)$')) AS ints, count(*) FILTER (WHERE regexp_matches(s, '^-?[0-9]+\\.[0-9]+$')) AS floats, count(*) AS n FROM v GROUP BY col""",
)
def column_types(spark, d):
    """Votes for the type of text columns; a leading zero is no integer."""
    c = table(spark, d, "customer")
    rows = c.select(F.explode(F.array(F.struct(F.lit("c_acctbal").alias("col"), F.col("c_custkey").cast("string").alias("s")), F.struct(F.lit("c_name").alias("col"), F.col("c_name").alias("s")))).alias("v"))
    return rows.groupBy("v.col").agg(F.count_if(F.col("v.s").rlike("^(0|-?[1-9][0-9]*)$")).alias("ints"), F.count_if(F.col("v.s").rlike(r"^-?[0-9]+\.[0-9]+$")).alias("floats"), F.count("*").alias("n"))


# ── graphs ───────────────────────────────────────────────────────────────────

EDGES = "edges AS (SELECT DISTINCT l_suppkey AS src, l_partkey + 1000000 AS dst, 1.0 AS weight FROM lineitem)"


def edge_rows(spark, d):
    """The edges with repeats, for operators that remove these themselves."""
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst"), F.lit(1.0).alias("weight"))


def edges(spark, d):
    return edge_rows(spark, d).distinct()


UND = "und AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) WHERE src <> dst)"


@query("graph_edges", """WITH w AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS w FROM documents), e AS (SELECT doc_id, w[i] AS src, w[i+1] AS dst FROM w, unnest(range(1, len(w))) AS r(i))
 SELECT src, dst, count(*) AS weight, count(DISTINCT doc_id) AS docs FROM e GROUP BY src, dst""")
def graph_edges(spark, d):
    """Capitalised words next to each other in their order in a text."""
    found = F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))
    w = table(spark, d, "documents").select("doc_id", found.alias("w"))
    pairs = F.when(F.size("w") > 1, F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("src"), F.slice("w", F.lit(2), F.size("w") - 1).alias("dst")))
    rows = w.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.src", "p.dst")
    return rows.groupBy("src", "dst").agg(F.count("*").alias("weight"), F.countDistinct("doc_id").alias("docs"))


@query("graph_degree", f"WITH {EDGES}, {UND} SELECT src AS node, count(*) AS degree FROM und GROUP BY src")
def graph_degree(spark, d):
    return Gr.degrees(edge_rows(spark, d))


@query("graph_merge", "SELECT l_suppkey AS src, l_partkey AS dst, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight FROM lineitem GROUP BY ALL")
def graph_merge(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("weight"))
    return Gr.merge(rows)


@query("graph_khop", f"""WITH RECURSIVE {EDGES}, {UND}, r AS (SELECT 1 AS node, 0 AS distance UNION SELECT dst, distance + 1 FROM r JOIN und ON src = node WHERE distance < 2)
 SELECT node, min(distance) AS distance FROM r GROUP BY node""")
def graph_khop(spark, d):
    seeds = spark.createDataFrame([(1,)], "node long")
    return Gr.within_hops(edge_rows(spark, d), seeds, 2)


@query("graph_paths", f"WITH {EDGES}, {UND} SELECT x.src AS n0, x.dst AS n1, y.dst AS n2 FROM und x JOIN und y ON x.dst = y.src WHERE x.src IN (1, 2) AND x.src <> y.dst")
def graph_paths(spark, d):
    return Gr.simple_paths(edge_rows(spark, d), spark.createDataFrame([(1,), (2,)], "node long"), 2)


def sql_rounds(first: str, step: str, rounds: int) -> str:
    """Tables ``r0 .. rN``: each made from the one before (``prev``)."""
    parts = [f"r0 AS MATERIALIZED ({first})"]
    parts += [f"r{i} AS MATERIALIZED ({step.replace('prev', f'r{i - 1}')})" for i in range(1, rounds + 1)]
    return ", ".join(parts)


LABELS = sql_rounds("SELECT DISTINCT src AS id, src AS c FROM und", "SELECT p.id, least(p.c, min(q.c)) AS c FROM prev p JOIN und ON und.src = p.id JOIN prev q ON q.id = und.dst GROUP BY p.id, p.c", 8)


@query("graph_components", f"WITH {EDGES}, {UND}, {LABELS} SELECT id, c AS component FROM r8")
def graph_components(spark, d):
    return connected_components(edges(spark, d))


RANKS = sql_rounds(
    "SELECT node, 1 / (SELECT count(*) FROM nodes) AS rank FROM nodes",
    """SELECT node, raw / (sum(raw) OVER ()) AS rank FROM (SELECT node, (1 - 0.85) / (SELECT count(*) FROM nodes) + 0.85 * coalesce(got, 0) AS raw FROM nodes
 LEFT JOIN (SELECT s.dst AS node, sum(p.rank * s.share) AS got FROM shares s JOIN prev p ON p.node = s.src GROUP BY s.dst) USING (node))""",
    10,
)


@query(
    "graph_pagerank",
    f"""WITH {EDGES}, b AS MATERIALIZED (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), nodes AS MATERIALIZED (SELECT DISTINCT src AS node FROM b),
 shares AS MATERIALIZED (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS share FROM b GROUP BY src, dst), {RANKS} SELECT node, round(rank, 9) AS rank FROM r10""",
)
def graph_pagerank(spark, d):
    e = edges(spark, d)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return Gr.pagerank(both, steps=10, tolerance=0.0).select("node", F.round("rank", 9).alias("rank"))


NEXT = "e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, n_regionkey FROM nation)"
REACH = "r AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT r.src, e.dst FROM r JOIN e ON e.src = r.dst)"


def chain(spark, d):
    n = table(spark, d, "nation")
    ring = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return ring.union(n.select("n_nationkey", "n_regionkey")).distinct()


@query("chain_issues", f"""WITH RECURSIVE {NEXT}, {REACH}, p AS (SELECT * FROM e WHERE src <> dst)
 SELECT src AS node, 'self_loop' AS issue FROM e WHERE src = dst UNION ALL SELECT dst, 'fan_in' FROM p GROUP BY dst HAVING count(*) > 1
 UNION ALL SELECT src, 'fan_out' FROM p GROUP BY src HAVING count(*) > 1 UNION ALL SELECT DISTINCT src, 'cycle' FROM r WHERE src = dst""")
def chain_issues(spark, d):
    return Gr.chain_issues(chain(spark, d))


@query("strong_components", f"""WITH RECURSIVE {NEXT}, {REACH} SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM r a JOIN r b ON b.src = a.dst AND b.dst = a.src GROUP BY a.src
 UNION ALL SELECT n_nationkey, n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT src FROM r WHERE src = dst)""")
def strong_components(spark, d):
    return Gr.strong_components(chain(spark, d))


TREE = "tree AS (SELECT 'r' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


@query("tree_levels", f"WITH RECURSIVE {TREE}, l AS (SELECT node, 0 AS level FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, l.level + 1 FROM tree t JOIN l ON t.parent = l.node) SELECT node, level FROM l")
def tree_levels(spark, d):
    def named(df, node, parent):
        return df.select(node.alias("node"), parent.cast("string").alias("parent"))

    r = named(table(spark, d, "region"), F.concat(F.lit("r"), "r_regionkey"), F.lit(None))
    n = named(table(spark, d, "nation"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    s = named(table(spark, d, "supplier"), F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"))
    return Gr.tree_levels(r.unionByName(n).unionByName(s))


@query("topo_levels", f"WITH RECURSIVE {TREE}, l AS (SELECT node, 0 AS level FROM tree WHERE parent IS NULL AND node IN (SELECT parent FROM tree) UNION ALL SELECT t.node, l.level + 1 FROM tree t JOIN l ON t.parent = l.node) SELECT node, max(level) AS level FROM l GROUP BY node")
def topo_levels(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"))
    return Gr.topological_levels(n.unionByName(s))


@query("kg_hits", "SELECT p_partkey, (CAST(contains(lower(p_name), 'a') AS INT) + CAST(contains(lower(p_name), '1') AS INT)) / 2 AS score FROM part WHERE contains(lower(p_name), 'a') OR contains(lower(p_name), '1')")
def kg_hits(spark, d):
    hits = sum((F.lower("p_name").contains(t).cast("int") for t in ("a", "1")), F.lit(0))
    return table(spark, d, "part").select("p_partkey", (hits / 2).alias("score")).where("score > 0")


KG = """e AS MATERIALIZED (SELECT l_suppkey AS src, l_partkey + 1000000 AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY ALL),
 seeds AS (SELECT s_suppkey AS node, (contains(s_name, '1')::INT + contains(s_name, '7')::INT) / 2 AS sim FROM supplier WHERE s_suppkey % 9 = 0 AND (contains(s_name, '1') OR contains(s_name, '7'))),
 typed AS (SELECT p_partkey + 1000000 AS node FROM part WHERE p_size < 10),
 u AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e),
 one AS (SELECT s.node, s.sim, u.dst AS b, NULL::BIGINT AS c, u.weight AS w FROM seeds s JOIN u ON u.src = s.node),
 two AS (SELECT o.node, o.sim, o.b, u.dst AS c, o.w + u.weight AS w FROM one o JOIN u ON u.src = o.b AND u.dst <> o.node),
 paths AS (SELECT * FROM (SELECT * FROM one UNION ALL SELECT * FROM two) QUALIFY row_number() OVER (PARTITION BY node ORDER BY w DESC, c IS NULL, b, c) <= 64),
 near AS (SELECT src, dst, sum(s) AS near FROM (SELECT least(node, b) AS src, greatest(node, b) AS dst, sim / 2 AS s FROM paths UNION ALL SELECT least(b, c), greatest(b, c), sim / 3 FROM paths WHERE c IS NOT NULL) GROUP BY ALL)"""


@query(
    "kg_retrieval",
    f"""WITH {KG}, liked AS (SELECT src, dst, 0.5 AS sim FROM e WHERE (src + dst) % 50 = 0)
 SELECT src, dst, round(weight * CASE WHEN l.sim IS NOT NULL THEN l.sim * (1 + coalesce(near, 0) + (dst IN (SELECT node FROM typed))::INT) ELSE near * (1 + (dst IN (SELECT node FROM typed))::INT) END, 6) AS score
 FROM near FULL JOIN liked l USING (src, dst) JOIN e USING (src, dst)""",
)
def kg_retrieval(spark, d):
    """Relations over all edges: like the question, or on the heaviest paths from entities that are."""
    seeds, typed, e = kg_inputs(spark, d)
    liked = e.where((F.col("src") + F.col("dst")) % 50 == 0).select("src", "dst", F.lit(0.5).alias("sim"))
    return GR.relation_scores(e, seeds, typed, liked).select("src", "dst", F.round("score", 6).alias("score"))


@query(
    "kg_entities",
    f"""WITH {KG}, p AS (SELECT s_suppkey AS node, s_nationkey % 5 = 0 AS typed FROM supplier), r AS (SELECT src AS node, sum(weight) / (SELECT sum(weight) FROM e) AS rank FROM e GROUP BY src)
 SELECT node, round(1000 * sim * CASE WHEN typed THEN 2 ELSE 1 END * rank, 6) AS score FROM seeds JOIN p USING (node) JOIN r USING (node)""",
)
def kg_entities(spark, d):
    """Entities like the question: similarity, doubled for a type, times their share of all weight."""
    seeds, _, e = kg_inputs(spark, d)
    typed = table(spark, d, "supplier").where("s_nationkey % 5 = 0").select(F.col("s_suppkey").alias("node"))
    everything = e.agg(F.sum("weight").alias("_all"))
    ranks = e.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("_w")).crossJoin(F.broadcast(everything)).select("node", (F.col("_w") / F.col("_all")).alias("rank"))
    return GR.entity_scores(seeds, typed, ranks).select("node", F.round(F.col("score") * 1000, 6).alias("score"))


def kg_inputs(spark, d):
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")).agg(F.count("*").cast("double").alias("weight"))
    hits = F.col("s_name").contains("1").cast("int") + F.col("s_name").contains("7").cast("int")
    seeds = table(spark, d, "supplier").where("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("node"), (hits / 2).alias("sim")).where("sim > 0")
    typed = table(spark, d, "part").where("p_size < 10").select((F.col("p_partkey") + 1000000).alias("node"))
    return seeds, typed, e


@query("subgraph", f"WITH {EDGES} SELECT src, dst FROM edges WHERE src IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def subgraph(spark, d):
    rich = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("src"))
    return edges(spark, d).join(rich, "src", "left_semi").select("src", "dst")
