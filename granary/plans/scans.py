"""Sources, sinks and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions import vectors as V
from granary.operators import metadata as M
from granary.operators import tables as O

from .base import CHUNKS, chunks, query, sql_token_count, table


@query("scan_chunks", f"WITH {CHUNKS} SELECT kb_id, count(*) AS n, sum(n_chars) AS chars FROM chunks GROUP BY kb_id")
def scan_chunks(spark, d):
    return chunks(spark, d).groupBy("kb_id").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    "corrupt_split",
    """WITH e AS (SELECT event_id, CASE WHEN event_type = 'view' THEN substr(props, 1, length(props) - 1) ELSE props END AS raw FROM events)
 SELECT coalesce(json_valid(raw), false) AS is_valid, count(*) AS n, min(event_id) AS first_id FROM e GROUP BY 1""",
)
def corrupt_split(spark, d):
    raw = F.when(F.col("event_type") == "view", F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    e = O.corrupt_split(table(spark, d, "events").withColumn("raw", raw), "raw")
    return e.groupBy("is_valid").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query(
    "docstore_search",
    """SELECT page_id, (length(lower(html)) - length(replace(lower(html), 'the', ''))) / 3
 + (length(lower(url)) - length(replace(lower(url), 'example', ''))) / 7 AS score FROM pages
 WHERE (length(lower(html)) - length(replace(lower(html), 'the', ''))) / 3
 + (length(lower(url)) - length(replace(lower(url), 'example', ''))) / 7 > 0""",
)
def docstore_search(spark, d):
    score = T.count_of(F.lower("html"), "the") + T.count_of(F.lower("url"), "example")
    return table(spark, d, "pages").select("page_id", score.alias("score")).where("score > 0")


SQL_TEXT = "SELECT o_orderpriority, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_orderpriority"


@query("sql_passthrough", f"SELECT o_orderpriority, n, total FROM ({SQL_TEXT}) ORDER BY o_orderpriority LIMIT 3")
def sql_passthrough(spark, d):
    found = spark.sql(SQL_TEXT.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))
    return found.orderBy("o_orderpriority").limit(3)


@query(
    "row_to_document",
    """SELECT c_custkey AS doc_key, 'c_name: ' || coalesce(c_name, '') || chr(10) || 'c_mktsegment: ' ||
 coalesce(c_mktsegment, '') || chr(10) || 'c_nationkey: ' || coalesce(CAST(c_nationkey AS VARCHAR), '') AS content FROM customer""",
)
def row_to_document(spark, d):
    return O.row_documents(table(spark, d, "customer"), "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])


@query("html_to_text")
def html_to_text(spark, d):
    return table(spark, d, "pages").select("page_id", "url", T.html_to_text(F.coalesce("html", F.lit(""))).alias("content"))


@query(
    "upsert_merge",
    """WITH inc AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'
 UNION ALL SELECT s_suppkey + 1000000, s_name, s_acctbal FROM supplier)
 SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM inc)
 UNION ALL SELECT * FROM inc""",
)
def upsert_merge(spark, d):
    now = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    changed = now.where("c_mktsegment = 'BUILDING'").select(
        "c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal")
    )
    new = table(spark, d, "supplier").select(
        (F.col("s_suppkey") + 1000000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal")
    )
    return O.upsert(now.drop("c_mktsegment"), changed.unionByName(new), ["c_custkey"])


@query(
    "conditional_update",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 'LATE' ELSE o_orderpriority END AS o_orderpriority FROM orders""",
)
def conditional_update(spark, d):
    late = (F.col("o_orderstatus") == "O") & (F.col("o_totalprice") > 100000)
    return O.conditional_update(table(spark, d, "orders"), late, {"o_orderpriority": F.lit("LATE")}).select(
        "o_orderkey", "o_orderpriority"
    )


@query("conditional_delete", "SELECT count(*) AS kept, (SELECT count(*) FROM orders) - count(*) AS deleted FROM orders WHERE NOT coalesce(o_orderstatus = 'F', false)")
def conditional_delete(spark, d):
    rows = table(spark, d, "orders")
    kept = O.conditional_delete(rows, F.col("o_orderstatus") == "F").agg(F.count("*").alias("kept"))
    every = rows.agg(F.count("*").alias("n"))
    return kept.crossJoin(F.broadcast(every)).select("kept", (F.col("n") - F.col("kept")).alias("deleted"))


@query(
    "replace_document",
    f"""WITH {CHUNKS}, new AS (SELECT DISTINCT doc_name, 'replaced ' || doc_name AS content FROM chunks WHERE lang = 'en')
 SELECT doc_name, content FROM chunks WHERE doc_name NOT IN (SELECT doc_name FROM new) UNION ALL SELECT * FROM new""",
)
def replace_document(spark, d):
    rows = chunks(spark, d)
    new = rows.where("lang = 'en'").select("doc_name").distinct().withColumn("content", F.concat(F.lit("replaced "), "doc_name"))
    return O.upsert(rows.select("doc_name", "content"), new, ["doc_name"])


SNAPSHOT = "SELECT doc_id, md5(text) AS h FROM documents"


@query(
    "snapshot_diff",
    """WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE lang <> 'fr'),
 b AS (SELECT doc_id, md5(CASE WHEN source = 'src3' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'de')
 SELECT doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'deleted'
 WHEN a.h IS NOT DISTINCT FROM b.h THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN b USING (doc_id)""",
)
def snapshot_diff(spark, d):
    docs = table(spark, d, "documents")
    before = docs.where("lang <> 'fr'").select("doc_id", F.md5("text").alias("h"))
    text = F.when(F.col("source") == "src3", F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    after = docs.where("lang <> 'de'").select("doc_id", F.md5(text).alias("h"))
    return O.snapshot_diff(before, after, "doc_id", "h")


@query(
    "drift_report",
    """WITH a AS (SELECT source, lang, count(*) AS left_count FROM documents GROUP BY ALL),
 b AS (SELECT source, lang, count(*) AS right_count FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
 SELECT source, lang, coalesce(left_count, 0) AS left_count, coalesce(right_count, 0) AS right_count
 FROM a FULL JOIN b USING (source, lang) WHERE coalesce(left_count, 0) <> coalesce(right_count, 0)""",
)
def drift_report(spark, d):
    docs = table(spark, d, "documents")
    return O.drift(docs, docs.join(table(spark, d, "labels"), "doc_id", "left_semi"), ["source", "lang"])


@query("dim_check", "SELECT label, count(DISTINCT len(embedding)) AS dims, count(DISTINCT len(embedding)) <= 1 AS consistent FROM embeddings GROUP BY label")
def dim_check(spark, d):
    dims = F.countDistinct(F.size("embedding"))
    return table(spark, d, "embeddings").groupBy("label").agg(dims.alias("dims"), (dims <= 1).alias("consistent"))


@query("project_fields", f"WITH {CHUNKS} SELECT chunk_id, doc_name, n_chars FROM chunks")
def project_fields(spark, d):
    return chunks(spark, d).select("chunk_id", "doc_name", "n_chars")


@query(
    "filter_terms",
    r"""SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND list_has_any(regexp_extract_all(props, '[0-9]+'), ['1','2','3'])""",
)
def filter_terms(spark, d):
    rows = table(spark, d, "events").withColumn("numbers", F.regexp_extract_all("props", F.lit("[0-9]+"), F.lit(0)))
    wanted = {"event_type": ["click", "view"], "numbers": ["1", "2", "3"]}
    return rows.where(O.matches(wanted, frozenset({"numbers"}))).select("event_id")


@query(
    "scope_filter",
    f"""WITH {CHUNKS} SELECT chunk_id FROM chunks WHERE kb_id IN ('src1','src2','src5') AND lang IN ('en','de')
 AND NOT coalesce(available_int IN ('0','false'), false)""",
)
def scope_filter(spark, d):
    wanted = {"kb_id": ["src1", "src2", "src5"], "lang": ["en", "de"], "available_int": 1}
    return chunks(spark, d).where(O.matches(wanted)).select("chunk_id")


@query(
    "condition_builder",
    f"""WITH {CHUNKS} SELECT chunk_id, kb_id FROM chunks WHERE coalesce(available_int IN ('0','false'), false) AND lang = 'en'
 UNION ALL SELECT chunk_id, kb_id FROM chunks WHERE toxic IS NULL AND kb_id IN ('src7')""",
)
def condition_builder(spark, d):
    rows = chunks(spark, d)
    off = rows.where(O.matches({"available_int": 0, "lang": "en", "doc_name": ""}))
    return off.unionByName(rows.where(O.matches({"must_not.exists": "toxic", "kb_id": ["src7"]}))).select("chunk_id", "kb_id")


META = """meta AS (SELECT doc_id, 'lang' AS key, lang AS value FROM documents UNION ALL
 SELECT doc_id, 'source', source FROM documents UNION ALL SELECT doc_id, 'n_chars', CAST(n_chars AS VARCHAR) FROM documents UNION ALL
 SELECT doc_id, 'quality', CAST(quality AS VARCHAR) FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels)"""


def meta(spark, d):
    """Metadata as a long table; documents without a label lack its keys."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")

    def long(df, keys):
        pairs = [F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]
        return df.select("doc_id", F.explode(F.array(*pairs)).alias("p")).select("doc_id", "p.key", "p.value").where("value IS NOT NULL")

    return long(docs, ["lang", "source", "n_chars"]).unionByName(long(labels, ["quality", "toxic"]))


@query(
    "meta_filter_and",
    f"""WITH {META} SELECT doc_id FROM meta WHERE key = 'lang' AND value NOT IN ('fr','es')
 INTERSECT SELECT doc_id FROM meta WHERE key = 'n_chars' AND TRY_CAST(value AS DOUBLE) > 1000
 INTERSECT SELECT doc_id FROM meta WHERE key = 'toxic' AND TRY_CAST(value AS DOUBLE) <> 1""",
)
def meta_filter_and(spark, d):
    return M.filter_ids(meta(spark, d), [("lang", "not in", ["fr", "es"]), ("n_chars", ">", "1000"), ("toxic", "not is", "1")])


@query(
    "meta_filter_or",
    f"""WITH {META} SELECT doc_id FROM meta WHERE key = 'source' AND starts_with(value, 'src1')
 UNION SELECT doc_id FROM meta WHERE key = 'quality' AND TRY_CAST(value AS DOUBLE) <= 0
 UNION SELECT doc_id FROM meta WHERE key = 'lang' AND contains(value, 's')""",
)
def meta_filter_or(spark, d):
    return M.filter_ids(meta(spark, d), [("source", "start with", "SRC1"), ("quality", "<=", "0"), ("lang", "contains", "s")], "or")


@query(
    "meta_record_filter",
    """SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id)
 WHERE d.n_chars >= 500 AND coalesce(l.quality = 1, false) AND d.source NOT IN ('src0','src1')""",
)
def meta_record_filter(spark, d):
    return M.record_ids(meta(spark, d), [("n_chars", "≥", "500"), ("quality", "=", "1"), ("source", "not in", "src0,src1")])


@query(
    "meta_pushdown",
    """SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50 AND event_type LIKE '%c%'""",
)
def meta_pushdown(spark, d):
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    return table(spark, d, "events").where((k >= 50) & F.col("event_type").contains("c")).select("event_id")


@query("meta_manual_nomatch", "SELECT count(*) AS n FROM documents WHERE false")
def meta_manual_nomatch(spark, d):
    none = M.filter_ids(meta(spark, d), [("lang", "=", "nowhere")])
    return M.manual(table(spark, d, "documents"), none).agg(F.count("*").alias("n"))


@query(
    "meta_exact",
    f"""WITH {META} SELECT doc_id FROM meta WHERE key = 'lang' AND value IN ('en','fr')
 INTERSECT SELECT doc_id FROM meta WHERE key = 'source' AND value IN ('src2','src4','src6')""",
)
def meta_exact(spark, d):
    return M.filter_ids(meta(spark, d), [("lang", "in", ["en", "fr"]), ("source", "in", ["src2", "src4", "src6"])])


@query("meta_keys", f"WITH {META} SELECT DISTINCT key FROM meta")
def meta_keys(spark, d):
    return meta(spark, d).select("key").distinct()


@query(
    "meta_summary",
    f"""WITH {META}, c AS (SELECT key, value, count(*) AS n FROM meta GROUP BY ALL)
 SELECT key, value, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS value_rank,
 CASE WHEN regexp_matches(value, '^-?[0-9]+$') THEN 'number' ELSE 'string' END AS kind FROM c""",
)
def meta_summary(spark, d):
    return M.summary(meta(spark, d)).withColumn("kind", M.value_type(F.col("value")))


@query(
    "meta_inverted",
    f"""WITH {META} SELECT key, value, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS doc_ids
 FROM meta GROUP BY key, value""",
)
def meta_inverted(spark, d):
    return M.inverted(meta(spark, d))


@query(
    "list_documents",
    """SELECT d.doc_id, d.lang, d.source FROM documents d LEFT JOIN labels l USING (doc_id)
 WHERE contains(lower(d.text), 'the') AND d.lang IN ('en','de') AND d.n_chars BETWEEN 500 AND 20000 AND l.doc_id IS NULL""",
)
def list_documents(spark, d):
    docs = table(spark, d, "documents")
    rows = docs.where(F.col("lang").isin("en", "de") & F.col("n_chars").between(500, 20000) & F.lower("text").contains("the"))
    return rows.join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang", "source")


@query(
    "list_chunks",
    f"""WITH {CHUNKS} SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) AS position FROM chunks
 WHERE kb_id = 'src4' AND lower(content) LIKE '%an%' QUALIFY position BETWEEN 11 AND 30""",
)
def list_chunks(spark, d):
    """Second page of twenty, in order of position; the page is the feature."""
    rows = chunks(spark, d).where((F.col("kb_id") == "src4") & F.lower("content").contains("an"))
    return page(rows.select("chunk_id"), ["chunk_id"], 10, 20, "position")


def page(df, order, offset: int, limit: int, name: str):
    """Rows ``offset+1 .. offset+limit`` of the order; limit 0 is unlimited. Only the page is ranked in one task."""
    from pyspark.sql import Window

    top = df.orderBy(*order)
    top = top.offset(offset) if offset else top
    top = top.limit(limit) if limit else top
    return top.withColumn(name, (F.row_number().over(Window.orderBy(*order)) + offset).cast("long"))


@query(
    "session_search",
    """SELECT conv_id, count(*) AS turns FROM conversations GROUP BY conv_id
 HAVING bool_or(contains(lower(text), 'the')) AND count(*) >= 3""",
)
def session_search(spark, d):
    hit = F.max(F.lower("text").contains("the"))
    grouped = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), hit.alias("hit"))
    return grouped.where("hit AND turns >= 3").select("conv_id", "turns")


@query(
    "threshold_mask",
    """SELECT p_partkey, p_retailprice / (SELECT max(p_retailprice) FROM part) AS score, 'vector' AS kind FROM part
 WHERE p_retailprice / (SELECT max(p_retailprice) FROM part) >= 0.8
 UNION ALL SELECT p_partkey, p_retailprice / (SELECT max(p_retailprice) FROM part), 'term' FROM part""",
)
def threshold_mask(spark, d):
    part = table(spark, d, "part")
    most = part.agg(F.max("p_retailprice").alias("most"))
    rows = part.crossJoin(F.broadcast(most)).select("p_partkey", (F.col("p_retailprice") / F.col("most")).alias("score"))
    kinds = F.explode(F.array(F.struct(F.lit("vector").alias("kind"), F.lit(0.7).alias("w")), F.struct(F.lit("term").alias("kind"), F.lit(0.0).alias("w"))))
    rows = rows.withColumn("k", kinds)
    return rows.where(F.col("score") >= F.when(F.col("k.w") <= 0, 0.0).otherwise(0.8)).select("p_partkey", "score", "k.kind")


@query("grep_terms", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)\b(aned|ofthe|thand)')")
def grep_terms(spark, d):
    return table(spark, d, "documents").where(F.col("text").rlike(r"(?i)\b(aned|ofthe|thand)")).select("doc_id")


LINES = "lines AS (SELECT doc_id, unnest(str_split(text, chr(10))) AS line, generate_subscripts(str_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


def lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(
    "grep_context",
    f"""WITH {LINES}, m AS (SELECT *, max(CASE WHEN contains(lower(line), 'aned') THEN 1 ELSE 0 END)
 OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM lines)
 SELECT doc_id, CAST(line_no AS INT) AS line_no, line FROM m WHERE near = 1""",
)
def grep_context(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(-1, 1)
    hit = F.lower("line").contains("aned").cast("int")
    return lines(spark, d).withColumn("near", F.max(hit).over(w)).where("near = 1").select("doc_id", "line_no", "line")


@query(
    "is_table",
    """SELECT doc_id, (contains(lower(text), '<table') OR contains(lower(text), '<tr') OR len(list_filter(str_split(text, chr(10)),
 lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 3) AS is_table FROM documents""",
)
def is_table(spark, d):
    return table(spark, d, "documents").select("doc_id", T.is_table(F.col("text")).alias("is_table"))


@query(
    "fact_dense",
    f"""WITH {LINES} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE regexp_matches(line, '[0-9]') OR regexp_matches(line, '\\S\\s+[A-Z][a-z]+')) AS dense
 FROM lines GROUP BY doc_id""",
)
def fact_dense(spark, d):
    rows = lines(spark, d)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.is_fact_dense(F.col("line"))).alias("dense"))


@query("sql_kb_guard", f"WITH {CHUNKS} SELECT lang, count(*) AS n FROM chunks WHERE kb_id IN ('src1','src3') GROUP BY lang")
def sql_kb_guard(spark, d):
    """A user's statement sees only the rows of the knowledge bases it may read, whatever it selects."""
    return O.guarded_sql(spark, "SELECT lang, count(*) AS n FROM {chunks} GROUP BY lang", chunks(spark, d), ["src1", "src3"])


@query(
    "sql_text",
    r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace('```sql ' || text || ' ```', '```(sql)?', '', 'g'), '\s+', ' ', 'g')) AS bare,
 regexp_matches(text, '(?i)\b(count|sum|avg|max|min)\s*\(') AS aggregates FROM conversations""",
)
def sql_text(spark, d):
    fenced = F.concat(F.lit("```sql "), "text", F.lit(" ```"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(fenced, "```(sql)?", ""), r"\s+", " "))
    aggregates = F.col("text").rlike(r"(?i)\b(count|sum|avg|max|min)\s*\(")
    return table(spark, d, "conversations").select("conv_id", "turn", bare.alias("bare"), aggregates.alias("aggregates"))


@query(
    "tag_rewrite",
    """SELECT p_partkey, array_to_string(list_filter(list_transform(str_split(lower(p_type), ' '), lambda x: CASE WHEN x = 'small' THEN 'tiny' ELSE x END),
 lambda x: x <> 'brass'), ',') AS tags FROM part""",
)
def tag_rewrite(spark, d):
    tags = F.transform(F.split(F.lower("p_type"), " "), lambda x: F.when(x == "small", "tiny").otherwise(x))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_remove(tags, "brass"), ",").alias("tags"))


@query("token_counts", f"WITH {CHUNKS} SELECT kb_id, sum({sql_token_count('content')}) AS tokens, count(*) AS n FROM chunks GROUP BY kb_id")
def token_counts(spark, d):
    rows = chunks(spark, d).withColumn("t", T.token_count(F.col("content")))
    return rows.groupBy("kb_id").agg(F.sum("t").alias("tokens"), F.count("*").alias("n"))


@query("vector_norms", "SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.norm(F.col("embedding")).alias("norm"))
