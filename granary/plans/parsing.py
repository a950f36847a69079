"""File formats, connectors and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from granary.functions import text as T
from granary.sources import connectors as S
from granary.sources import formats as P
from granary.sources.staging import shared_folder

from .base import query, table
from .chunking import markdown


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


@query("txt_decode", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE text END AS text FROM documents")
def txt_decode(spark, d):
    """Texts with one of two byte order marks, without one, and with a byte that is no UTF-8."""
    k, t = F.col("doc_id") % 4, F.col("text")
    raw = F.when(k == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8"))).when(k == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE")))
    raw = raw.when(k == 2, F.encode(t, "UTF-8")).otherwise(F.concat(F.unhex(F.lit("C3")), F.encode(t, "UTF-8"), F.unhex(F.lit("C3"))))
    return table(spark, d, "documents").select("doc_id", P.decoded(raw).alias("text"))


@query("csv_rows", "SELECT p_partkey, p_name || ', \"new\"' AS name, p_size AS size, 'True' AS flag FROM part")
def csv_rows(spark, d):
    """A CSV text a part, with a quoted cell that holds a comma and quotes."""
    text = F.concat(F.lit('name,size,flag\r\n"'), "p_name", F.lit(', ""new""",'), F.col("p_size").cast("string"), F.lit(",True\r\n"))
    rows = table(spark, d, "part").select("p_partkey", F.explode(P.csv_rows(text, "name string, size int, flag string")).alias("r"))
    return rows.select("p_partkey", "r.*")


@query(
    "json_lines",
    """WITH l AS (SELECT user_id, list(CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1) ELSE props END ORDER BY event_id) AS l FROM events GROUP BY user_id)
 SELECT user_id, len(l) AS n, len(list_filter(l[1:10], lambda x: json_valid(x))) >= 0.8 * len(l[1:10]) AND len(list_filter(l[1:10], lambda x: json_valid(x))) > 0 AND NOT (len(l) = 1 AND json_valid(l[1])) AS is_lines FROM l""",
)
def json_lines(spark, d):
    raw = F.when(F.col("event_type") == "error", F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props"))
    each = F.transform(F.sort_array(F.collect_list(F.struct("event_id", raw.alias("raw")))), lambda x: x["raw"])
    rows = table(spark, d, "events").groupBy("user_id").agg(each.alias("l"))
    return rows.select("user_id", F.size("l").cast("long").alias("n"), P.is_json_lines(F.array_join("l", "\n")).alias("is_lines"))


@query(
    "json_flatten",
    """SELECT o_orderkey, unnest(['id', 'of.status', 'of.parts[0].n', 'of.parts[1].n', 'tags', 'none', 'a.b.c.d.e.f.g.h[0].i[0].j']) AS path,
 unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, '1', CAST(o_custkey AS VARCHAR), '[a, b]', 'null', o_orderpriority]) AS value FROM orders""",
)
def json_flatten(spark, d):
    raw = F.concat(
        F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit(', "of": {"status": "'), "o_orderstatus", F.lit('", "parts": [{"n": 1}, {"n": '),
        F.col("o_custkey").cast("string"), F.lit('}]}, "tags": ["a", "b"], "none": null, "a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": [{"i": [{"j": "'),
        "o_orderpriority", F.lit('"}]}]}}}}}}}}'),
    )
    return P.flattened(table(spark, d, "orders").select("o_orderkey", raw.alias("raw")), "o_orderkey", "raw")


@query("json_chunks")
def json_chunks(spark, d):
    """Customers of each nation with their fields, in objects of about 400 characters; a test compares pieces and whole."""
    fields = F.struct("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    rows = table(spark, d, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 20).alias("part"))
    raw = rows.agg(F.to_json(F.struct(F.sort_array(F.collect_list(fields)).alias("customers"))).alias("raw"))
    keyed = raw.select((F.col("c_nationkey") * 1_000_000 + F.col("part")).cast("long").alias("group"), "raw")
    return P.json_chunks(keyed, "group", "raw", 400)


@query(
    "markdown_elements",
    """SELECT p_partkey, unnest(range(0, 6)) AS n, unnest(['header', 'list', 'quote', 'code', 'table', 'text']) AS kind,
 unnest(['# ' || p_name, '- ' || p_brand || E'\\n- ' || p_type, '> quoted', E'```\\na\\n\\nb\\n```', E'| a | b |\\n|---|---|\\n| ' || p_size || ' | x |', 'Last line.']) AS content FROM part""",
)
def markdown_elements(spark, d):
    rows = markdown(spark, d).select("p_partkey", F.posexplode(P.markdown_elements(F.col("text"))).alias("n", "e"))
    return rows.select("p_partkey", F.col("n").cast("long").alias("n"), "e.kind", "e.content")


@query("markdown_tables", "SELECT p_partkey, unnest([0, 1]) AS row, unnest([['a', 'b'], [CAST(p_size AS VARCHAR), 'x']]) AS cells FROM part")
def markdown_tables(spark, d):
    rows = markdown(spark, d).select("p_partkey", F.posexplode(P.markdown_tables(F.col("text"))).alias("row", "cells"))
    return rows.withColumn("row", F.col("row").cast("long"))


@query("html_blocks", r"""SELECT page_id, len(regexp_extract_all(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', '', 'g'), '(?i)<h1[^>]*>[^<]*[^<\s]')) AS titles FROM pages""")
def html_blocks(spark, d):
    """How many blocks of a page are first-level headings with text."""
    blocks = P.html_blocks(F.coalesce("html", F.lit("")))
    return table(spark, d, "pages").select("page_id", F.size(F.filter(blocks, lambda b: (b["tag"] == "h1") & b["content"].startswith("# "))).cast("long").alias("titles"))


@query("file_connector", "SELECT n_name || '.txt' AS id, length(n_name) + 1 AS size, n_name AS content FROM nation")
def file_connector(spark, d):
    """Nations as one text file each, read back through Spark's file reader."""
    path = folder(spark, "nations")
    rows = table(spark, d, "nation").select("n_name", F.col("n_name").alias("value"))
    rows.write.partitionBy("n_name").text(path)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    name = F.regexp_extract("path", "n_name=([^/]+)/", 1)
    text = P.checked(P.decoded(F.col("content")), F.col("path"))
    return raw.select(F.concat(name, F.lit(".txt")).alias("id"), F.col("length").alias("size"), F.regexp_replace(text, r"\n$", "").alias("content"))


@query("snapshot_load", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def snapshot_load(spark, d):
    path = folder(spark, "snapshot")
    S.save_snapshot(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return S.load_snapshot(spark, path, "c_custkey long, c_name string, c_mktsegment string")[0]


@query("reports", "SELECT CAST(n_nationkey AS VARCHAR) AS id, '# ' || n_name || chr(10) || chr(10) || 'Region ' || n_regionkey AS value FROM nation")
def reports(spark, d):
    """A Markdown report a nation, written and read back."""
    path = folder(spark, "reports")
    body = F.concat(F.lit("Region "), F.col("n_regionkey").cast("string"))
    S.write_reports(table(spark, d, "nation").withColumn("body", body), "n_nationkey", "n_name", "body", "md", path)
    back = spark.read.option("lineSep", "\u001e").option("basePath", path).text(path)
    return back.select(F.col("id").cast("string").alias("id"), F.regexp_replace("value", r"\s+$", "").alias("value"))


@query("row_quarantine", "SELECT count(*) AS kept, 0 AS refused, CAST(sum(len(embedding)) AS BIGINT) AS numbers FROM embeddings")
def row_quarantine(spark, d):
    """Vectors of another length than their label's first are refused, not stored."""
    e = table(spark, d, "embeddings")
    first = e.groupBy("label").agg(F.min_by(F.size("embedding"), "vec_id").alias("wanted"))
    rows = e.join(F.broadcast(first), "label").withColumn("fits", F.size("embedding") == F.col("wanted"))
    return rows.agg(F.count_if("fits").alias("kept"), F.count_if(~F.col("fits")).alias("refused"), F.sum(F.when(F.col("fits"), F.size("embedding"))).alias("numbers"))


@query("text_fences", "SELECT conv_id, turn, trim(text) AS bare FROM conversations")
def text_fences(spark, d):
    fenced = F.concat(F.lit("```markdown\n"), F.trim("text"), F.lit("\n```"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.without_fence(fenced).alias("bare"))
