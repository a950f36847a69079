"""Joins, aggregations, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions import vectors as V
from granary.operators import merging as G
from granary.operators import metrics as X

from .base import CHUNKS, chunks, query, sql_token_count, sql_tokens, table
from .scans import META, lines, meta, page

# ── joins ────────────────────────────────────────────────────────────────────


@query(
    "join_left_default",
    """SELECT c_custkey, coalesce(n_name, 'Unknown') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n
 ON c_nationkey = n_nationkey""",
)
def join_left_default(spark, d):
    nation = table(spark, d, "nation").where("n_regionkey <> 2")
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select("c_custkey", F.coalesce("n_name", F.lit("Unknown")).alias("nation"))


@query("join_enrich", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_enrich(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "source", "quality", "toxic")


@query("join_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def join_semi(spark, d):
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(ids, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("join_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def join_anti(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query(
    "entity_pairs",
    """SELECT a.s_name AS a, b.s_name AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_name < b.s_name
 WHERE levenshtein(a.s_name, b.s_name) <= 2""",
)
def entity_pairs(spark, d):
    """Names of one type that differ by at most two edits; the pairs of a type are the result."""
    return G.edit_pairs(table(spark, d, "supplier"), "s_nationkey", "s_name", 2)


@query(
    "near_dup_pairs",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))))
 ELSE [array_to_string(w, ' ')] END AS s FROM w WHERE len(w) > 0),
 c AS (SELECT min(doc_id) AS id, s FROM s GROUP BY s),
 e AS (SELECT id, unnest(s) AS g FROM c),
 p AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM e x JOIN e y ON x.g = y.g AND x.id < y.id GROUP BY ALL)
 SELECT 'pair' AS kind, a, b, n / (len(ca.s) + len(cb.s) - n) AS similarity FROM p JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b
 WHERE n / (len(ca.s) + len(cb.s) - n) >= 0.8 UNION ALL SELECT 'member', c.id, s.doc_id, 1.0 FROM s JOIN c USING (s) WHERE c.id <> s.doc_id""",
)
def near_dup_pairs(spark, d):
    """Pairs of classes of equal texts, and the further members of each class."""
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")
    docs = table(spark, d, "documents").select("doc_id", T.shingles(words, 5).alias("s"))
    sets, copies = G.hashed_sets(docs, "doc_id", "s")
    pairs = G.near_set_pairs(sets, copies, "doc_id", 0.8).select(F.lit("pair").alias("kind"), "a", "b", "similarity")
    return pairs.unionByName(copies.select(F.lit("member").alias("kind"), F.col("id").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("similarity")))


@query(
    "interval_overlap",
    """WITH o AS (SELECT o_custkey, o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) AS s,
 CASE WHEN o_orderstatus = 'O' THEN 2099 * 12 + 12 ELSE year(o_orderdate) * 12 + month(o_orderdate) + 2 END AS e FROM orders)
 SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey
 WHERE a.s <= b.e AND b.s <= a.e""",
)
def interval_overlap(spark, d):
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    end = F.when(F.col("o_orderstatus") == "O", 2099 * 12 + 12).otherwise(month + 2)
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", month.alias("s"), end.alias("e"))
    a, b = o.toDF("c", "a", "s1", "e1"), o.toDF("c", "b", "s2", "e2")
    return a.join(b, "c").where("a < b AND s1 <= e2 AND s2 <= e1").select("a", "b")


@query(
    "link_resolve",
    r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '([^/]+)/?$', 1) AS slug FROM pages),
 first AS (SELECT slug, min(page_id) AS target FROM p GROUP BY slug),
 links AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]+)"', 1))) AS href FROM pages)
 SELECT page_id, href, coalesce(u.target, f.target) AS target FROM links
 LEFT JOIN (SELECT url, min(page_id) AS target FROM pages GROUP BY url) u ON u.url = href
 LEFT JOIN first f ON f.slug = regexp_extract(href, '([^/]+)/?$', 1)""",
)
def link_resolve(spark, d):
    pages = table(spark, d, "pages")
    slug = lambda c: F.regexp_extract(c, r"([^/]+)/?$", 1)
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    links = pages.select("page_id", F.explode(hrefs).alias("href")).withColumn("slug", slug("href"))
    by_url = pages.groupBy(F.col("url").alias("href")).agg(F.min("page_id").alias("u"))
    by_slug = pages.groupBy(slug("url").alias("slug")).agg(F.min("page_id").alias("f"))
    return links.join(by_url, "href", "left").join(by_slug, "slug", "left").select("page_id", "href", F.coalesce("u", "f").alias("target"))


@query(
    "sheet_merge",
    """SELECT coalesce(c.n, s.n) AS nation, customers, suppliers FROM (SELECT c_nationkey AS n, count(*) AS customers FROM customer GROUP BY 1) c
 FULL JOIN (SELECT s_nationkey AS n, count(*) AS suppliers FROM supplier GROUP BY 1) s ON c.n = s.n""",
)
def sheet_merge(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "nation", "full_outer")


@query(
    "graph_endpoint_join",
    """WITH k AS (SELECT lower(trim(n_name)) AS key, min(n_nationkey) AS id FROM nation GROUP BY 1 HAVING count(DISTINCT n_nationkey) = 1)
 SELECT p_partkey, lower(trim(split_part(p_name, ' ', 1))) AS raw, coalesce(CAST(k.id AS VARCHAR), split_part(p_name, ' ', 1)) AS endpoint
 FROM part LEFT JOIN k ON k.key = lower(trim(split_part(p_name, ' ', 1)))""",
)
def graph_endpoint_join(spark, d):
    key = lambda c: F.lower(F.trim(c))
    names = table(spark, d, "nation").groupBy(key("n_name").alias("raw"))
    names = names.agg(F.min("n_nationkey").alias("id"), F.countDistinct("n_nationkey").alias("n")).where("n = 1")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    rows = table(spark, d, "part").select("p_partkey", key(first).alias("raw"), first.alias("given"))
    return rows.join(names, "raw", "left").select("p_partkey", "raw", F.coalesce(F.col("id").cast("string"), "given").alias("endpoint"))


# ── aggregations ─────────────────────────────────────────────────────────────


@query("doc_aggs", f"WITH {CHUNKS} SELECT doc_name, count(*) AS n, min(chunk_id) AS first_id FROM chunks WHERE contains(content, 'the') GROUP BY doc_name")
def doc_aggs(spark, d):
    hits = chunks(spark, d).where(F.col("content").contains("the"))
    return hits.groupBy("doc_name").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"))


@query("field_agg", "SELECT value, count(*) AS n FROM (SELECT unnest(str_split(p_type, ' ')) AS value FROM part) WHERE trim(value) <> '' GROUP BY value")
def field_agg(spark, d):
    rows = table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("value"))
    return rows.where(F.trim("value") != "").groupBy("value").agg(F.count("*").alias("n"))


@query(
    "tag_agg",
    """WITH t AS (SELECT p_partkey, unnest(str_split(replace(p_type, ' ', '###'), '###')) AS tag FROM part)
 SELECT tag, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey), tag) AS tag_rank FROM t GROUP BY tag""",
)
def tag_agg(spark, d):
    tags = table(spark, d, "part").select("p_partkey", F.explode(F.split(F.replace("p_type", F.lit(" "), F.lit("###")), "###")).alias("tag"))
    counts = tags.groupBy("tag").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first", "tag"))
    return counts.select("tag", "n", rank.cast("long").alias("tag_rank"))


@query("tag_counts", "SELECT p_brand AS tag, count(*) AS n, min(p_size) AS least FROM part GROUP BY p_brand")
def tag_counts(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("tag")).agg(F.count("*").alias("n"), F.min("p_size").alias("least"))


@query(
    "facets",
    """SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""",
)
def facets(spark, d):
    from pyspark.sql import functions as f

    docs = table(spark, d, "documents")
    return docs.groupingSets([["lang"], ["source"], []], "lang", "source").agg(f.count("*").alias("n"))


@query(
    "status_pivot",
    """SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS "F", count(*) FILTER (WHERE o_orderstatus = 'O') AS "O",
 count(*) FILTER (WHERE o_orderstatus = 'P') AS "P" FROM orders GROUP BY o_orderpriority""",
)
def status_pivot(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)


ENT = """ent AS (SELECT l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_linenumber > 3 THEN upper(p_name) ELSE p_name END AS name,
 CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS kind, p_type || repeat('!', CAST(l_linenumber AS INT)) AS text,
 CAST(l_quantity AS BIGINT) AS mentions FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def entities(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_linenumber") > 3, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("kind"),
        F.concat("p_type", F.repeat(F.lit("!"), F.col("l_linenumber"))).alias("text"),
        F.col("l_quantity").cast("long").alias("mentions"),
    )


@query(
    "entity_merge",
    f"""WITH {ENT}, r AS (SELECT *, lower(trim(name)) AS name_key, coalesce(kind, 'unknown') AS k FROM ent),
 b AS (SELECT *, row_number() OVER (PARTITION BY name_key, k ORDER BY length(text) DESC, ord) AS rn FROM r)
 SELECT name_key, k AS kind, max(name) FILTER (WHERE rn = 1) AS name, max(text) FILTER (WHERE rn = 1) AS description,
 CAST(sum(mentions) AS BIGINT) AS mentions, count(DISTINCT ord) AS sources FROM b GROUP BY name_key, k""",
)
def entity_merge(spark, d):
    return G.merge_entities(entities(spark, d), "name", "kind", "ord", "text", "mentions")


@query(
    "relation_merge",
    """SELECT lower(trim(p_brand)) AS src, coalesce(nullif(lower(trim(CASE WHEN l_linestatus = 'O' THEN ' ' ELSE 'Sold ' END)), ''), 'related') AS kind,
 lower(trim(s_name)) AS dst, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS weight, count(*) AS n
 FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""",
)
def relation_merge(spark, d):
    rows = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.withColumn("kind", F.when(F.col("l_linestatus") == "O", " ").otherwise("Sold ")).withColumn("w", F.col("l_quantity").cast("long"))
    return G.merge_relations(rows, "p_brand", "s_name", "kind", "w")


@query(
    "exact_dedup",
    f"""WITH {ENT} SELECT regexp_replace(lower(trim(name)), '\\s+', ' ', 'g') AS name_key, arg_min(name, ord) AS name,
 count(DISTINCT name) AS spellings, CAST(sum(mentions) AS BIGINT) AS mentions FROM ent GROUP BY 1""",
)
def exact_dedup(spark, d):
    return G.exact_dedup(entities(spark, d), "name", "ord", "mentions")


@query(
    "graph_record_merge",
    """WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY ALL),
 b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS r FROM c)
 SELECT b.o_custkey, b.o_orderpriority AS kind, (SELECT string_agg(DISTINCT o_orderstatus, '<SEP>' ORDER BY o_orderstatus)
 FROM orders o WHERE o.o_custkey = b.o_custkey) AS descriptions FROM b WHERE r = 1""",
)
def graph_record_merge(spark, d):
    orders = table(spark, d, "orders")
    kind = G.most_common(orders, ["o_custkey"], "o_orderpriority", "o_orderkey").withColumnRenamed("o_orderpriority", "kind")
    text = F.array_join(F.sort_array(F.collect_set("o_orderstatus")), "<SEP>")
    return kind.join(orders.groupBy("o_custkey").agg(text.alias("descriptions")), "o_custkey")


@query("latency_stats", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c FROM events)
 SELECT event_type, count(*) AS n, avg(value) AS mean, max(CASE WHEN i = round((c - 1) * 0.5) THEN value END) AS p50,
 max(CASE WHEN i = round((c - 1) * 0.95) THEN value END) AS p95, max(value) AS most FROM r GROUP BY event_type""")
def latency_stats(spark, d):
    return X.nearest_rank(table(spark, d, "events"), ["event_type"], "value")


@query("pct_linear", "SELECT event_type, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.9) AS p90 FROM events GROUP BY event_type")
def pct_linear(spark, d):
    p = lambda q: F.percentile("value", F.lit(q))
    return table(spark, d, "events").groupBy("event_type").agg(p(0.1).alias("p10"), p(0.9).alias("p90"))


@query("phase_stats", """SELECT event_type, count(*) AS calls, count(*) FILTER (WHERE value < 10) AS failures, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens,
 min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type""")
def phase_stats(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(
        F.count("*").alias("calls"), F.count_if(F.col("value") < 10).alias("failures"), F.sum(k).alias("tokens"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


@query("duration_hist", "SELECT event_type, CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY ALL")
def duration_hist(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.floor(F.col("value") / 10).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "centroids",
    """WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
 SELECT label, CAST(pos AS INT) AS pos, avg(x) AS x FROM e GROUP BY ALL""",
)
def centroids(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return rows.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))


@query("approx_distinct")
def approx_distinct(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(
        F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("median")
    )


# ── windows, order, sets ─────────────────────────────────────────────────────


@query("rank_assign", "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders")
def rank_assign(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.row_number().over(w) - 1).cast("long").alias("rank"))


@query("topk_per_query", "SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def topk_per_query(spark, d):
    """Three dearest lines of each part; the limit is the feature."""
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").withColumn("r", F.row_number().over(w)).where("r <= 3").select("l_partkey", "l_orderkey", "l_linenumber")


@query(
    "chunk_context",
    """SELECT conv_id, turn, array_to_string(list_filter([lag(CASE WHEN role = 'user' THEN text END, 3) OVER w, lag(CASE WHEN role = 'user' THEN text END, 2) OVER w,
 lag(CASE WHEN role = 'user' THEN text END, 1) OVER w], lambda x: x IS NOT NULL), ' ') AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def chunk_context(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-3, -1)
    before = F.collect_list(F.when(F.col("role") == "user", F.col("text"))).over(w)
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(before, " ").alias("before"))


@query(
    "adjacent_clusters",
    """WITH e AS (SELECT label, vec_id, list_cosine_similarity(embedding::DOUBLE[], lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id)) AS sim FROM embeddings),
 t AS (SELECT *, quantile_cont(sim, 0.3) OVER (PARTITION BY label) AS cut FROM e)
 SELECT label, vec_id, CAST(sum(CASE WHEN sim < cut - 1e-9 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id) AS BIGINT) AS cluster_id FROM t""",
)
def adjacent_clusters(spark, d):
    """A new cluster starts where a vector is less like the one before than the 30th percentile."""
    w = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, d, "embeddings").withColumn("before", F.lag("embedding").over(w))
    e = e.withColumn("sim", F.when(F.col("before").isNotNull(), V.cosine(F.col("embedding"), F.col("before"))))
    cut = e.groupBy("label").agg(F.percentile("sim", F.lit(0.3)).alias("cut"))
    starts = F.coalesce((F.col("sim") < F.col("cut") - 1e-9).cast("int"), F.lit(0))
    return e.join(F.broadcast(cut), "label").select("label", "vec_id", F.sum(starts).over(w).alias("cluster_id"))


@query(
    "sentence_window",
    """WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda x: trim(x)), lambda x: x <> '')) AS s,
 generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '\n'), lambda x: trim(x)), lambda x: x <> ''), 1) - 1 AS pos FROM documents),
 m AS (SELECT *, max(contains(s, 'oring')) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM s)
 SELECT doc_id, CAST(pos AS INT) AS pos, s AS sentence FROM m WHERE near""",
)
def sentence_window(spark, d):
    parts = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("pos", "sentence"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(-2, 2)
    return rows.withColumn("near", F.max(F.col("sentence").contains("oring")).over(w)).where("near").drop("near")


@query(
    "bigrams",
    f"""WITH t AS (SELECT conv_id, turn, {sql_tokens("text")} AS t FROM conversations), p AS (SELECT unnest(list_transform(range(1, len(t)),
 lambda i: t[i] || ' ' || t[i+1])) AS bigram FROM t) SELECT bigram, count(*) AS n FROM p GROUP BY bigram""",
)
def bigrams(spark, d):
    t = table(spark, d, "conversations").select(T.tokens(F.col("text")).alias("t"))
    pairs = F.when(F.size("t") > 1, F.transform(F.sequence(F.lit(1), F.size("t") - 1), lambda i: F.array_join(F.slice("t", i, 2), " ")))
    return t.select(F.explode(pairs).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


@query("session_stats", f"""SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS rounds,
 CAST(sum({sql_token_count('text')}) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id""")
def session_stats(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("rounds"), F.sum(T.token_count(F.col("text"))).alias("tokens")
    )


@query("paging", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank BETWEEN 41 AND 60")
def paging(spark, d):
    return page(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 40, 20, "rank").select("o_orderkey", "rank")


@query("block_page", "SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part QUALIFY rank BETWEEN 65 AND 74")
def block_page(spark, d):
    """First page of the second rerank window of 64."""
    return page(table(spark, d, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], 64, 10, "rank").select("p_partkey", "rank")


@query(
    "json_sort",
    """WITH v AS (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 2 ELSE 3 END AS kind, value, props FROM events)
 SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY kind, CASE WHEN kind = 2 THEN value END NULLS FIRST, CASE WHEN kind = 3 THEN props END NULLS FIRST, event_id) AS rank FROM v""",
)
def json_sort(spark, d):
    """Mixed values in the order null, number, string, then by value."""
    kind = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 2).otherwise(3)
    rows = table(spark, d, "events").withColumn("kind", kind)
    order = [F.col("kind"), F.when(F.col("kind") == 2, F.col("value")).asc_nulls_first(), F.when(F.col("kind") == 3, F.col("props")).asc_nulls_first()]
    return rows.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(*order, "event_id")).cast("long").alias("rank"))


@query(
    "term_rank",
    """WITH h AS (SELECT doc_id, source, CAST(contains(lower(text), 'anthat') AS INT) + CAST(contains(lower(text), 'erand') AS INT) + CAST(contains(lower(text), 'onthe') AS INT) AS hits FROM documents)
 SELECT doc_id, hits, row_number() OVER (PARTITION BY source ORDER BY hits DESC, doc_id) AS rank FROM h WHERE hits > 0""",
)
def term_rank(spark, d):
    hits = sum((F.lower("text").contains(t).cast("int") for t in ("anthat", "erand", "onthe")), F.lit(0))
    rows = table(spark, d, "documents").select("doc_id", "source", hits.alias("hits")).where("hits > 0")
    return rows.select("doc_id", "hits", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("hits"), "doc_id")).cast("long").alias("rank"))


@query("stride_sample", "SELECT doc_id, source FROM documents QUALIFY (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 7 = 0")
def stride_sample(spark, d):
    """Every seventh document of a source: sampling is the operator."""
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, d, "documents").withColumn("i", F.row_number().over(w) - 1).where("i % 7 = 0").select("doc_id", "source")


@query(
    "multi_query_union",
    """WITH a AS (SELECT p_partkey, 1 AS q FROM part WHERE p_brand = 'Brand#11'), b AS (SELECT p_partkey, 2 AS q FROM part WHERE p_size > 25)
 SELECT p_partkey, min(q) AS first_query FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY p_partkey""",
)
def multi_query_union(spark, d):
    part = table(spark, d, "part")
    a = part.where("p_brand = 'Brand#11'").select("p_partkey", F.lit(1).alias("q"))
    b = part.where("p_size > 25").select("p_partkey", F.lit(2).alias("q"))
    return a.unionByName(b).groupBy("p_partkey").agg(F.min("q").alias("first_query"))


@query("stale_docs", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def stale_docs(spark, d):
    return table(spark, d, "documents").select("doc_id").subtract(table(spark, d, "labels").select("doc_id"))


@query("array_union_ordered", """SELECT p_partkey, array_to_string(list_concat(str_split(p_type, ' '), list_filter(str_split(p_name, ' '), lambda x: NOT list_contains(str_split(p_type, ' '), x))), ' ') AS words
 FROM (SELECT p_partkey, p_type, p_name FROM part)""")
def array_union_ordered(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_union(F.split("p_type", " "), F.split("p_name", " ")), " ").alias("words"))


@query(
    "evidence_merge",
    """WITH a AS (SELECT user_id, event_id, 0 AS src FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id, 1 FROM events WHERE value > 50),
 u AS (SELECT user_id, event_id, min(src) AS src FROM a GROUP BY ALL)
 SELECT user_id, event_id FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY src, event_id) <= 60""",
)
def evidence_merge(spark, d):
    """Pools of at most sixty pieces of evidence; the limit is the feature."""
    e = table(spark, d, "events")
    both = e.where("event_type = 'click'").select("user_id", "event_id", F.lit(0).alias("src"))
    both = both.unionByName(e.where("value > 50").select("user_id", "event_id", F.lit(1).alias("src")))
    pool = both.groupBy("user_id", "event_id").agg(F.min("src").alias("src"))
    w = Window.partitionBy("user_id").orderBy("src", "event_id")
    return pool.withColumn("r", F.row_number().over(w)).where("r <= 60").select("user_id", "event_id")


@query(
    "feedback_split",
    """WITH m AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE o_totalprice END AS size FROM orders),
 r AS (SELECT *, 20 * size / sum(size) OVER (PARTITION BY o_custkey) AS raw FROM m),
 f AS (SELECT *, floor(raw) AS part, 20 - sum(floor(raw)) OVER (PARTITION BY o_custkey) AS rest,
 row_number() OVER (PARTITION BY o_custkey ORDER BY round(raw - floor(raw), 9) DESC, o_orderkey) AS rn FROM r)
 SELECT o_custkey, o_orderkey, CAST(part + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS delta FROM f""",
)
def feedback_split(spark, d):
    signal = F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(F.col("o_totalprice"))
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", signal.alias("signal"))
    return X.split_budget(rows, "o_custkey", "o_orderkey", "signal", 20).select("o_custkey", "o_orderkey", "delta")


@query("list_ops", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles, max_by(role, turn) AS last, min_by(role, turn) AS first, count(DISTINCT role) AS n_roles FROM conversations GROUP BY conv_id")
def list_ops(spark, d):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role")))
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(rows, lambda x: x["role"]).alias("l"))
    return lists.select(
        "conv_id", F.array_join("l", ",").alias("roles"), F.element_at("l", -1).alias("last"), F.element_at("l", 1).alias("first"),
        F.size(F.array_distinct("l")).cast("long").alias("n_roles"),
    )


@query("data_ops", """SELECT event_id, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k1 FROM events""")
def data_ops(spark, d):
    """Map operations: keep keys, rename, combine, change a value."""
    m = F.map_concat(F.from_json("props", "map<string,long>"), F.create_map(F.lit("x"), F.lit(0).cast("long")))
    m = F.map_filter(F.transform_keys(m, lambda k, v: F.when(k == "k", "k1").otherwise(k)), lambda k, v: k != "x")
    return table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), (F.element_at(m, "k1") + 1).alias("k1"))
