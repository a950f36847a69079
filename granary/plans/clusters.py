"""Near pairs and clusters of vectors, groups of names, graph records."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import clustering as K
from granary.operators import entities as En
from granary.operators import neighbours as N
from granary.operators import records as Rec
from granary.operators import trees as Tr

from .base import query, table


@query(
    "vector_pairs",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM e a JOIN e b ON a.vec_id < b.vec_id
 WHERE list_cosine_similarity(a.v, b.v) >= 0.4""",
)
def vector_pairs(spark, d):
    return N.near_pairs(table(spark, d, "embeddings"), "vec_id", "embedding", 0.4).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("vector_groups")
def vector_groups(spark, d):
    """Classes of vectors that are near duplicates; a test compares them with all pairs."""
    return N.near_groups(table(spark, d, "embeddings"), "vec_id", "embedding", 0.9)


def small_groups(spark, d):
    """Twenty vectors a group, as the chunks of a document."""
    return table(spark, d, "embeddings").withColumn("doc", F.floor(F.col("vec_id") / 20))


@query("agglomerate")
def agglomerate(spark, d):
    return K.agglomerate(small_groups(spark, d), "doc", "vec_id", "embedding", 0.3, 6)


@query("summary_tree")
def summary_tree(spark, d):
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    rows = small_groups(spark, d).join(texts, "vec_id")
    return K.summary_tree(rows, "doc", "vec_id", "text", "embedding", 0.3, 6, 3)


@query(
    "tree_search",
    """WITH e AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, vec_id // 20 AS low, vec_id // 100 AS high FROM embeddings),
 x AS (SELECT vec_id, low, high, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
 l AS MATERIALIZED (SELECT low, min(high) AS high, list(m ORDER BY i) AS v FROM (SELECT low, min(high) AS high, i, avg(x) AS m FROM x GROUP BY low, i) GROUP BY low),
 h AS MATERIALIZED (SELECT high, list(m ORDER BY i) AS v FROM (SELECT high, i, avg(x) AS m FROM x GROUP BY high, i) GROUP BY high),
 q AS (SELECT vec_id AS query, v FROM e WHERE vec_id % 100 = 0),
 a AS (SELECT query, q.v, high FROM q, h QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(h.v, q.v), 9) DESC, 'high:' || high) <= 3),
 b AS (SELECT query, a.v, low FROM a JOIN l USING (high) QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(l.v, a.v), 9) DESC, 'low:' || low) <= 3),
 c AS (SELECT query, 'leaf:' || vec_id AS node, round(list_cosine_similarity(e.v, b.v), 9) AS s FROM b JOIN e USING (low)),
 r AS (SELECT query, node, s, row_number() OVER (PARTITION BY query ORDER BY s DESC, node) - 1 AS rank FROM c)
 SELECT query, node, round(s, 6) AS score, rank FROM r WHERE rank < 3""",
)
def tree_search(spark, d):
    """Three results for every hundredth vector, by a beam of three through clusters of a hundred and of twenty."""
    e = table(spark, d, "embeddings").withColumns({"low": F.floor(F.col("vec_id") / 20), "high": F.floor(F.col("vec_id") / 100)})
    tree = Tr.mean_vectors(e.select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"), "low", "high"), ["low", "high"])
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.lit(1).alias("tree"), F.col("embedding").alias("vector"))
    return Tr.beam_search(tree.withColumn("tree", F.lit(1)), asked, 3, 3).withColumn("score", F.round("score", 6))


@query(
    "entity_reduce",
    """WITH RECURSIVE e AS (SELECT vec_id AS id, lower(trim('Name ' || vec_id % 300)) AS name, CASE WHEN vec_id % 2 = 0 THEN 'NAME  ' ELSE ' name ' END || vec_id % 300 AS spelling, embedding::DOUBLE[] AS v, label FROM embeddings),
 k AS MATERIALIZED (SELECT name, min(id) AS first, arg_min(v, id) AS v FROM e GROUP BY name),
 p AS MATERIALIZED (SELECT x.first AS a, y.first AS b FROM k x JOIN k y ON x.first <> y.first WHERE list_cosine_similarity(x.v, y.v) >= 0.38),
 r AS (SELECT first AS id, first AS root FROM k UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.id),
 c AS (SELECT id AS first, min(root) AS entity_id FROM r GROUP BY id),
 m AS (SELECT e.*, c.entity_id, d.text FROM e JOIN k USING (name) JOIN c ON c.first = k.first LEFT JOIN documents d ON d.doc_id = e.id)
 SELECT entity_id, arg_max(spelling, {'m': coalesce(label, 0), 'i': -id}) AS name, arg_max(text, {'l': length(text), 'i': -id}) FILTER (WHERE text IS NOT NULL) AS description,
 sum(label)::BIGINT AS mentions, count(*) AS n FROM m GROUP BY entity_id""",
)
def entity_reduce(spark, d):
    """Records with one name or near vectors as one entity, with its most mentioned name and longest text."""
    spelling = F.concat(F.when(F.col("vec_id") % 2 == 0, "NAME  ").otherwise(" name "), (F.col("vec_id") % 300).cast("string"))
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("description"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), spelling.alias("name"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("mentions"))
    return En.reduced(e.join(texts, "id", "left"), En.resolved(e, 0.38, exact=True))


@query("balanced_clusters")
def balanced_clusters(spark, d):
    return K.balanced_clusters(table(spark, d, "embeddings"), "vec_id", "embedding", 5)


@query(
    "extract_summaries",
    r"""WITH m AS (SELECT conv_id, turn, text AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
 s AS (SELECT conv_id, i, t, trim(string_split_regex(t, '[.。!?\n]')[1]) AS s FROM m WHERE i <= 5)
 SELECT conv_id, CASE WHEN count(*) FILTER (WHERE length(s) > 5) > 0 THEN string_agg(s, '. ' ORDER BY i) FILTER (WHERE length(s) > 5) || '.' ELSE left(min(t) FILTER (WHERE i = 1), 200) END AS summary FROM s GROUP BY conv_id""",
)
def extract_summaries(spark, d):
    return K.summaries(table(spark, d, "conversations"), ["conv_id"], "turn", "text")


@query(
    "entity_groups",
    """WITH RECURSIVE p AS (SELECT DISTINCT p_name AS name FROM part), g AS (SELECT name, list_distinct(list_transform(range(1, length(name)), lambda i: lower(name)[i:i+1])) AS g FROM p),
 e AS (SELECT a.name AS a, b.name AS b FROM g a JOIN g b ON a.name <> b.name WHERE len(list_intersect(a.g, b.g)) >= 0.6 * len(list_distinct(list_concat(a.g, b.g)))),
 r AS (SELECT name, name AS c FROM p UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.name) SELECT name, min(c) AS group_id FROM r GROUP BY name""",
)
def entity_groups(spark, d):
    """Part names linked where six in ten of their character pairs are common."""
    names = table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return K.name_groups(names, "name", "name", 0.6)


@query(
    "graph_records",
    """SELECT n_nationkey AS chunk, 'entity' AS kind, upper(n_name) AS a, 'PLACE' AS b, 'the ' || n_name AS description, NULL AS weight FROM nation
 UNION ALL SELECT n_nationkey, 'relation', upper(n_name), 'REGION', 'lies in', 2.5 FROM nation""",
)
def graph_records(spark, d):
    """Entities and relations from delimited records; broken records are skipped."""
    n = F.col("n_name")
    text = F.concat(
        F.lit('("entity"<|>'), n, F.lit("<|>place<|>the "), n, F.lit(')##broken("x"##("relationship"<|>'), n, F.lit("<|>region<|>lies in<|>k<|>2.5)<|COMPLETE|>"),
    )
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("chunk"), F.explode(Rec.extraction_records(text)).alias("r"))
    return rows.select("chunk", "r.*")


@query(
    "kg_context",
    """WITH e AS (SELECT DISTINCT lower(s_name) AS name, lower(n_name) AS other FROM supplier JOIN nation ON n_nationkey = s_nationkey)
 SELECT name, other FROM e WHERE contains('trade of nation_1 and nation_2 with', other) ORDER BY name, other LIMIT 20""",
)
def kg_context(spark, d):
    """Edges with an end that a question names, at most 20."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.lower("n_name").alias("other"))
    edges = table(spark, d, "supplier").join(F.broadcast(n), "s_nationkey").select(F.lower("s_name").alias("name"), "other").distinct()
    return Rec.named_edges(edges, "other", "trade of nation_1 and nation_2 with").orderBy("name", "other").limit(20)


@query("claim_dedup", "SELECT lower(trim(o_orderpriority)) AS claim, o_orderstatus AS subject, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL")
def claim_dedup(spark, d):
    return Rec.distinct_claims(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_orderkey").select("claim", F.col("o_orderstatus").alias("subject"), "n", "first")


@query("kg_relations", """WITH e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), s AS (SELECT s_suppkey AS src, 0.5 AS sim FROM supplier WHERE s_acctbal > 5000),
 t AS (SELECT p_partkey AS dst FROM part WHERE p_size > 45) SELECT e.src, e.dst, round(sim / 2 * (1 + CASE WHEN t.dst IS NULL THEN 0 ELSE 1 END), 6) AS score FROM e JOIN s USING (src) LEFT JOIN t USING (dst)""")
def kg_relations(spark, d):
    """Relations found one hop from the entities of a question: half their similarity, doubled by an end of a wanted type."""
    edges = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    seeds = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("src"), F.lit(0.5).alias("sim"))
    types = table(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("dst"))
    found = Rec.relation_scores(edges, seeds, types)
    return found.select("src", "dst", F.round("score", 6).alias("score"))


@query("kg_type_pool", "SELECT p_type AS type, count(*) AS n, list_sort(list(DISTINCT p_name))[1:3] AS names FROM part GROUP BY p_type")
def kg_type_pool(spark, d):
    names = F.slice(F.sort_array(F.collect_set("p_name")), 1, 3)
    return table(spark, d, "part").groupBy(F.col("p_type").alias("type")).agg(F.count("*").alias("n"), names.alias("names"))


@query("tidy_graph", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_acctbal > 0")
def tidy_graph(spark, d):
    """Nodes without a description or a source go."""
    s = table(spark, d, "supplier").withColumn("description", F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise(""))
    return Rec.tidy(s, "description", "s_nationkey").select("s_suppkey", "s_nationkey")


@query("similar_titles", """WITH p AS (SELECT DISTINCT p_name AS n, list_distinct(list_transform(range(1, length(p_name)), lambda i: lower(p_name)[i:i+1])) AS g FROM part)
 SELECT a.n AS a, b.n AS b, round(len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM p a JOIN p b ON a.n < b.n
 WHERE len(list_intersect(a.g, b.g)) >= 0.5 * len(list_distinct(list_concat(a.g, b.g)))""")
def similar_titles(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("n")).distinct()
    return K.similar_names(names, "n", "n", 0.5).select("a", "b", F.round("similarity", 6).alias("similarity"))


