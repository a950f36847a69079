"""Chunking: one document becomes many rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import chunking as C
from granary.operators import outline as Ol

from .base import query, sql_token_count, table

CUT = r"'[\n!?;。；！？]'"
LEVELS = ["^[A-Z][a-z]*ing", "^(The|An|Der|Les|La) ?"]


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_keep(text: str, pattern: str) -> str:
    """Parts that end with a delimiter."""
    return f"string_split(regexp_replace({text}, '({pattern})', '\\1' || chr(1), 'g'), chr(1))"


SECTIONS = f"list_filter(list_transform(string_split_regex(text, {CUT}), lambda x: {sql_strip('x')}), lambda x: x <> '')"
PLAIN_TOKENS = sql_token_count


def sql_fold(parts: str, budget: int, joiner: str, tail: str = "''") -> str:
    """Chunks of ``parts`` as a list, by the same fold."""
    joined = f"CASE WHEN {tail} = '' THEN x.now ELSE {tail} || {joiner} || x.now END"
    state = f"""list_reduce(list_transform({parts}, lambda p: {{'done': []::VARCHAR[], 'now': p}}), lambda a, x:
 CASE WHEN {PLAIN_TOKENS('a.now')} + {PLAIN_TOKENS('x.now')} > {budget} THEN {{'done': list_append(a.done, a.now), 'now': {joined}}}
 ELSE {{'done': a.done, 'now': a.now || {joiner} || x.now}} END)"""
    return f"(CASE WHEN len({parts}) = 0 THEN []::VARCHAR[] ELSE list_append(({state}).done, ({state}).now) END)"


def sql_rows(chunks: str, source: str = "documents") -> str:
    return f"""WITH c AS (SELECT doc_id, {chunks} AS c FROM {source}), r AS (SELECT doc_id, unnest(c) AS content, generate_subscripts(c, 1) - 1 AS position FROM c)
 SELECT doc_id, position, content, {PLAIN_TOKENS('content')} AS token_count FROM r"""


@query("chunk_naive", sql_rows(sql_fold("s", 128, "E'\\n!?;。；！？'"), f"(SELECT doc_id, {SECTIONS} AS s FROM documents)"))
def chunk_naive(spark, d):
    return C.rows(table(spark, d, "documents"), "doc_id", C.strategy("naive")(F.col("text"), 128))


CUT_LONG = f"""list_filter(flatten(list_transform({SECTIONS}, lambda s: CASE WHEN {PLAIN_TOKENS('s')} > 64 THEN {sql_keep('s', '[。!?？；！' + chr(10) + ']|[.] ')} ELSE [s] END)), lambda x: x <> '')"""


@query("chunk_token", sql_rows(sql_fold("s", 64, "E'\\n'", "right(a.now, 6)"), f"(SELECT doc_id, {CUT_LONG} AS s FROM documents)"))
def chunk_token(spark, d):
    """Up to 64 tokens; sections above that are cut at sentences; a tenth of the budget repeats."""
    return C.rows(table(spark, d, "documents"), "doc_id", C.strategy("token")(F.col("text"), 64, overlap=0.1))


BY_DELIMITER = f"list_filter({sql_keep('text', '[.,]')}, lambda x: {sql_strip('x')} <> '')"


@query("chunk_delimiter", sql_rows(BY_DELIMITER))
def chunk_delimiter(spark, d):
    return C.rows(table(spark, d, "documents"), "doc_id", C.by_delimiters(F.col("text"), [".", ","]))


@query(
    "chunk_children",
    f"""WITH c AS (SELECT doc_id, unnest({sql_keep('text', chr(10))}) AS chunk FROM documents), k AS (SELECT doc_id, chunk, list_filter({sql_keep('chunk', '[.]')}, lambda x: x <> '') AS parts FROM c WHERE {sql_strip('chunk')} <> ''),
 r AS (SELECT doc_id, CASE WHEN len(parts) > 1 THEN chunk END AS mom, unnest(CASE WHEN len(parts) > 1 THEN parts ELSE [chunk] END) AS content FROM k)
 SELECT doc_id, mom, content, count(*) AS n FROM r WHERE {sql_strip('content')} <> '' GROUP BY ALL""",
)
def chunk_children(spark, d):
    """Lines, and the sentences in them with the line as ``mom``."""
    lines = table(spark, d, "documents").select("doc_id", F.explode(C.by_delimiters(F.col("text"), ["\n"])).alias("line"))
    lines = lines.groupBy("doc_id", "line").agg(F.count("*").alias("times"))
    kids = lines.select("doc_id", "times", F.explode(C.counted_children(F.col("line"), ["."])).alias("k"))
    return kids.select("doc_id", "k.mom", "k.content", (F.col("k.n") * F.col("times")).alias("n"))


@query("chunk_one", f"SELECT doc_id, 0 AS position, {sql_strip('text')} AS content, {PLAIN_TOKENS(sql_strip('text'))} AS token_count FROM documents WHERE {sql_strip('text')} <> ''")
def chunk_one(spark, d):
    return C.rows(table(spark, d, "documents"), "doc_id", C.strategy("one")(F.col("text")))


@query("chunk_share", sql_rows(sql_fold("s", 96, "E'\\n'", "right(a.now, CAST(floor(length(a.now) * 15 / 100) AS INT))"), f"(SELECT doc_id, {SECTIONS} AS s FROM documents)"))
def chunk_share(spark, d):
    """Each chunk begins with the last 15 percent of the one before."""
    return C.rows(table(spark, d, "documents"), "doc_id", C.by_share(F.col("text"), 96, percent=15))


HEADED = rf"""l AS (SELECT doc_id, string_split(text, E'\n') AS t FROM documents), n AS (SELECT doc_id, unnest(t) AS line, generate_subscripts(t, 1) AS i FROM l),
 h AS (SELECT doc_id, i, line, {sql_strip('line')} AS heading, CASE WHEN {sql_strip('line')} = '' THEN NULL WHEN regexp_matches({sql_strip('line')}, '{LEVELS[0]}') THEN 0 WHEN regexp_matches({sql_strip('line')}, '{LEVELS[1]}') THEN 1 END AS depth FROM n),
 k AS (SELECT *, greatest(1, count(depth) OVER (PARTITION BY doc_id ORDER BY i)) AS s FROM h),
 s AS (SELECT doc_id, s, coalesce(max(heading) FILTER (WHERE depth IS NOT NULL), '') AS heading, coalesce(max(depth), 0) AS depth, coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (WHERE depth IS NULL), '') AS body FROM k GROUP BY doc_id, s),
 r AS (SELECT *, CASE WHEN heading <> '' THEN heading || E'\n' || {sql_strip('body')} ELSE {sql_strip('body')} END AS text FROM s)"""


@query(
    "chunk_title",
    f"""WITH {HEADED}, g AS (SELECT *, count(*) FILTER (WHERE depth < 1 OR s = 1) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM r),
 f AS (SELECT doc_id, g, min(s) AS first FROM g GROUP BY doc_id, g),
 j AS (SELECT g.doc_id, g.g, max(heading) FILTER (WHERE s = first) AS heading, array_to_string(list_filter(list(CASE WHEN s = first THEN body ELSE text END ORDER BY s), lambda x: x <> ''), E'\n') AS body FROM g JOIN f ON g.doc_id = f.doc_id AND g.g = f.g GROUP BY g.doc_id, g.g),
 c AS (SELECT doc_id, g, CASE WHEN heading <> '' THEN heading || E'\n' || {sql_strip('body')} ELSE {sql_strip('body')} END AS content FROM j)
 SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS position, content, {PLAIN_TOKENS('content')} AS token_count FROM c WHERE {sql_strip('content')} <> ''""",
)
def chunk_title(spark, d):
    """Sections of the first heading family; those of the second stay inside them."""
    return C.rows(table(spark, d, "documents"), "doc_id", C.by_title(F.col("text"), LEVELS, 1))


@query(
    "chunk_title_group",
    f"""WITH {HEADED}, p AS (SELECT doc_id, list({{'done': []::VARCHAR[], 'now': text, 'id': heading}} ORDER BY s) AS p FROM r WHERE {sql_strip('text')} <> '' GROUP BY doc_id),
 e AS (SELECT doc_id, list_reduce(p, lambda a, x: CASE WHEN ({PLAIN_TOKENS('a.now')} >= 32 AND x.id <> a.id) OR {PLAIN_TOKENS('a.now')} >= 1024
 THEN {{'done': list_append(a.done, a.now), 'now': x.now, 'id': x.id}} ELSE {{'done': a.done, 'now': a.now || E'\\n' || x.now, 'id': x.id}} END) AS e FROM p),
 c AS (SELECT doc_id, list_append(e.done, e.now) AS c FROM e), r2 AS (SELECT doc_id, unnest(c) AS content, generate_subscripts(c, 1) - 1 AS position FROM c)
 SELECT doc_id, position, content, {PLAIN_TOKENS('content')} AS token_count FROM r2""",
)
def chunk_title_group(spark, d):
    return C.rows(table(spark, d, "documents"), "doc_id", C.by_title_group(F.col("text"), LEVELS))


MARKDOWN = "'# ' || p_name || E'\\n\\n- ' || p_brand || E'\\n- ' || p_type || E'\\n\\n> quoted\\n\\n```\\na\\n\\nb\\n```\\n\\n| a | b |\\n|---|---|\\n| ' || p_size || ' | x |' || E'\\n\\nLast line.'"


def markdown(spark, d):
    """A small Markdown text a part."""
    text = F.concat(
        F.lit("# "), "p_name", F.lit("\n\n- "), "p_brand", F.lit("\n- "), "p_type", F.lit("\n\n> quoted\n\n```\na\n\nb\n```\n\n| a | b |\n|---|---|\n| "),
        F.col("p_size").cast("string"), F.lit(" | x |"), F.lit("\n\nLast line."),
    )
    return table(spark, d, "part").select("p_partkey", text.alias("text"))


@query(
    "markdown_blocks",
    """SELECT p_partkey, unnest(b) AS block, unnest(range(1, 7)) AS n FROM (SELECT p_partkey, ['# ' || p_name, '- ' || p_brand || E'\\n- ' || p_type, '> quoted', E'```\\na\\n\\nb\\n```',
 E'| a | b |\\n|---|---|\\n| ' || p_size || ' | x |', 'Last line.'] AS b FROM part)""",
)
def markdown_blocks(spark, d):
    rows = markdown(spark, d).select("p_partkey", F.posexplode(C.markdown_blocks(F.col("text"))).alias("n", "block"))
    return rows.select("p_partkey", (F.col("n") + 1).cast("long").alias("n"), "block")


@query(
    "merge_small",
    f"""WITH s AS (SELECT doc_id, {SECTIONS} AS s FROM documents), f AS (SELECT doc_id, list_reduce(list_prepend({{'done': []::VARCHAR[], 'now': ''}}, list_transform(s, lambda p: {{'done': []::VARCHAR[], 'now': p}})), lambda a, x:
 CASE WHEN {PLAIN_TOKENS("(CASE WHEN a.now = '' THEN x.now ELSE a.now || chr(10) || chr(10) || x.now END)")} >= 40
 THEN {{'done': list_append(a.done, CASE WHEN a.now = '' THEN x.now ELSE a.now || chr(10) || chr(10) || x.now END), 'now': ''}}
 ELSE {{'done': a.done, 'now': CASE WHEN a.now = '' THEN x.now ELSE a.now || chr(10) || chr(10) || x.now END}} END) AS f FROM s),
 c AS (SELECT doc_id, CASE WHEN f.now = '' THEN f.done WHEN len(f.done) = 0 THEN [f.now] ELSE list_append(f.done[1:len(f.done) - 1], f.done[len(f.done)] || chr(10) || chr(10) || f.now) END AS c FROM f)
 SELECT doc_id, unnest(c) AS content, generate_subscripts(c, 1) - 1 AS position FROM c""",
)
def merge_small(spark, d):
    parts = C.merged_small(C.sections(F.col("text")), 40)
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("position", "content"))
    return rows.withColumn("position", F.col("position").cast("long"))


@query(
    "qa_rows",
    """SELECT n_nationkey, n_name AS question, 'A ' || n_name || E'\\nmore' AS answer FROM nation UNION ALL SELECT n_nationkey, 'key', CAST(n_nationkey AS VARCHAR) FROM nation""",
)
def qa_rows(spark, d):
    """Two tab-separated lines a nation, the first answer over two lines."""
    text = F.concat(F.lit("no answer yet\n"), "n_name", F.lit("\tA "), "n_name", F.lit("\nmore\nkey\t"), F.col("n_nationkey").cast("string"))
    found = table(spark, d, "nation").select("n_nationkey", F.explode(C.question_rows(text)).alias("q"))
    return found.select("n_nationkey", "q.question", "q.answer")


@query(
    "position_tags",
    """SELECT l_orderkey, l_linenumber, unnest([1, 2]) AS page, CAST(trunc(l_quantity) AS INT) AS "left", CAST(trunc(l_quantity) AS INT) AS "right", 7 AS top, 9 AS bottom, 'cell' AS plain FROM lineitem""",
)
def position_tags(spark, d):
    q = F.col("l_quantity").cast("decimal(12,1)").cast("string")
    text = F.concat(F.lit("cell@@1-2\t"), q, F.lit("\t"), q, F.lit("\t7.5\t9##"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.explode(C.positions(text)).alias("p"), C.without_positions(text).alias("plain"))
    return rows.select("l_orderkey", "l_linenumber", "p.*", "plain")


@query(
    "batch_pack",
    f"""WITH RECURSIVE t AS (SELECT conv_id, turn, {PLAIN_TOKENS('text')} AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
 r AS (SELECT conv_id, turn, i, n, 0 AS batch FROM t WHERE i = 1 UNION ALL SELECT t.conv_id, t.turn, t.i, CASE WHEN r.n > 0 AND r.n + t.n > 60 THEN t.n ELSE r.n + t.n END,
 CASE WHEN r.n > 0 AND r.n + t.n > 60 THEN r.batch + 1 ELSE r.batch END FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1)
 SELECT conv_id, turn, batch FROM r""",
)
def batch_pack(spark, d):
    """Turns of a conversation in order, packed into batches of at most 60 tokens."""
    turns = F.sort_array(F.collect_list(F.struct("turn", T.token_count(F.col("text")).alias("n"))))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    both = F.arrays_zip(F.col("t.turn").alias("turn"), C.packed(F.col("t.n"), 60).alias("batch"))
    return rows.select("conv_id", F.explode(both).alias("b")).select("conv_id", "b.turn", "b.batch")


#: Lines of documents, of which four in nine are headings of one family, and the highest level comes first.
OUTLINE = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
 n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i, t FROM l WHERE t <> ''),
 o AS (SELECT doc_id, i, CASE i % 9 WHEN 0 THEN 'PART ONE ' WHEN 3 THEN 'Chapter IV ' WHEN 5 THEN 'Section 3 ' WHEN 7 THEN 'Article 9 ' ELSE 'plain ' END || t AS t,
 CASE i % 9 WHEN 0 THEN 0 WHEN 3 THEN 1 WHEN 5 THEN 2 WHEN 7 THEN 3 ELSE 5 END AS level FROM n)"""


def outlined(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "t")).where("t <> ''")
    i = (F.row_number().over(Window.partitionBy("doc_id").orderBy("p")) - 1).alias("pos")
    lead = F.element_at(F.array(*[F.lit(x) for x in ("PART ONE ", "plain ", "plain ", "Chapter IV ", "plain ", "Section 3 ", "plain ", "Article 9 ", "plain ")]), F.col("pos") % 9 + 1)
    rows = rows.select("doc_id", i, "t")
    return rows.select(F.col("doc_id").alias("key"), "pos", F.concat(lead, "t").alias("text"), F.lit("").alias("layout"))


@query(
    "outline_sections",
    f"""WITH {OUTLINE}, c AS (SELECT doc_id, level, count(*) AS n FROM o WHERE level < 5 GROUP BY ALL),
 m AS (SELECT doc_id, level AS most FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, level) = 1),
 s AS (SELECT *, sum(CASE WHEN level <= most AND level <> before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS section
 FROM (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM o JOIN m USING (doc_id)))
 SELECT doc_id, section::BIGINT AS section, string_agg(t, chr(10) ORDER BY i) AS content FROM s GROUP BY ALL""",
)
def outline_sections(spark, d):
    return Ol.section_groups(outlined(spark, d)).select(F.col("key").alias("doc_id"), F.col("section").cast("long").alias("section"), "content")


@query(
    "outline_tree",
    f"""WITH {OUTLINE}, q AS (SELECT doc_id, i, level, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM o),
 g AS (SELECT *, max(CASE WHEN level < 2 THEN i END) OVER (PARTITION BY doc_id ORDER BY i) AS nd FROM q),
 b AS (SELECT doc_id, nd, min(level) FILTER (WHERE i = nd) AS level, string_agg(t, chr(10) ORDER BY i) AS body FROM g GROUP BY doc_id, nd),
 k AS (SELECT *, lead(level) OVER w AS next, max(CASE WHEN level = 0 THEN nd END) OVER w AS part FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY nd))
 SELECT k.doc_id, k.nd AS pos, CASE WHEN k.level = 0 THEN k.body ELSE p.body || chr(10) || k.body END AS content
 FROM k LEFT JOIN b p ON p.doc_id = k.doc_id AND p.nd = k.part WHERE k.next IS NULL OR k.next <= k.level""",
)
def outline_tree(spark, d):
    """Leaves at the second of the levels that a text has; a text with one level of headings has leaves of it alone."""
    found = Ol.tree_chunks(outlined(spark, d), 2)
    return found.select(F.col("key").alias("doc_id"), F.col("pos").cast("long").alias("pos"), "content")


@query("outline_hierarchy")
def outline_hierarchy(spark, d):
    """Lines under their headings; a test compares the rule with a plain merge."""
    found = Ol.hierarchical_groups(outlined(spark, d))
    return found.select(F.col("key").alias("doc_id"), F.col("number").cast("long").alias("number"), "content")
