"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import segments as Sg
from granary.functions import text as T

from .base import query, sql_token_count, sql_tokens, table

SUFFIX = {e: r for e, r in T.STEM_ENDINGS}


def sql_stem(w: str) -> str:
    cases = " ".join(f"WHEN ends_with({w}, '{e}') AND length({w}) - {len(e)} >= 3 THEN left({w}, length({w}) - {len(e)}) || '{r}'" for e, r in T.STEM_ENDINGS)
    out = f"(CASE {cases} ELSE {w} END)"
    out = f"regexp_replace(regexp_replace({out}, '^(.{{3,}})y$', '\\1i'), '^(.{{3,}})e$', '\\1')"
    return f"(SELECT CASE WHEN length(z) > 3 AND right(z, 1) = left(right(z, 2), 1) AND right(z, 1) NOT IN ('a', 'e', 'i', 'o', 'u') THEN left(z, length(z) - 1) ELSE z END FROM (SELECT {out} AS z))"


@query(
    "stems",
    f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS word FROM documents) SELECT word, {sql_stem('word')} AS stem FROM w",
)
def stems(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))
    rows = table(spark, d, "documents").select(F.explode(words).alias("word")).distinct()
    return rows.select("word", T.stem(F.col("word")).alias("stem"))


@query(
    "text_tests",
    r"""SELECT p_partkey, regexp_matches(replace(replace(replace(CAST(p_retailprice AS VARCHAR), ',', ''), '.', ''), '%', ''), '^[0-9]+$') AS number, false AS name_number,
 regexp_matches(p_brand, '^[A-Za-z]+$') AS letters, len(list_filter(string_split_regex(p_name, '\s+'), lambda w: regexp_matches(w, '^[A-Za-z0-9.,:;''/"?<>!()-]+$'))) > 0.8 * len(list_filter(string_split_regex(p_name, '\s+'), lambda w: w <> '')) AS english,
 false AS han, true AS id_like FROM part""",
)
def text_tests(spark, d):
    price = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    return table(spark, d, "part").select(
        "p_partkey", T.is_number(F.concat(price, F.lit("%"))).alias("number"), T.is_number(F.concat(F.lit("x"), price)).alias("name_number"),
        T.is_alphabetic(F.col("p_brand")).alias("letters"), T.is_english_query(F.col("p_name")).alias("english"),
        T.is_mostly_cjk(F.col("p_name")).alias("han"), T.is_identifier(F.lpad(F.col("p_partkey").cast("string"), 16, "0")).alias("id_like"),
    )


@query(
    "string_similarities",
    r"""WITH p AS (SELECT p_partkey, lower(p_name) AS a, lower(p_type) AS b FROM part),
 g AS (SELECT *, list_distinct(list_transform(range(1, length(a)), lambda i: a[i:i+1])) AS x, list_distinct(list_transform(range(1, length(b)), lambda i: b[i:i+1])) AS y,
 list_distinct(string_split_regex(a, '\s+')) AS v, list_distinct(string_split_regex(b, '\s+')) AS w, list_distinct(string_split(a, '')) AS c, list_distinct(string_split(b, '')) AS e FROM p)
 SELECT p_partkey, round(len(list_intersect(x, y)) / greatest(len(x), len(y), 1), 6) AS bigram_share, round(len(list_intersect(v, w)) / len(list_distinct(list_concat(v, w))), 6) AS words,
 round(len(list_intersect(c, e)) / len(list_distinct(list_concat(c, e))), 6) AS chars FROM g""",
)
def string_similarities(spark, d):
    a, b = F.lower("p_name"), F.lower("p_type")
    return table(spark, d, "part").select(
        "p_partkey", F.round(T.bigram_overlap(a, b), 6).alias("bigram_share"), F.round(T.word_jaccard(a, b), 6).alias("words"),
        F.round(T.char_overlap(a, b), 6).alias("chars"),
    )


@query(
    "truncate_tokens",
    r"""WITH v AS (SELECT doc_id, text, regexp_replace(text, '[\s!-/:-@\[-`{-~]', '', 'g') AS shown FROM documents)
 SELECT doc_id, length(shown) <= 400 AS whole, least(100, CAST(ceil(length(shown) / 4) AS BIGINT)) AS tokens FROM v WHERE length(shown) > 0""",
)
def truncate_tokens(spark, d):
    """Texts cut to 100 tokens: how many they have then, and whether nothing was cut."""
    cut = table(spark, d, "documents").select("doc_id", "text", T.truncated(F.col("text"), 100).alias("cut"))
    return cut.where(T.token_count(F.col("text")) > 0).select("doc_id", (F.col("cut") == F.col("text")).alias("whole"), T.token_count(F.col("cut")).alias("tokens"))


@query(
    "plain_sentences",
    r"""SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '([.!?;]+)', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '\s', '', 'g') <> '')) AS n FROM documents
 WHERE NOT regexp_matches(text, '[0-9][.]|[.][0-9]')""",
)
def plain_sentences(spark, d):
    rows = table(spark, d, "documents").where(~F.col("text").rlike("[0-9][.]|[.][0-9]"))
    return rows.select("doc_id", F.size(T.plain_sentences(F.col("text"))).cast("long").alias("n"))


@query(
    "cuts",
    """SELECT doc_id, CASE WHEN length(trim(text)) <= 40 THEN trim(text) ELSE regexp_replace(left(trim(text), 40), '\\s+$', '') || '...' END AS snippet,
 (CASE WHEN greatest(pos - 20, 1) > 1 THEN '...' ELSE '' END) || substr(text, greatest(pos - 20, 1), 60) || (CASE WHEN greatest(pos - 20, 1) + 59 < length(text) THEN '...' ELSE '' END) AS excerpt,
 replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml FROM (SELECT doc_id, text, instr(lower(text), 'oring') AS pos FROM documents)""",
)
def cuts(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.snippet(t, 40).alias("snippet"), T.excerpt(t, "oring", 20, 60).alias("excerpt"), T.xml_escape(t).alias("xml"))


@query(
    "citations",
    """SELECT o_orderkey, CASE WHEN o_custkey < 100 THEN 'a [ID:' || o_custkey || '] b' ELSE 'a (ID: ' || o_custkey || ') b' END || ' [ID:7] [ID:7]' AS repaired,
 CASE WHEN o_custkey < 100 AND o_custkey <> 7 THEN 2 ELSE 1 END AS n FROM orders""",
)
def citations(spark, d):
    text = F.concat(F.lit("a (ID: "), F.col("o_custkey").cast("string"), F.lit(") b ref ٧ 【ID 7】"))
    fixed = T.repaired_citations(text, 100)
    return table(spark, d, "orders").select("o_orderkey", fixed.alias("repaired"), F.size(T.cited(fixed)).cast("long").alias("n"))


@query(
    "clean_text",
    r"""SELECT n_nationkey, '# ' || n_name AS fence, 'id  ends' AS hex, 'say ' || n_name || ' now' AS speech, regexp_replace(n_name, '[^A-Za-z]+$', '') || ' 中文 ' || n_name AS spaced, 'a (b) c!' AS tight, '汉语 x' AS simple, 'ABC 123' AS narrow FROM nation""",
)
def clean_text(spark, d):
    n = F.col("n_name")
    return table(spark, d, "nation").select(
        "n_nationkey", T.without_fence(F.concat(F.lit("```markdown\n# "), n, F.lit("\n```"))).alias("fence"),
        T.without_hex(F.lit("id 0123456789abcdef ends")).alias("hex"), T.speakable(F.concat(F.lit("say\x07 "), n, F.lit("  now🙂"))).alias("speech"),
        T.spaced_scripts(F.concat(F.regexp_replace(n, "[^A-Za-z]+$", ""), F.lit("中文"), n)).alias("spaced"),
        T.tight_blanks(F.lit("a ( b ) c !")).alias("tight"), T.folded(F.lit("漢語 x"), {"漢": "汉", "語": "语"}).alias("simple"),
        T.half_width(F.lit("ＡＢＣ　１２３")).alias("narrow"),
    )


@query(
    "query_rewrite",
    """SELECT n_nationkey, 'what is ' || lower(n_name) AS cleaned, 'is ' || lower(n_name) AS bare, 'is ' || lower(n_name) AS expanded, 2 AS parts, ['v1.2', lower(n_name)] AS terms, 'a \\(b\\) c\\:d' AS escaped FROM nation""",
)
def query_rewrite(spark, d):
    n = F.lower(F.regexp_replace("n_name", " ", "_"))
    q = F.concat(F.lit("Please tell me what is "), F.lower("n_name"))
    rows = table(spark, d, "nation").where("n_name NOT LIKE '% %'")
    cleaned = T.clean_query(q)
    return rows.select(
        "n_nationkey", cleaned.alias("cleaned"), T.without_question_word(cleaned).alias("bare"),
        T.expanded(T.without_question_word(cleaned), {"nothing": ["none"]}, 3).alias("expanded"),
        F.size(T.sub_queries(F.concat(F.lit("the trade of "), n, F.lit(" and the ports of the sea")))).cast("long").alias("parts"),
        T.grep_terms(F.concat(F.lit("v1.2 "), n, F.lit(" v1.2 a -")), 5).alias("terms"), T.escaped_query(F.lit("a (b) 'c:d'")).alias("escaped"),
    )


@query("sentence_marks", "SELECT doc_id, regexp_replace(text, '(oring|theand)', '*\\1*', 'g') AS starred FROM documents")
def sentence_marks(spark, d):
    return table(spark, d, "documents").select("doc_id", T.starred(F.col("text"), ["theand", "oring"]).alias("starred"))


WEIGHT = r"""(0.3 * log10(10 + (1e7 - fr + 0.5) / (fr + 0.5)) + 0.7 * log10(10 + (1e9 - df + 0.5) / (df + 0.5))) * ner * pos"""
TERM = r"""SELECT conv_id * 1000 + turn AS id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM t"""
KINDS = r"""SELECT *, CASE WHEN regexp_matches(term, '^[0-9. -]{2,}$') THEN 3.0 WHEN regexp_matches(term, '^[a-z. -]+$') THEN 300.0 ELSE 10.0 END::DOUBLE AS fr,
 CASE WHEN regexp_matches(term, '^[0-9. -]{2,}$') THEN 5.0 WHEN regexp_matches(term, '^[a-z. -]+$') THEN 300.0 ELSE 3.0 END::DOUBLE AS df,
 CASE WHEN regexp_matches(term, '^[0-9,.]{2,}$') THEN 2.0 WHEN regexp_matches(term, '^[a-z]{1,2}$') THEN 0.01 ELSE 1.0 END::DOUBLE AS ner,
 CASE WHEN regexp_matches(term, '^[0-9-]') THEN 2.0 ELSE 1.0 END::DOUBLE AS pos FROM e"""


@query(
    "term_weights",
    f"""WITH t AS (SELECT conv_id, turn, {sql_tokens('text')} AS t FROM conversations), e AS ({TERM}), k AS ({KINDS}), w AS (SELECT id, term, i, {WEIGHT} AS w FROM k)
 SELECT id, term, i, round(w / sum(w) OVER (PARTITION BY id), 9) AS weight FROM w""",
)
def term_weights(spark, d):
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.tokens(F.col("text")).alias("t"))
    found = rows.select("id", F.posexplode(T.term_weights(F.col("t"))).alias("i", "w"))
    return found.select("id", "w.term", (F.col("i") + 1).cast("long").alias("i"), F.round("w.weight", 9).alias("weight"))


@query("token_counts_of_lines", f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, sum({sql_token_count('line')}) AS tokens FROM l GROUP BY doc_id")
def token_counts_of_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.sum(T.token_count(F.col("line"))).alias("tokens"))


@query(
    "query_segments",
    rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(left(text, 60)), '\s+'), lambda x: x <> '') AS w FROM documents WHERE regexp_full_match(lower(left(text, 60)), '[a-z\s]+')),
 k AS (SELECT doc_id, len({sql_tokens("left(text, 200)")}) AS n, len(list_filter({sql_tokens("left(text, 200)")}, lambda x: NOT regexp_full_match(x, '[0-9]+'))) AS words FROM documents)
 SELECT doc_id, n, words, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') END AS phrase FROM k LEFT JOIN w USING (doc_id)""",
)
def query_segments(spark, d):
    """A text's beginning as a question: its kept tokens, those without numbers, and its phrase where it is all Latin."""
    head = T.rag_tokens(F.left("text", F.lit(200)))
    start = F.lower(F.left("text", F.lit(60)))
    phrases = F.when(start.rlike(r"^[a-z\s]+$"), Sg.latin_phrases(start))
    n, words = F.size(Sg.pretokens(head)).cast("long"), F.size(Sg.pretokens(head, numbers=False)).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("n"), words.alias("words"), F.get(phrases, F.lit(0)).alias("phrase"))
