"""SQL twins of the queries that SQL can express, for DuckDB."""

from __future__ import annotations

#: Words are lower-cased A-Z only; classes of equal sets come first, so copies are no pairs.
NEAR_DUPLICATES = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
 ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s FROM w),
 c AS MATERIALIZED (SELECT min(doc_id) AS id, s, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
 e AS MATERIALIZED (SELECT id, n, unnest(s) AS g FROM c),
 p AS (SELECT x.id AS a, y.id AS b, x.n AS na, y.n AS nb, count(*) AS n FROM e x JOIN e y ON x.g = y.g AND x.id < y.id AND 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL),
 l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * n >= 85 * (na + nb - n)),
 bi AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
 r AS (SELECT id, id AS root FROM c UNION SELECT bi.b, r.root FROM r JOIN bi ON bi.a = r.id),
 k AS (SELECT id, min(root) AS root FROM r GROUP BY id)
 SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(k.root, doc_id) AS component_id, coalesce(k.root, doc_id) = doc_id AS kept
 FROM s LEFT JOIN c ON c.s = s.s LEFT JOIN k ON k.id = c.id"""


def repeats(items: str, size: int, window: str) -> str:
    """Tables ``s`` (``doc_id, s``: a text's parts), ``i`` (each part, and whether a repeated window covers it).

    ``window`` makes the ``size`` parts from place k of ``s`` one string.
    """
    return rf"""s AS MATERIALIZED (SELECT doc_id, {items} AS s FROM documents),
 g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(s) - {size} + 2, 1)), lambda k: {window})) AS g, unnest(range(1, greatest(len(s) - {size} + 2, 1))) AS pos FROM s),
 f AS MATERIALIZED (SELECT doc_id, pos, row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1 AS again FROM g),
 p AS (SELECT doc_id, unnest(s) AS part, unnest(range(1, len(s) + 1)) AS pos FROM s),
 i AS MATERIALIZED (SELECT doc_id, pos, part, coalesce(max(again::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM p LEFT JOIN f USING (doc_id, pos)),
 n AS MATERIALIZED (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM i)"""


SUBSTRINGS = rf"""WITH {repeats(r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')", 20, "array_to_string(s[k:k + 19], ' ')")},
 k AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, string_agg(part, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM n GROUP BY doc_id)
 SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM s LEFT JOIN k USING (doc_id)"""



def nearest_entries(book: str) -> str:
    """For each part of each vector, the nearest entry ``j`` of a codebook table and its distance ``d``."""
    return f"""SELECT vec_id, p, x, m.d AS d, m.j AS j FROM (SELECT vec_id, p, any_value(x) AS x, min({{'d': d, 'j': j}}) AS m FROM (
 SELECT vec_id, p, x, j, list_sum(list_transform(range(1, len(x) + 1), lambda k: (x[k] - c[k]) * (x[k] - c[k])))::BIGINT AS d FROM i JOIN {book} USING (p)) GROUP BY vec_id, p)"""


def moved_entries(book: str, assigned: str) -> str:
    return f"""SELECT p, j, coalesce(m, c) AS c FROM {book} LEFT JOIN (SELECT p, j, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY k) AS m FROM (
 SELECT p, j, k, sum(x[k]) AS s, count(*) AS n FROM {assigned}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS k) GROUP BY p, j, k) GROUP BY p, j) USING (p, j)"""


#: Unique ids and lengths of a multiple of 16, as the table has them.
VECTOR_CODES = f"""WITH v AS (SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings
 WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 i AS MATERIALIZED (SELECT vec_id, r, p, list_transform(e[p * len(e) // 16 + 1:(p + 1) * len(e) // 16], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM v, (SELECT unnest(range(16)) AS p)),
 b0 AS MATERIALIZED (SELECT p, r AS j, x AS c FROM i WHERE r < 64),
 a0 AS MATERIALIZED ({nearest_entries("b0")}), b1 AS MATERIALIZED ({moved_entries("b0", "a0")}),
 a1 AS MATERIALIZED ({nearest_entries("b1")}), b2 AS MATERIALIZED ({moved_entries("b1", "a1")}),
 a2 AS MATERIALIZED ({nearest_entries("b2")}),
 k AS (SELECT vec_id, string_agg(printf('%02x', j), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
 h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM b2)
 SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN v USING (vec_id), h"""

#: Counts of all sequences of one to five words; products are 128-bit.
PHRASES = r"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
 p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-]')) AS p FROM t),
 w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM p),
 n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
 g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m))),
 f AS MATERIALIZED (SELECT lang, m, phrase, count(*)::HUGEINT AS a, string_split(phrase, ' ') AS w FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
 c AS (SELECT lang, m, phrase, a, w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
 s AS (SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, n.n, k, 1000 * c.a * n.n // (x.a * y.a) AS score FROM c JOIN n USING (lang)
 JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')),
 b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 h AS (SELECT DISTINCT lang, a, array_to_string(w[i:i + z - 1], ' ') AS phrase FROM (SELECT lang, a, w, z, unnest(range(1, m - z + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS z FROM f WHERE m > 2))),
 o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM b ANTI JOIN h USING (lang, phrase, a))
 SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= 2000"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": SUBSTRINGS,
    "op10_near_duplicates": NEAR_DUPLICATES,
    "op11_phrases": PHRASES,
    "op12_vector_codes": VECTOR_CODES,
}
