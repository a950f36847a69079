"""Lexical and vector scores, their fusion, reranking and top-k, as lazy plans."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.functions import vectors as V
from granary.sources.staging import staged

K1, B = 1.2, 0.75
EMPTY_AVERAGE = 100.0


def query_tokens(spark, question: str) -> list[str]:
    """Tokens of a question, repeats kept, by the same expression as the documents'."""
    row = spark.range(1).select(T.tokens(F.lit(question)).alias("t")).first()
    return list(row["t"])


def token_stats(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, dl, tokens`` of each document."""
    return docs.select(key, T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens")).withColumn("dl", F.size("tokens"))


def staged_tokens(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Staged ``key`` and the tokens of each field: for several questions to the same documents."""
    return staged(field_tokens(docs, key, fields), "field-tokens")


def field_tokens(docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    return docs.select(key, *[T.tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"_t{i}") for i, f in enumerate(fields)])


def term_counts(rows: DataFrame, key: str, fields: int, terms: list[str]) -> DataFrame:
    """Staged ``key`` and, for each field of ``field_tokens``, its number of tokens and its counts of the terms.

    One pass over the texts: a term is only counted among the tokens that are a term.
    """
    found = [F.filter(f"_t{i}", lambda t: t.isin(*terms)).alias(f"_in{i}") for i in range(fields)]
    rows = rows.select(key, *[F.size(f"_t{i}").alias(f"_dl{i}") for i in range(fields)], F.array(F.struct(*found)).alias("_in"))
    rows = rows.select(key, *[f"_dl{i}" for i in range(fields)], F.explode("_in").alias("_in"))  # made once, not for each term
    columns = []
    for i in range(fields):
        columns.append(F.col(f"_dl{i}"))
        columns += [F.size(F.filter(F.col("_in")[f"_in{i}"], _is(w))).alias(f"_tf{i}_{j}") for j, w in enumerate(terms)]
    return staged(rows.select(key, *columns), "term-counts")


def weighted_bm25(docs: DataFrame, key: str, fields: dict[str, float], terms: list[str], tokens: DataFrame | None = None) -> DataFrame:
    """``key, score`` of documents that hold a term in some field: the weighted sum of the fields' scores.

    Term frequency is divided by document length before saturation, the length is the token count, the
    statistics are those of the candidates given, and a repeated term counts as often. Texts are read once; statistics
    and scores come from a few counts a document. ``tokens``: the documents' ``staged_tokens``, instead of their texts.
    """
    distinct = sorted(set(terms))
    if not distinct:
        return docs.select(key, F.lit(0.0).alias("score")).where("false")
    tokens = field_tokens(docs, key, list(fields)) if tokens is None else tokens
    rows = term_counts(tokens, key, len(fields), distinct)
    every = [(i, j) for i in range(len(fields)) for j in range(len(distinct))]
    stats = rows.agg(
        F.count("*").alias("_n"),
        *[F.avg(f"_dl{i}").alias(f"_avg{i}") for i in range(len(fields))],
        *[F.count_if(F.col(f"_tf{i}_{j}") > 0).alias(f"_df{i}_{j}") for i, j in every],
    )
    held = F.greatest(*[f"_tf{i}_{j}" for i, j in every], F.lit(0)) > 0
    both = rows.where(held).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i, weight in enumerate(fields.values()):
        for j, word in enumerate(distinct):
            df, tf = F.col(f"_df{i}_{j}"), F.col(f"_tf{i}_{j}") / F.greatest(f"_dl{i}", F.lit(1))
            idf = F.greatest(F.lit(0.0), F.log((F.col("_n") - df + 0.5) / (df + 0.5) + 1))
            average = F.when(F.col(f"_avg{i}") > 0, F.col(f"_avg{i}")).otherwise(EMPTY_AVERAGE)
            length = F.lit(1 - B) + F.lit(B) * F.col(f"_dl{i}") / average
            score = score + F.lit(weight * terms.count(word)) * idf * tf * (K1 + 1) / (tf + F.lit(K1) * length)
    return both.select(key, score.alias("score"))


def bm25(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    return weighted_bm25(docs, key, {text: 1.0}, terms)


def _is(word: str):
    return lambda t: t == F.lit(word)


def field_bm25(docs: DataFrame, key: str, fields: dict[str, float], terms: list[str], tokens: DataFrame | None = None) -> DataFrame:
    """Weighted sum of the fields' scores, divided by its maximum over the candidates."""
    total = staged(weighted_bm25(docs, key, fields, terms, tokens), "field-scores")
    most = total.agg(F.max("score").alias("_most"))
    share = F.when(F.col("_most") > 0, F.col("score") / F.col("_most")).otherwise(F.col("score"))
    return total.crossJoin(F.broadcast(most)).select(key, share.alias("score"))


def vector_scores(vectors: DataFrame, key: str, column: str, wanted: list[float]) -> DataFrame:
    """Cosine with the query vector; vectors of another length or zero are skipped."""
    q = V.literal(wanted)
    rows = vectors.where((F.size(column) == len(wanted)) & (V.norm(F.col(column)) > 0))
    return rows.select(key, V.cosine(F.col(column), q).alias("score"))


def top(df: DataFrame, k: int, score: str = "score", key: str = "doc_id") -> DataFrame:
    """The k best by score, ties by key, ranked from 0; only k rows a task reach the ranking."""
    if k < 1:
        raise ValueError("k must be positive: all rows would be ranked in one task")
    best = df.orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc(score), key)) - 1).cast("long"))


def fuse(lexical: DataFrame, dense: DataFrame, key: str, weight: float, normalise: bool = False) -> DataFrame:
    """``(1 - weight) * lexical + weight * dense``, positive scores only; a missing side is 0."""
    a = lexical.withColumnRenamed("score", "term_score")
    b = dense.withColumnRenamed("score", "vector_score")
    both = a.join(b, key, "full_outer").fillna(0.0, ["term_score", "vector_score"])
    score = F.col("term_score") * (1 - weight) + F.col("vector_score") * weight
    score = V.atan_normalised(score) if normalise else score
    return both.withColumn("score", score).where("score > 0")


def hybrid_search(
    docs: DataFrame, vectors: DataFrame, question: str, wanted: list[float], weight: float = 0.3, k: int = 10,
    threshold: float = 0.0,
) -> DataFrame:
    """Ranked documents (``doc_id``) for a question and its vector; the threshold counts only if vectors do."""
    terms = query_tokens(docs.sparkSession, question)
    lexical = field_bm25(docs, "doc_id", {"text": 1.0}, terms)
    dense = vector_scores(vectors, "doc_id", "embedding", wanted)
    found = fuse(lexical, dense, "doc_id", weight)
    return top(found.where(F.col("score") >= threshold) if weight > 0 else found, k)


def rank_feature(pagerank: Column, tags: Column, query: dict[str, float]) -> Column:
    """Page rank plus ten times the cosine of tag weights; without either norm the page rank alone."""
    q = F.create_map(*[x for t, w in query.items() for x in (F.lit(t), F.lit(float(w)))])
    size = sum(w * w for w in query.values()) ** 0.5
    weights = F.map_values(tags)
    own = V.norm(weights)
    inner = V.total(F.transform(F.map_entries(tags), lambda e: e["value"] * F.coalesce(F.try_element_at(q, e["key"]), F.lit(0.0))))
    boost = F.when((own > 0) & F.lit(size > 0), 10 * inner / F.nullif(own, F.lit(0.0)) / F.lit(size or 1.0)).otherwise(0.0)
    return F.coalesce(pagerank, F.lit(0.0)) + F.coalesce(boost, F.lit(0.0))


def query_weights(spark, terms: list[str]) -> dict[str, float]:
    """Keys of a question and their weights: 0.4 of a term's, and 0.6 of the larger for each adjacent pair, run together."""
    if not terms:
        return {}
    row = spark.range(1).select(T.term_weights(F.array(*[F.lit(t) for t in terms])).alias("w")).first()
    found, weights = {}, [x["weight"] for x in row["w"]]
    for i, (term, weight) in enumerate(zip(terms, weights, strict=True)):
        found[term] = found.get(term, 0.0) + 0.4 * weight
        if i + 1 < len(terms):
            pair = term + terms[i + 1]
            found[pair] = found.get(pair, 0.0) + 0.6 * max(weight, weights[i + 1])
    return found


def token_keys(tokens: Column) -> Column:
    """Distinct tokens and adjacent pairs of them, run together."""

    def of(t: Column) -> Column:
        n = F.greatest(F.size(t) - 1, F.lit(0))
        return F.array_union(t, F.zip_with(F.slice(t, F.lit(1), n), F.slice(t, F.lit(2), n), lambda a, b: F.concat(a, b)))

    return T.bound(tokens, of)


def token_similarity(tokens: Column, query: dict[str, float]) -> Column:
    """Weight of the query's keys that the document holds, over the weight of all."""

    def of(keys: Column) -> Column:
        return sum((F.when(F.array_contains(keys, k), F.lit(float(w))).otherwise(0.0) for k, w in query.items()), F.lit(1e-9))

    return T.bound(token_keys(tokens), of) / F.lit(1e-9 + sum(query.values()))


def weighted_bag(content: Column, title: Column, keywords: Column, questions: Column) -> Column:
    """Tokens of a chunk's fields, as often as they count: once, twice, five and six times."""
    parts = ((content, 1), (title, 2), (keywords, 5), (questions, 6))
    return F.flatten(F.array(*[T.tokens(F.coalesce(x, F.lit(""))) for x, n in parts for _ in range(n)]))


def store_score(
    fields: list[Column], matching: str, vector: Column | None = None, wanted: list[float] | None = None, distance: str = "cosine",
    boosts: list[tuple[Column, dict[str, float]]] = (),
) -> Column:
    """Occurrences of the words in all fields, plus the cosine (``l2``: ``1 / (1 + cosine)``, negative ones as 0), plus boosts by id."""
    words = [w for w in re.split(r"[^\w]|_", matching.lower()) if w]
    score = F.lit(0.0)
    for field in fields:
        for word in words:
            score = score + T.count_of(F.lower(F.coalesce(field, F.lit(""))), word)
    if vector is not None and wanted:
        near = V.cosine(vector, V.literal(wanted))
        near = 1 / (1 + F.greatest(near, F.lit(0.0))) if distance == "l2" else near
        score = score + F.when(F.size(vector) == len(wanted), near).otherwise(0.0)
    for key, table in boosts:
        for value, boost in table.items():
            score = score + F.when(key.cast("string") == value, F.lit(float(boost))).otherwise(0.0)
    return score


def fuse_named(knn: DataFrame, text: DataFrame, key: str, weight: float, k: int) -> DataFrame:
    """``weight * cosine + (1 - weight) * coverage``; texts without a hit add nothing; the ``k`` best positive scores."""
    hits = text.where("score > 0").select(key, (F.col("score") * (1 - weight)).alias("t"))
    near = knn.select(key, (F.col("score") * weight).alias("v"))
    both = near.join(hits, key, "full_outer").fillna(0.0, ["t", "v"])
    found = both.select(key, F.round(F.col("v") + F.col("t"), 6).alias("score")).where("score > 0")
    return top(found, k, key=key)


def narrowed(text: Column, keywords: list[str]) -> Column:
    """Tables whole; sentences with a keyword (by stem) and two around each, fact-dense ones and one around; else null."""
    plain = [k.strip().lower() for k in keywords if k.strip()]
    verbatim = [k for k in plain if not all(len(w) >= 4 and w.isalpha() and w.isascii() for w in re.findall("[a-z0-9]+", k)) or not re.findall("[a-z0-9]+", k)]
    stemmed = [k for k in plain if k not in verbatim]
    if not plain:
        return F.lit(None).cast("string")

    def hit(s: Column) -> Column:
        low = F.lower(s)
        found = F.lit(False)
        for k in verbatim:
            found = found | F.contains(low, F.lit(k))
        if stemmed:
            own = F.transform(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.when(w.rlike("^[a-z]{4,}$"), T.stem(w)).otherwise(w))
            line = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))
            for k in stemmed:
                wanted = F.concat(F.lit(" "), F.array_join(F.array(*[T.stem(F.lit(w)) for w in re.findall("[a-z0-9]+", k)]), " "), F.lit(" "))
                found = found | F.contains(line, wanted)
        return found

    def of(s: Column) -> Column:
        def keep(hits: Column) -> Column:
            def near(i: Column, n: int, kind: int) -> Column:
                low = F.greatest(i - n, F.lit(0))
                return F.exists(F.slice(hits, low + 1, i + n + 1 - low), lambda x: x == kind)

            chosen = F.filter(s, lambda x, i: near(i, 2, 2) | near(i, 1, 1))
            return F.when(F.exists(hits, lambda x: x == 2), F.trim(F.array_join(chosen, "")))

        return T.bound(F.transform(s, lambda x: F.when(hit(x), 2).when(T.is_fact_dense(x), 1).otherwise(0)), keep)

    prose = T.bound(T.plain_sentences(text), of)
    return F.when(T.is_table(text), text).otherwise(prose)


def grep_search(docs: DataFrame, key: str, text: str, question: str, k: int) -> DataFrame:
    """The ``k`` best by BM25, with tables whole and prose narrowed to the question's words; all as they are if none narrows."""
    words = docs.sparkSession.range(1).select(T.grep_terms(F.lit(question), 12).alias("t")).first()["t"]
    pool = top(bm25(docs, key, text, query_tokens(docs.sparkSession, question)), k, key=key)
    found = staged(docs.join(F.broadcast(pool), key).select(key, "score", "rank", F.col(text).alias("content"), narrowed(F.col(text), list(words)).alias("narrow")), "grep")
    some = found.where("narrow IS NOT NULL")
    if some.isEmpty():
        return found.select(key, "score", "rank", "content")
    return some.select(key, "score", "rank", F.col("narrow").alias("content"))


def multi_hop(docs: DataFrame, key: str, text: str, retrieve: Callable[[str], DataFrame], question: str, k: int = 10, hops: int = 3) -> DataFrame:
    """Up to three rounds of ``retrieve`` (``key, score``): parts of the question, its key terms, and phrases of what was found.

    Each round keeps at most ``k`` rows a query above 0.3, 0.25 and 0.2; an id keeps its first score. Of results
    with nearly the same words (Jaccard 0.9) the best stays. Only these few rows reach the driver.
    """
    spark = docs.sparkSession

    def best(query: str, least: float) -> list:
        rows = top(retrieve(query), k, key=key).where(F.col("score") > least)
        return docs.join(F.broadcast(rows), key).select(key, "score", "rank", F.col(text).alias("text")).orderBy("rank").collect()

    found: dict = {}

    def add(rows: list) -> None:
        for r in rows:
            found.setdefault(r[key], (r["score"], r["text"]))

    parts = spark.range(1).select(T.sub_queries(F.lit(question)).alias("q")).first()["q"]
    first = [best(q, 0.3) for q in parts]
    for rows in first:
        add(rows)
    words = Counter(
        w for rows in first for r in rows[:3] for w in re.findall(r"[^\W_]+", (r["text"] or "").lower()) if len(w) > 3 and w not in T.STOP_WORDS
    )
    terms = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:5]]
    if hops > 1 and terms:
        add(best(f"{question} {' '.join(terms)}", 0.25))
    if hops > 2 and len(found) >= 3:
        phrases = Counter()
        for _, content in list(found.values())[:5]:
            w = (content or "").split()
            phrases.update(p for p in (" ".join(w[i : i + 3]) for i in range(len(w) - 2)) if 10 < len(p) < 80)
        chosen = [p for p, _ in sorted(phrases.items(), key=lambda x: (-x[1], x[0]))[:3]]
        if chosen:
            add(best(". ".join(chosen), 0.2))
    kept: list[tuple] = []
    for i, (score, content) in sorted(found.items(), key=lambda x: (-x[1][0], x[0])):
        own = set((content or "").lower().split())
        if all(len(own & other) < 0.9 * max(len(own | other), 1) for _, _, other in kept):
            kept.append((i, score, own))
    rows = [(i, float(score), n) for n, (i, score, _) in enumerate(kept)]
    return spark.createDataFrame(rows, f"{key} {docs.schema[key].dataType.simpleString()}, score double, rank long")


def key_terms(docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """The k best terms of each document: ``tf * (1 + 1/(1 + offset)) * length * kind``, ties by term."""
    words = docs.select(key, F.posexplode(T.tokens(F.col(text))).alias("pos", "term")).where(~F.col("term").rlike("^[0-9]+$"))
    length = F.element_at(F.array(*[F.lit(x) for x in (0.7, 1.0, 1.1, 1.2)]), F.least(F.length("term"), F.lit(4)))
    kind = F.when(F.col("term").rlike(f"[{T.CJK}]"), 1.2).when(F.col("term").rlike("^[A-Za-z]+$"), 0.9).otherwise(1.0)
    stats = words.groupBy(key, "term").agg(F.count("*").alias("tf"), F.min("pos").alias("offset"))
    stats = stats.withColumn("score", F.round(F.col("tf") * (1 + 1 / (1 + F.col("offset"))) * length * kind, 9))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "term")
    return stats.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "term", "score", "rank")
