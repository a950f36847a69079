"""Segments of a question: kept tokens, merged short terms, phrases of Latin words, and a boosted query string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import text as T

#: A run of up to four short terms is one phrase, longer ones are cut into pairs; a query's most keywords.
LONGEST_RUN, MOST_SEGMENTS, MOST_KEYWORDS, MOST_SYNONYMS = 4, 256, 32, 8


def pretokens(tokens: Column, numbers: bool = True, stops: bool = True) -> Column:
    """Tokens without stop words, without bare numbers unless ``numbers``, and without single signs."""
    kept = F.filter(tokens, lambda t: (t != F.lit("")) & ~t.rlike(r"^[^\p{L}\p{N}]$"))
    if stops:
        kept = F.filter(kept, lambda t: ~t.isin(*T.STOP_WORDS))
    return kept if numbers else F.filter(kept, lambda t: ~t.rlike("^[0-9]+$"))


def is_short(term: Column) -> Column:
    return (F.length(term) == 1) | term.rlike("^[0-9a-z]{1,2}$")


def run_phrases(run: Column) -> Column:
    """Pairs from the left while more than ``LONGEST_RUN`` terms are left, then the rest as one."""
    n = F.size(run)
    pairs = F.greatest(F.lit(0), F.ceil((n - LONGEST_RUN) / 2)).cast("int")
    some = F.transform(F.filter(F.sequence(F.lit(0), pairs), lambda i: i < pairs), lambda i: F.array_join(F.slice(run, i * 2 + 1, F.lit(2)), " "))
    rest = F.array_join(F.slice(run, pairs * 2 + 1, F.greatest(n - pairs * 2, F.lit(0))), " ")
    return F.when(n > 0, F.concat(some, F.array(rest))).otherwise(F.array().cast("array<string>"))


def merged_terms(tokens: Column) -> Column:
    """Runs of short terms (one character, or up to two letters and digits) as phrases; stop words end a run.

    A short first term joins a longer second one that does not begin with a Latin letter or digit.
    """

    def of(all_: Column) -> Column:
        first, second = F.get(all_, F.lit(0)), F.get(all_, F.lit(1))
        leads = F.coalesce(is_short(first) & (F.length(second) > 1) & ~second.rlike("^[0-9A-Za-z]"), F.lit(False))
        head = F.when(leads, F.array(F.concat_ws(" ", first, second))).otherwise(F.array().cast("array<string>"))
        rest = F.when(leads, F.slice(all_, F.lit(3), F.greatest(F.size(all_) - 2, F.lit(0)))).otherwise(all_)
        none = F.array().cast("array<string>")
        zero = F.struct(head.alias("done"), none.alias("run"))

        def step(state: Column, t: Column) -> Column:
            inside = is_short(t) & (t != F.lit("")) & ~t.isin(*T.STOP_WORDS)
            own = F.when(t == F.lit(""), none).otherwise(F.array(t))
            ended = F.struct(F.concat(state["done"], run_phrases(state["run"]), own).alias("done"), none.alias("run"))
            grown = F.struct(state["done"].alias("done"), F.concat(state["run"], F.array(t)).alias("run"))
            return F.when(inside, grown).otherwise(ended)

        return F.aggregate(rest, zero, step, lambda s: F.concat(s["done"], run_phrases(s["run"])))

    return T.bound(tokens, of)


def latin_phrases(text: Column, functional: tuple[str, ...] = ()) -> Column:
    """Words between blanks; neighbours that both end with a Latin letter are one phrase, unless one is ``functional``."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != F.lit(""))

    def step(state: Column, w: Column) -> Column:
        last = F.element_at(state, -1)
        joins = last.rlike("[A-Za-z]$") & w.rlike("[A-Za-z]$")
        if functional:
            joins = joins & ~last.isin(*functional) & ~w.isin(*functional)
        joined = F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(F.concat(last, F.lit(" "), w)))
        return F.when((F.size(state) > 0) & joins, joined).otherwise(F.concat(state, F.array(w)))

    return F.aggregate(words, F.array().cast("array<string>"), step)


def parts_of(segment: Column) -> Column:
    """Words of a segment that is no plain Latin word of three characters and more."""
    apart = (F.length(segment) >= 3) & ~segment.rlike(r"^[0-9a-z.+#_*\-]+$")
    found = F.filter(F.transform(T.rag_tokens(segment), T.escaped_query), lambda t: F.length(t) > 1)
    return F.when(apart, found).otherwise(F.array().cast("array<string>"))


def query_string(text: Column, synonyms: dict[str, list[str]]) -> Column:
    """``(term OR (synonyms)^0.2 OR "words" OR ("words"~2)^0.5)^1`` of each segment, joined by ``OR``.

    ``text`` is cleaned and lower-cased; a phrase stands in quotes. The weight of a segment is its share among its own
    terms, so 1. Without a segment the text itself is the query.
    """
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.lit(" ".join(v[:MOST_SYNONYMS])))]) if synonyms else None

    def one(segment: Column) -> Column:
        clean = T.escaped_query(segment)
        term = F.when(F.contains(clean, F.lit(" ")), F.concat(F.lit('"'), clean, F.lit('"'))).otherwise(clean)
        if table is not None:
            found = T.escaped_query(F.try_element_at(table, segment))
            term = F.when(found.isNull(), term).otherwise(F.concat(F.lit("("), term, F.lit(" OR ("), found, F.lit(" )^0.2)")))

        def with_parts(words: Column) -> Column:
            whole = F.array_join(words, " ")
            more = F.concat(term, F.lit(' OR "'), whole, F.lit('" OR ("'), whole, F.lit('"~2)^0.5'))
            return F.concat(F.lit("(("), F.when(F.size(words) > 0, more).otherwise(term), F.lit(")^1)"))

        return T.bound(parts_of(segment), with_parts)

    segments = F.slice(latin_phrases(text), 1, MOST_SEGMENTS)
    return T.bound(segments, lambda s: F.when(F.size(s) > 0, F.array_join(F.transform(s, one), " OR ")).otherwise(text))
