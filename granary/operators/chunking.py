"""Chunking as expressions: one text becomes an array of chunks, without a Python worker.

A fold over a text's sections keeps the finished chunks and the open one, so a text of any length is one pass in its
own task, and texts are independent of each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T

#: Where texts are cut unless told otherwise, and where sentences end.
DEFAULT_DELIMITER = "\n!?;。；！？"
SENTENCE_END = r"[。!?？；！\n]|\. "
POSITION_TAG = r"@@([0-9-]+)\t([0-9.]+)\t([0-9.]+)\t([0-9.]+)\t([0-9.]+)##"
GROUP_LEAST, GROUP_MOST = 32, 1024


def delimiters_of(field: str) -> list[str]:
    """Single characters and back-ticked words of a delimiter field, each once, longest first."""
    found: dict[str, None] = {}
    for word, char in re.findall(r"`([^`]+)`|(.)", field.replace("\r\n", "\n").replace("\r", "\n"), re.S):
        found.setdefault(word or char)
    return sorted(found, key=len, reverse=True)


def pattern_of(delimiters: list[str]) -> str:
    return "|".join(T.quoted(d) for d in delimiters if d)


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(" \t\n\u000b\f\r"))


def not_blank(parts: Column) -> Column:
    return F.filter(parts, lambda x: stripped(x) != F.lit(""))


def sections(text: Column, delimiter: str = DEFAULT_DELIMITER) -> Column:
    """Parts between delimiters, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, pattern_of(delimiters_of(delimiter))), stripped), lambda x: x != F.lit(""))


def kept_sections(text: Column, pattern: str) -> Column:
    """Parts that end with their delimiter."""
    return F.split(text, f"(?<={pattern})")


def nothing() -> Column:
    """The counts of an empty text."""
    return F.struct(F.lit(0).alias("c"), F.lit(0).alias("l"), F.lit(False).alias("b"))


def added(*items: Column) -> Column:
    return F.struct(sum(x["c"] for x in items).alias("c"), sum(x["l"] for x in items).alias("l"), reduce(or_, [x["b"] for x in items]).alias("b"))


def with_counts(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.struct(p.alias("text"), T.visible_counts(p).alias("n")))


def _fold(parts: Column, budget: int, joiner: str, tail: Callable[[Column, Column], Column] | None) -> Column:
    """Chunks of parts joined up to ``budget`` tokens; ``tail(chunk, tokens)`` opens the next chunk."""
    if tail is None:
        return T.bound(parts, lambda p: _packed_parts(p, budget, joiner))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), nothing().alias("n"))

    def step(state: Column, x: Column) -> Column:
        def opened(start: Column) -> Column:
            return F.struct(F.concat(state["done"], F.array(state["now"])).alias("done"), start.alias("now"), T.visible_counts(start).alias("n"))

        def grown(s: Column) -> Column:
            first = s["now"] == F.lit("")
            now = F.when(first, x["text"]).otherwise(F.concat(s["now"], F.lit(joiner), x["text"]))
            return F.struct(s["done"].alias("done"), now.alias("now"), F.when(first, x["n"]).otherwise(added(s["n"], T.visible_counts(F.lit(joiner)), x["n"])).alias("n"))

        over = (state["now"] != F.lit("")) & (T.tokens_of_counts(state["n"]) + T.tokens_of_counts(x["n"]) > budget)
        return T.bound(F.when(over, T.bound(tail(state["now"], T.tokens_of_counts(state["n"])), opened)).otherwise(state), grown)

    def finish(state: Column) -> Column:
        last = F.when(stripped(state["now"]) != F.lit(""), F.array(state["now"])).otherwise(F.array().cast("array<string>"))
        return F.concat(state["done"], last)

    return F.aggregate(with_counts(parts), zero, step, finish)


def _packed_parts(parts: Column, budget: int, joiner: str) -> Column:
    """The same without an overlap: counts of characters add up, so each part is counted once and the state holds numbers."""

    items = F.transform(parts, T.visible_counts)
    zero = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(0).alias("i"), nothing().alias("n"))

    def step(state: Column, x: Column) -> Column:
        first = state["i"] == 0
        new = first | (T.tokens_of_counts(state["n"]) + T.tokens_of_counts(x) > budget)
        more = added(state["n"], T.visible_counts(F.lit(joiner)), x)
        starts = F.when(new, F.concat(state["starts"], F.array(state["i"]))).otherwise(state["starts"])
        return F.struct(starts.alias("starts"), (state["i"] + 1).alias("i"), F.when(new, x).otherwise(more).alias("n"))

    def texts(starts: Column) -> Column:
        def one(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(parts))
            return F.array_join(F.slice(parts, at + 1, end - at), joiner)

        return F.transform(starts, one)

    def whole(chunks: Column) -> Column:
        blank = (F.size(chunks) > 0) & (stripped(F.element_at(chunks, -1)) == F.lit(""))
        return F.when(blank, F.slice(chunks, F.lit(1), F.greatest(F.size(chunks) - 1, F.lit(0)))).otherwise(chunks)

    return T.bound(T.bound(F.aggregate(items, zero, step, lambda s: s["starts"]), texts), whole)


def trailing_lines(budget: int) -> Callable[[Column, Column], Column]:
    """The last whole lines of a chunk, until they have ``budget`` tokens; nothing of a chunk that has no more itself."""

    def of(chunk: Column, tokens: Column) -> Column:
        def step(have: Column, line: Column) -> Column:
            more = F.when(have == F.lit(""), line).otherwise(F.concat(line, F.lit("\n"), have))
            return F.when(T.token_count(have) >= budget, have).otherwise(more)

        return F.when(tokens > budget, F.aggregate(F.reverse(F.split(chunk, "\n")), F.lit(""), step)).otherwise("")

    return of


def trailing_chars(n: int) -> Callable[[Column, Column], Column]:
    return lambda chunk, tokens: F.right(chunk, F.lit(n))


def trailing_share(percent: int) -> Callable[[Column, Column], Column]:
    """The last ``percent`` of a chunk's characters."""
    return lambda chunk, tokens: F.right(chunk, F.floor(F.length(chunk) * percent / 100).cast("int"))


def naive(text: Column, budget: int = 128, delimiter: str = DEFAULT_DELIMITER, overlap: float = 0.0) -> Column:
    """Sections joined by the delimiter field up to ``budget`` tokens; ``overlap`` of them repeats as whole lines."""
    again = int(budget * overlap)
    return _fold(sections(text, delimiter), budget, delimiter, trailing_lines(again) if again else None)


def share_of(overlap: float) -> int:
    """Percent of an overlap given as a fraction below one or as percent, at most 90."""
    return max(0, min(90, int(overlap * 100 if 0 <= overlap < 1 else overlap)))


def by_size(text: Column, budget: int = 128, delimiter: str = DEFAULT_DELIMITER, overlap: float = 0.0) -> Column:
    """Like ``naive``, joined by line ends; sections above the budget are cut at sentences; the overlap counts characters."""
    cut = lambda s: F.when((F.length(s) > budget) & (T.token_count(s) > budget), F.filter(kept_sections(s, SENTENCE_END), lambda x: x != F.lit(""))).otherwise(F.array(s))
    again = budget * share_of(overlap) // 100
    return _fold(F.flatten(F.transform(sections(text, delimiter), cut)), budget, "\n", trailing_chars(again) if again else None)


def by_share(text: Column, budget: int = 128, delimiter: str = DEFAULT_DELIMITER, percent: int = 10) -> Column:
    """Sections joined by line ends; each chunk begins with the last ``percent`` of the one before."""
    return _fold(sections(text, delimiter), budget, "\n", trailing_share(percent) if percent else None)


def by_delimiters(text: Column, delimiters: list[str]) -> Column:
    """A chunk for each part that is not blank; its delimiter stays at its end."""
    return not_blank(kept_sections(text, pattern_of(sorted(set(delimiters), key=len, reverse=True))))


def whole(text: Column) -> Column:
    return not_blank(F.array(stripped(text)))


def with_children(chunks: Column, delimiters: list[str]) -> Column:
    """``struct<content, mom>``: chunks that fall in several parts are replaced by them, with the chunk as ``mom``."""
    pattern = pattern_of(sorted({d.strip() for d in delimiters if d.strip()}, key=len, reverse=True))

    def of(chunk: Column) -> Column:
        parts = F.filter(kept_sections(chunk, pattern), lambda x: x != F.lit(""))
        kids = F.transform(not_blank(parts), lambda x: F.struct(x.alias("content"), chunk.alias("mom")))
        alone = F.array(F.struct(chunk.alias("content"), F.lit(None).cast("string").alias("mom")))
        return F.when(F.size(parts) > 1, kids).otherwise(alone)

    return F.flatten(F.transform(chunks, of))


def counted_children(chunk: Column, delimiters: list[str]) -> Column:
    """``struct<content, mom, n>``: the different children of a chunk and how often it has them, without shuffling ``mom``."""

    def of(kids: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(kids) - 1), lambda i: (i == 0) | (F.get(kids, i)["content"] != F.get(kids, i - 1)["content"]))

        def counted(starts: Column) -> Column:
            def one(i: Column, k: Column) -> Column:
                kid, end = F.get(kids, i), F.coalesce(F.get(starts, k + 1), F.size(kids))
                return F.struct(kid["content"].alias("content"), kid["mom"].alias("mom"), (end - i).cast("long").alias("n"))

            return F.transform(starts, one)

        return F.when(F.size(kids) > 0, T.bound(starts, counted))

    return T.bound(F.array_sort(with_children(F.array(chunk), delimiters)), of)


def depth_of(line: Column, levels: list[str]) -> Column:
    """Place of the first pattern that a line holds, else null."""
    out = F.lit(None).cast("int")
    for depth, level in reversed(list(enumerate(levels))):
        out = F.when(stripped(line).rlike(level), F.lit(depth)).otherwise(out)
    return F.when(stripped(line) != F.lit(""), out)


def headed(text: Column, levels: list[str]) -> Column:
    """``struct<heading, depth, body>`` by headings; what stands before the first belongs to it; without any, one section."""

    def of(lines: Column) -> Column:
        marked = F.transform(lines, lambda x, i: F.struct(i.alias("i"), depth_of(x, levels).alias("depth"), stripped(x).alias("heading")))
        heads = F.filter(marked, lambda x: x["depth"].isNotNull())

        def section(found: Column) -> Column:
            def one(h: Column, k: Column) -> Column:
                end = F.coalesce(F.get(found, k + 1)["i"], F.size(lines))
                own = F.slice(lines, h["i"] + 2, end - h["i"] - 1)
                before = F.when(k == 0, F.slice(lines, F.lit(1), h["i"])).otherwise(F.array().cast("array<string>"))
                return F.struct(h["heading"].alias("heading"), h["depth"].alias("depth"), F.array_join(F.concat(before, own), "\n").alias("body"))

            alone = F.array(F.struct(F.lit("").alias("heading"), F.lit(0).alias("depth"), F.array_join(lines, "\n").alias("body")))
            return F.when(F.size(found) > 0, F.transform(found, one)).otherwise(alone)

        return T.bound(heads, section)

    return T.bound(F.split(text, "\n"), of)


def rendered(section: Column, with_heading: bool = True) -> Column:
    body = stripped(section["body"])
    return F.when(section["heading"] != F.lit(""), F.concat(section["heading"], F.lit("\n"), body)).otherwise(body) if with_heading else body


def by_title(text: Column, levels: list[str], target: int = 1, with_heading: bool = True) -> Column:
    """A chunk for each section above the ``target`` depth, deeper ones inside it."""

    def step(state: Column, s: Column) -> Column:
        own = F.struct(s["heading"].alias("heading"), s["body"].alias("body"))
        last = F.element_at(state, -1)
        joined = F.when(last["body"] != F.lit(""), F.concat(last["body"], F.lit("\n"), rendered(s))).otherwise(rendered(s))
        inside = F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(F.struct(last["heading"].alias("heading"), joined.alias("body"))))
        return F.when((s["depth"] < target) | (F.size(state) == 0), F.concat(state, F.array(own))).otherwise(inside)

    zero = F.array().cast("array<struct<heading:string,body:string>>")
    return not_blank(F.transform(F.aggregate(headed(text, levels), zero, step), lambda s: rendered(s, with_heading)))


def by_title_group(text: Column, levels: list[str]) -> Column:
    """Neighbouring sections joined until they have 32 tokens (another heading follows) or 1024."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit("").alias("of"), nothing().alias("n"))

    def step(state: Column, s: Column) -> Column:
        def full(n: Column) -> Column:
            return (state["now"] != F.lit("")) & (((n >= GROUP_LEAST) & (s["heading"] != state["of"])) | (n >= GROUP_MOST))

        def grown(full: Column) -> Column:
            new = full | (state["now"] == F.lit(""))
            done = F.when(full, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"])
            now = F.when(new, s["text"]).otherwise(F.concat(state["now"], F.lit("\n"), s["text"]))
            n = F.when(new, s["n"]).otherwise(added(state["n"], T.visible_counts(F.lit("\n")), s["n"]))
            return F.struct(done.alias("done"), now.alias("now"), s["heading"].alias("of"), n.alias("n"))

        return T.bound(T.bound(T.tokens_of_counts(state["n"]), full), grown)

    def finish(state: Column) -> Column:
        return not_blank(F.concat(state["done"], F.array(state["now"])))

    texts = F.transform(headed(text, levels), lambda s: F.struct(s["heading"].alias("heading"), rendered(s).alias("text")))
    texts = F.filter(texts, lambda s: stripped(s["text"]) != F.lit(""))
    items = F.transform(texts, lambda s: F.struct(s["heading"].alias("heading"), s["text"].alias("text"), T.visible_counts(s["text"]).alias("n")))
    return F.aggregate(items, zero, step, finish)


def root_as_heading(chunks: Column) -> Column:
    """The first chunk stands before each of the others and goes; a single one stays."""

    def of(all_: Column) -> Column:
        root, rest = stripped(all_[0]), F.slice(all_, F.lit(2), F.greatest(F.size(all_) - 1, F.lit(0)))
        with_root = F.transform(rest, lambda x: F.when(root == F.lit(""), x).otherwise(F.concat(root, F.lit("\n"), x)))
        return F.when(F.size(all_) > 1, with_root).otherwise(all_)

    return T.bound(chunks, of)


STRATEGIES = {"token": by_size, "one": lambda text, **_: whole(text), "naive": naive}


def strategy(name: str) -> Callable[..., Column]:
    """The chunker of a name; unknown ones are ``naive``."""
    return STRATEGIES.get(name, naive)


def rows(docs: DataFrame, key: str, chunks: Column) -> DataFrame:
    """``key, position, content, token_count``."""
    out = docs.select(key, F.posexplode(chunks).alias("position", "content"))
    return out.withColumn("token_count", T.token_count(F.col("content"))).withColumn("position", F.col("position").cast("long"))


def markdown_blocks(text: Column) -> Column:
    """Parts between blank lines; a fenced block stays whole."""
    fenced = F.regexp_replace(text, r"(?s)(```.*?```)", "\u0000$1\u0000")

    def of(part: Column) -> Column:
        return F.when(part.startswith("```"), F.array(part)).otherwise(not_blank(F.split(part, r"\n[ \t]*\n")))

    return F.transform(not_blank(F.flatten(F.transform(F.split(fenced, "\u0000"), of))), stripped)


def merged_small(parts: Column, least: int) -> Column:
    """Parts joined by blank lines until they have ``least`` tokens; a short rest joins the last one."""
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), nothing().alias("n"))

    def step(state: Column, x: Column) -> Column:
        def closed(s: Column) -> Column:
            full = F.struct(F.concat(state["done"], F.array(s["now"])).alias("done"), F.lit("").alias("now"), nothing().alias("n"))
            return F.when(T.tokens_of_counts(s["n"]) >= least, full).otherwise(F.struct(state["done"].alias("done"), s["now"].alias("now"), s["n"].alias("n")))

        first = state["now"] == F.lit("")
        now = F.when(first, x["text"]).otherwise(F.concat(state["now"], F.lit("\n\n"), x["text"]))
        n = F.when(first, x["n"]).otherwise(added(state["n"], T.visible_counts(F.lit("\n\n")), x["n"]))
        return T.bound(F.struct(now.alias("now"), n.alias("n")), closed)

    def finish(state: Column) -> Column:
        done, n = state["done"], F.size(state["done"])
        last = F.concat(F.slice(done, F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.element_at(done, -1), F.lit("\n\n"), state["now"])))
        return F.when(state["now"] == F.lit(""), done).when(n == 0, F.array(state["now"])).otherwise(last)

    return F.aggregate(with_counts(parts), zero, step, finish)


def question_rows(text: Column) -> Column:
    """``struct<question, answer>`` of tab-separated lines; a line without a tab goes on with the answer before it."""
    zero = F.array().cast("array<struct<question:string,answer:string>>")

    def step(state: Column, line: Column) -> Column:
        cells = F.split(line, "\t")
        new = F.struct(cells[0].alias("question"), cells[1].alias("answer"))
        last = F.element_at(state, -1)
        more = F.struct(last["question"].alias("question"), F.concat(last["answer"], F.lit("\n"), line).alias("answer"))
        grown = F.when(F.size(state) > 0, F.concat(F.slice(state, F.lit(1), F.size(state) - 1), F.array(more))).otherwise(state)
        return F.when(F.size(cells) == 2, F.concat(state, F.array(new))).otherwise(grown)

    return F.aggregate(F.split(text, "\n"), zero, step)


def positions(text: Column) -> Column:
    """``struct<page, left, right, top, bottom>`` of position tags; a range of pages gives one for each named page."""
    pages = F.regexp_extract_all(text, F.lit(POSITION_TAG), F.lit(1))
    sides = [F.regexp_extract_all(text, F.lit(POSITION_TAG), F.lit(i)) for i in range(2, 6)]
    zipped = F.arrays_zip(pages.alias("page"), *[s.alias(n) for s, n in zip(sides, ("left", "right", "top", "bottom"), strict=True)])

    def of(tag: Column) -> Column:
        numbers = F.filter(F.transform(F.split(tag["page"], "-"), lambda p: p.try_cast("int")), lambda p: p.isNotNull())
        return F.transform(numbers, lambda p: F.struct(p.alias("page"), *[tag[n].cast("double").cast("int").alias(n) for n in ("left", "right", "top", "bottom")]))

    return F.flatten(F.transform(zipped, of))


def without_positions(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"@@[\t0-9.\-]+?##", ""))


def packed(sizes: Column, budget: int) -> Column:
    """Number of the batch of each item when items in order fill batches of ``budget``; a larger item is a batch."""
    zero = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("batch"), F.lit(0).cast("long").alias("n"))

    def step(state: Column, size: Column) -> Column:
        over = (state["n"] > 0) & (state["n"] + size > budget)
        batch = state["batch"] + over.cast("int")
        n = F.when(over, size).otherwise(state["n"] + size)
        return F.struct(F.concat(state["at"], F.array(batch)).alias("at"), batch.alias("batch"), n.cast("long").alias("n"))

    return F.aggregate(sizes, zero, step, lambda s: s["at"])
