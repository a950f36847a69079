"""File contents to rows, as expressions over a binary or text column."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.sources.staging import staged

#: Byte order marks and the encodings they stand for.
MARKS = (("EFBBBF", "UTF-8"), ("FFFE", "UTF-16LE"), ("FEFF", "UTF-16BE"))
TEXT = "[^\\s]"


def decoded(content: Column) -> Column:
    """Text by its byte order mark, else UTF-8; null for invalid UTF-8, which a strict reader refuses."""
    out = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    for mark, name in reversed(MARKS):
        n = len(mark) // 2
        head = F.hex(F.substring(content, 1, n)) == mark
        body = F.substring(content, F.lit(n + 1), F.greatest(F.octet_length(content) - n, F.lit(0)))
        read = F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")) if name == "UTF-8" else F.decode(body, name)
        out = F.when(head, read).otherwise(out)
    return out


def checked(text: Column, source: Column) -> Column:
    """The text, or an error that names its source if it could not be decoded."""
    return F.when(text.isNotNull(), text).otherwise(F.raise_error(F.concat(F.lit("not valid UTF-8: "), source.cast("string"))))


def lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def csv_rows(text: Column, schema: str, header: bool = True) -> Column:
    """Records of a CSV text without line ends inside cells; booleans and dates stay text."""
    rows = F.filter(lines(text), lambda x: F.trim(x) != F.lit(""))
    rows = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))) if header else rows
    return F.transform(rows, lambda x: F.from_csv(x, schema, {"escape": '"'}))


def is_json(text: Column) -> Column:
    """One JSON value; a first line that is one already must be the only one."""
    rest = F.regexp_extract(text, r"(?s)^\s*[^\n]*\n\s*(\S)", 1)
    alone = (rest != F.lit("")) & F.try_parse_json(F.regexp_extract(text, r"^\s*([^\n]*)", 1)).isNotNull()
    return F.try_parse_json(text).isNotNull() & ~alone


def is_json_lines(text: Column, sample: int = 10, share: float = 0.8) -> Column:
    """Whether most of the first lines are JSON and the whole is not."""
    some = F.slice(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != F.lit("")), 1, sample)

    def of(found: Column) -> Column:
        valid = F.size(F.filter(found, is_json))
        return (valid > 0) & (valid >= F.size(found) * F.lit(share)) & ~is_json(text)

    return T.bound(some, of)


def json_records(text: Column) -> Column:
    """Valid lines of JSON lines, else the whole text as one record; text that is neither gives none."""
    each = F.filter(F.split(text, "\n"), lambda x: (F.trim(x) != F.lit("")) & is_json(x))
    return F.when(is_json_lines(text), each).when(is_json(text), F.array(text)).otherwise(F.array().cast("array<string>"))


#: Beyond these, and for numbers with a fraction, doubled keys, lists of lists and the like, Spark's own parser decides.
MOST_BYTES, MOST_DEPTH, MOST_NUMBER = 1 << 20, 500, 10**18
LEAVES_AT_ONCE = 50_000
SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def _unsure(*_):
    raise ValueError("left to Spark's parser")


def _once(pairs: list) -> dict:
    found = dict(pairs)
    return found if len(found) == len(pairs) else _unsure()


def _plain(x) -> str:
    if isinstance(x, str):
        return x
    if x is None or isinstance(x, bool):
        return {None: "null", True: "true", False: "false"}[x]
    return str(x) if abs(x) < MOST_NUMBER else _unsure()


LOADS = json.JSONDecoder(object_pairs_hook=_once, parse_float=_unsure, parse_constant=_unsure).decode


def plain_leaves(raw: bytes) -> list[tuple[str, str]]:
    """Paths and values of the leaves of a JSON text whose reading is beyond doubt; else a ``ValueError``."""
    text = raw.decode()
    if len(raw) > MOST_BYTES or SURROGATE.search(text):
        _unsure()
    out, now = [], [("", LOADS(text))]
    for _ in range(MOST_DEPTH):
        inner = []
        for path, x in now:
            if isinstance(x, dict):
                inner += [(f"{path}.{k}" if path else k, y) for k, y in x.items()]
            elif not isinstance(x, list):
                out.append((path, _plain(x)))
            elif x and all(isinstance(y, dict) for y in x):
                inner += [(f"{path}[{n}]", y) for n, y in enumerate(x)]
            elif any(isinstance(y, (dict, list)) for y in x):
                _unsure()
            else:
                out.append((path, f"[{', '.join(map(_plain, x))}]"))
        if not inner:
            return out
        now = inner
    _unsure()


def read_plainly(df: DataFrame, key: str, text: str) -> DataFrame:
    """Staged ``key, path, value`` of the leaves of texts that ``plain_leaves`` reads, and ``key, _rest`` of the others."""
    kind = df.schema[key].dataType.simpleString()

    def found_in(raw: bytes) -> list[tuple]:
        try:
            return [(path, value, None) for path, value in plain_leaves(raw)]
        except (ValueError, RecursionError):
            return [(None, None, raw)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, rows = [], []

            def done(keys=batch.column(0)) -> pa.RecordBatch:
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)]
                return pa.RecordBatch.from_arrays([keys.take(pa.array(place, pa.int64())), *columns], [key, "path", "value", "_rest"])

            for i, raw in enumerate(batch.column(1)):
                found = found_in(raw.as_py())
                place += [i] * len(found)
                rows += found
                if len(rows) >= LEAVES_AT_ONCE:
                    yield done()
                    place, rows = [], []
            if rows:
                yield done()

    rows = df.where(F.col(text).isNotNull()).select(key, F.col(text).cast("binary").alias("_raw"))
    return staged(rows.mapInArrow(run, f"`{key}` {kind}, path string, value string, _rest binary"), "json-leaves")


def flattened(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, path, value`` of all leaves of a JSON column, as ``a.b[0].c``, at any depth.

    Lists of plain values are one leaf ``[x, y]``; an empty list is ``[]``, an empty object gives nothing. Most texts are
    read in one pass. For the others a level of nesting is a step over all rows: each is staged, and the walk ends when no
    object or list is left open.
    """
    spark = df.sparkSession
    read = read_plainly(df, key, text)
    out, rest = read.where("_rest IS NULL").select(key, "path", "value"), read.where("_rest IS NOT NULL")
    if rest.isEmpty():
        return out
    now = rest.select(key, F.lit("").alias("path"), F.try_parse_json(F.col("_rest").cast("string")).alias("v")).where("v IS NOT NULL")
    while True:
        kind = F.schema_of_variant("v")
        plain_list = kind.startswith("ARRAY<") & ~F.contains(kind, F.lit("OBJECT"))
        inner = (kind.startswith("OBJECT<") | kind.startswith("ARRAY<")) & ~plain_list
        rows = now.withColumn("_inner", inner).withColumn("_list", plain_list)
        items = F.concat(F.lit("["), F.array_join(F.transform(F.try_variant_get("v", "$", "array<string>"), lambda x: F.coalesce(x, F.lit("null"))), ", "), F.lit("]"))
        value = F.when(F.col("_list"), items).otherwise(F.coalesce(F.try_variant_get("v", "$", "string"), F.lit("null")))
        value = F.when(~F.col("_inner"), value)
        level = rows.where(F.schema_of_variant("v") != "OBJECT<>").select(key, "path", value.alias("value"), F.when(F.col("_inner"), F.to_json("v")).alias("_open"))
        level = staged(level, "json-level")
        leaf = level.where("_open IS NULL").select(key, "path", "value")
        out = out.unionByName(leaf)
        open_ = level.where("_open IS NOT NULL").select(key, "path", F.parse_json("_open").alias("v"))
        if open_.isEmpty():
            return out
        parts = open_.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key").alias("_k"), F.col("value").alias("_v")))
        name = F.when(F.col("_k").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("_k"))
        now = parts.select(key, name.otherwise(F.concat_ws(".", "path", "_k")).alias("path"), F.col("_v").alias("v"))


def json_text(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def lists_as_maps(value):
    """Lists become objects by index, so that they can be cut like objects."""
    if isinstance(value, list):
        value = {str(i): x for i, x in enumerate(value)}
    return {k: lists_as_maps(x) for k, x in value.items()} if isinstance(value, dict) else value


def json_pieces(value, most: int, least: int) -> list[dict]:
    """Objects of about ``most`` characters that together hold the value, each part at its own path.

    Entries are taken in order. One that fits the open object goes in whole; otherwise an open object of at least
    ``least`` is closed and the entry's own entries are taken one by one; what can't be cut goes in as it is.
    """
    pieces, size = [{}], 2

    def put(path: tuple, part) -> int:
        at = pieces[-1]
        for name in path[:-1]:
            at = at.setdefault(name, {})
        at[path[-1]] = part
        return len(json_text(pieces[-1]))

    waiting = [((), value)]
    while waiting:
        path, part = waiting.pop()
        if path and len(json_text({path[-1]: part})) < most - size:
            size = put(path, part)
            continue
        if path and size >= least:
            pieces.append({})
            size = 2
        if isinstance(part, dict):
            waiting += [((*path, k), x) for k, x in reversed(part.items())]
        else:
            size = put(path or ("",), part)
    return [p for p in pieces if p]


def json_chunks(df: DataFrame, key: str, text: str, most: int = 2000, lists: bool = True) -> DataFrame:
    """``key, position, content``: each JSON text as objects of about ``most`` characters; text that is no JSON gives none."""
    kind = df.schema[key].dataType.simpleString()
    least = max(most - 200, 50)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                try:
                    value = json.loads(raw) if raw is not None else None
                except ValueError:
                    continue
                if value is not None:
                    pieces = json_pieces(lists_as_maps(value) if lists else value, most, least)
                    rows += [(i, n, json_text(p)) for n, p in enumerate(pieces)]
            place, number, content = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0).take(pa.array(place, pa.int64())), pa.array(number, pa.int64()), pa.array(content, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "position", "content"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, position long, content string")


def markdown_elements(text: Column) -> Column:
    """``struct<kind, content>`` of headers, fenced code, lists, quotes, tables and text, in order."""
    zero = F.struct(F.array().cast("array<struct<kind:string,content:string>>").alias("done"), F.lit("").alias("kind"), F.lit("").alias("now"))

    def kind_of(line: Column) -> Column:
        return (
            F.when(line.rlike(r"^#{1,6}\s"), "header").when(line.rlike(r"^\s*```"), "code").when(line.rlike(r"^\s*([-*+]|\d+\.)\s"), "list")
            .when(line.rlike(r"^\s*>"), "quote").when(line.rlike(r"^\s*\|.*\|"), "table").when(F.trim(line) != "", "text").otherwise("")
        )

    def closed(state: Column) -> Column:
        item = F.struct(state["kind"].alias("kind"), F.trim(state["now"]).alias("content"))
        return F.when(F.trim(state["now"]) != "", F.concat(state["done"], F.array(item))).otherwise(state["done"])

    def step(state: Column, line: Column) -> Column:
        def of(kind: Column) -> Column:
            in_code = (state["kind"] == "code") & state["now"].rlike(r"^\s*```")
            ends = in_code & (kind == "code")
            goes_on = in_code | ((kind == state["kind"]) & (kind != "header") & (kind != "code") & (kind != ""))
            joined = F.concat(state["now"], F.lit("\n"), line)
            finished = F.struct(F.concat(state["done"], F.array(F.struct(F.lit("code").alias("kind"), F.trim(joined).alias("content")))).alias("done"), F.lit("").alias("kind"), F.lit("").alias("now"))
            more = F.struct(state["done"].alias("done"), state["kind"].alias("kind"), joined.alias("now"))
            new = F.struct(closed(state).alias("done"), kind.alias("kind"), line.alias("now"))
            return F.when(ends, finished).when(goes_on, more).otherwise(new)

        return T.bound(kind_of(line), of)

    return F.aggregate(lines(text), zero, step, closed)


def markdown_tables(text: Column) -> Column:
    """Cells of each table row, without the rule under the head."""
    rows = F.filter(lines(text), lambda x: x.rlike(r"^\s*\|.*\|\s*$") & ~x.rlike(r"^[\s|:-]+$"))
    return F.transform(rows, lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x)))


def html_blocks(html: Column) -> Column:
    """``struct<tag, content>`` of headings, paragraphs, list items and table cells, inner tags gone, empty ones left out."""
    clean = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    pattern = r"(?is)<(h[1-6]|p|li|td|th)(?:\s[^>]*)?>(.*?)(?=</?(?:h[1-6]|p|li|td|th|ul|ol|div|tr|table|article|body)[\s>])"
    tags, inner = (F.regexp_extract_all(clean, F.lit(pattern), F.lit(i)) for i in (1, 2))

    def of(tag: Column, content: Column) -> Column:
        plain = T.single_blanks(T.entities(F.regexp_replace(content, "<[^>]*>", "")))
        level = F.when(tag.rlike("(?i)^h[1-6]$"), F.concat(F.repeat(F.lit("#"), F.substring(tag, 2, 1).cast("int")), F.lit(" "))).otherwise("")
        return F.struct(F.lower(tag).alias("tag"), F.when(plain != "", F.concat(level, plain)).otherwise("").alias("content"))

    return F.filter(F.zip_with(tags, inner, of), lambda x: x["content"] != F.lit(""))
