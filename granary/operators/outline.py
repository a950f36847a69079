"""Chunks along a document's outline: sections, a tree of headings, and lines under their headings.

Everything works on a long table of lines (``key, pos, text, layout``), one row a line. Levels are expressions; the stack
of open headings at a line is the last heading of each level before it, as far as no higher one came since. That is a
window over the document's lines, so no document is ever gathered in one value until its chunks are written.

Lines without a word of more than one character that isn't a number are left out of the two merges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import bound
from granary.sources.staging import staged

#: Five families of headings, highest level first; a text follows the family with the most matching lines.
FAMILIES = [
    [
        r"第[零一二三四五六七八九十百0-9]+(分?编|部分)",
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"第[零一二三四五六七八九十百0-9]+条",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
    ],
    [
        r"第[0-9]+章",
        r"第[0-9]+节",
        r"[0-9]{0,2}[\. 、]",
        r"[0-9]{0,2}\.[0-9]{0,2}[^a-zA-Z/%~-]",
        r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}",
        r"[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}\.[0-9]{0,2}",
    ],
    [
        r"第[零一二三四五六七八九十百0-9]+章",
        r"第[零一二三四五六七八九十百0-9]+节",
        r"[零一二三四五六七八九十百]+[ 、]",
        r"[\(（][零一二三四五六七八九十百]+[\)）]",
        r"[\(（][0-9]{0,2}[\)）]",
    ],
    [
        r"PART (ONE|TWO|THREE|FOUR|FIVE|SIX|SEVEN|EIGHT|NINE|TEN)",
        r"Chapter (I+V?|VI*|XI|IX|X)",
        r"Section [0-9]+",
        r"Article [0-9]+",
    ],
    [r"^#[^#]", r"^##[^#]", r"^###.*", r"^####.*", r"^#####.*", r"^######.*"],
]
#: Numbered lines that are no headings, an article's number, marks of a sentence, and the sizes of a title.
NO_BULLET = r"^(?:0|[0-9]+ +[0-9~个只-]|[0-9]+\.{2,})"
ARTICLE, SENTENCE = r"^(?:第[零一二三四五六七八九十百0-9]+条)", r"[,;，。；！!]"
TITLE_WORDS, TITLE_CHARS = 12, 32
SINGLES = 218
MOST_LEVELS = max(map(len, FAMILIES)) + 2


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, text, layout`` of the lines that aren't empty."""
    rows = docs.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\r?\n")).alias("pos", "text"))
    return rows.where("text <> ''").withColumn("layout", F.lit(""))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def head(text: Column) -> Column:
    """What stands before a position mark."""
    return F.split(text, "@")[0]


def no_title(text: Column) -> Column:
    """Too long for a title, or with marks of a sentence."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != F.lit("")))
    long = (words > TITLE_WORDS) | (~text.contains(" ") & (F.length(text) >= TITLE_CHARS))
    return ~text.rlike(ARTICLE) & (long | text.rlike(SENTENCE))


def family_of(lines: DataFrame) -> DataFrame:
    """``key, family``: the first family with the most lines that match it, -1 for none."""

    def matches(line: Column) -> Column:
        """For each family whether a line matches it."""
        fits = F.array(*[line.rlike("|".join(f"^(?:{p})" for p in f)) for f in FAMILIES])
        return F.when(~line.rlike(NO_BULLET), fits)

    lines = lines.select("key", bound(trimmed(F.col("text")), matches).alias("_m"))
    hits = [F.count_if(F.get("_m", F.lit(i))).alias(f"_{i}") for i in range(len(FAMILIES))]
    most = F.greatest(*[f"_{i}" for i in range(len(FAMILIES))])
    family = F.lit(-1)
    for i in reversed(range(len(FAMILIES))):
        family = F.when((most > 0) & (F.col(f"_{i}") == most), i).otherwise(family)
    return lines.groupBy("key").agg(*hits).select("key", family.alias("family"))


def levelled(lines: DataFrame, bullets_only: bool = False) -> DataFrame:
    """Adds ``family, size`` (levels of the family) and ``level``: 0 is the highest; ``size`` a title by layout, ``size + 1`` any other.

    With ``bullets_only``, a numbered line that is no heading has no level of its family.
    """
    rows = lines.join(family_of(lines), "key")
    size = F.element_at(F.array(F.lit(0), *[F.lit(len(f)) for f in FAMILIES]), F.col("family") + 2)
    title = (F.col("layout").contains("title") | F.col("layout").contains("head")) & ~no_title(head(F.col("text")))
    level = F.when((F.col("family") >= 0) & title, F.col("size")).otherwise(F.col("size") + 1)
    allowed = ~F.col("text").rlike(NO_BULLET) if bullets_only else F.lit(True)

    def found(line: Column) -> Column:
        """The first level of the family that a line matches."""
        out = None
        for f, patterns in enumerate(FAMILIES):
            own = F.coalesce(*[F.when(line.rlike(f"^(?:{p})"), i) for i, p in enumerate(patterns)])
            out = F.when(F.col("family") == f, own) if out is None else out.when(F.col("family") == f, own)
        return out

    own = F.when((F.col("family") >= 0) & allowed, bound(trimmed(F.regexp_replace("text", "　", " ")), found))
    return rows.withColumn("size", size).withColumn("level", F.coalesce(own, level))


def joined(rows: DataFrame, keys: list[str], order: list[str], text: str, name: str) -> DataFrame:
    """``keys, name``: the texts of each group in order, as lines."""
    parts = F.sort_array(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), "\n").alias(name))


def section_groups(lines: DataFrame) -> DataFrame:
    """``key, section, content``: a section begins where the level changes to one that is as high as the most frequent.

    Of levels that are as frequent, the highest counts.
    """
    rows = levelled(lines, True)
    counts = rows.where("level <= size AND family >= 0").groupBy("key", "level").agg(F.count("*").alias("n"))
    pivot = counts.groupBy("key").agg(F.max_by("level", F.struct("n", -F.col("level"))).alias("most"))
    rows = rows.join(pivot, "key", "left")
    order = Window.partitionBy("key").orderBy("pos")
    begins = (F.col("level") <= F.coalesce("most", F.col("size") + 1)) & (F.col("level") != F.lag("level").over(order))
    section = F.sum(F.coalesce(begins, F.lit(False)).cast("int")).over(order)
    return joined(rows.withColumn("section", section), ["key", "section"], ["pos"], "text", "content")


def countable(lines: DataFrame) -> DataFrame:
    own = trimmed(head(F.col("text")))
    return lines.where((F.length(own) > 1) & ~own.rlike("^[0-9]*$"))


def last_of_levels(level: str, order, levels: range) -> dict[int, Column]:
    """For each level, the last ``pos`` before a row that has it."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return {n: F.last(F.when(F.col(level) == n, F.col("pos")), ignorenulls=True).over(before) for n in levels}


def tree_chunks(lines: DataFrame, depth: int = 2) -> DataFrame:
    """``key, pos, content``: each leaf of the tree of headings, after the lines of all headings above it.

    The tree ends at the ``depth``-th of the levels that the text has (never at plain lines if there are others); deeper
    lines belong to the heading before them, lines before the first heading are a chunk of their own. Texts of no family
    stay line by line.
    """
    rows = levelled(lines)
    plain = rows.where("family < 0").select("key", "pos", F.col("text").alias("content"))
    rows = countable(rows.where("family >= 0")).withColumn("text", trimmed(F.regexp_replace("text", "　", " "))).where("text <> ''")
    levels = rows.groupBy("key").agg(F.sort_array(F.collect_set("level")).alias("_l"), F.first("size").alias("_size"))
    target = F.when(F.size("_l") >= depth, F.get("_l", F.lit(depth - 1))).otherwise(F.element_at("_l", -1))
    second = F.get("_l", F.greatest(F.size("_l") - 2, F.lit(0)))
    levels = levels.select("key", F.when(target == F.col("_size") + 1, second).otherwise(target).alias("_target"))
    order = Window.partitionBy("key").orderBy("pos")
    rows = rows.join(levels, "key").withColumn("_node", F.col("level") <= F.col("_target"))
    rows = rows.withColumn("_at", F.coalesce(F.last(F.when(F.col("_node"), F.col("pos")), ignorenulls=True).over(order), F.lit(-1)))
    rows = staged(rows.select("key", "pos", "text", "level", "_node", "_at"), "outline-lines")
    bodies = joined(rows, ["key", "_at"], ["pos"], "text", "_body")
    last = last_of_levels("level", order, range(MOST_LEVELS))
    higher, above = F.lit(-1), []
    for n in range(MOST_LEVELS):
        open_ = (F.col("level") > n) & (last[n] > higher)
        above.append(F.when(open_, last[n]))
        higher = F.greatest(higher, F.coalesce(last[n], F.lit(-1)))
    leaf = F.coalesce(F.lead("level").over(order) <= F.col("level"), F.lit(True))
    nodes = rows.where("_node").select("key", "pos", leaf.alias("_leaf"), F.array_compact(F.array(*above, F.col("pos"))).alias("_path"))
    root = rows.where("_at = -1").select("key", F.lit(-1).alias("pos")).distinct().withColumn("_path", F.array("pos"))
    paths = nodes.where("_leaf").select("key", "pos", "_path").unionByName(root)
    parts = paths.select("key", "pos", F.posexplode("_path").alias("_nth", "_at")).join(bodies, ["key", "_at"])
    return joined(parts, ["key", "pos"], ["_nth"], "_body", "content").unionByName(plain)


def hierarchical_groups(lines: DataFrame, depth: int = 5) -> DataFrame:
    """``key, number, content``: lines under their headings, plain lines first, then headings that stand over none, up to ``depth`` kinds.

    A line without a heading joins the group before it while that is short of ``SINGLES`` characters; a line with
    headings is a group of its own. Texts of no family give nothing.
    """
    rows = countable(levelled(lines).where("family >= 0")).withColumn("_g", F.col("size") + 1 - F.col("level"))
    order = Window.partitionBy("key").orderBy("pos")
    last = last_of_levels("_g", order, range(1, MOST_LEVELS))
    above = F.array_compact(F.array(*[F.when((F.col("_g") < n) & (F.col("_g") != F.col("size")), last[n]) for n in range(1, MOST_LEVELS)]))

    def step(path: Column, pos: Column) -> Column:
        nearer = pos > F.element_at(path, -1)  # a higher heading that came later stands in for the lower one
        return F.concat(F.when(nearer, F.slice(path, F.lit(1), F.size(path) - 1)).otherwise(path), F.array(pos))

    rows = rows.withColumn("_path", F.aggregate(above, F.array("pos"), step))
    rows = staged(rows.select("key", "pos", "text", "_g", "_path"), "outline-paths")
    found, used = None, None
    for g in range(min(depth, MOST_LEVELS)):
        own = rows.where(F.col("_g") == g)
        if used is not None:
            own = own.join(used.hint("merge"), ["key", "pos"], "left_anti")
        own = staged(own.select("key", "pos", "_g", "_path"), "outline-taken")
        more = own.select("key", F.explode("_path").alias("pos")).distinct()
        found, used = (own, more) if found is None else (found.unionByName(own), used.unionByName(more).distinct())
    texts = rows.select("key", F.col("pos").alias("_at"), "text")
    parts = found.select("key", "_g", "pos", F.size("_path").alias("_n"), F.posexplode(F.reverse("_path")).alias("_nth", "_at")).join(texts.hint("merge"), ["key", "_at"])
    chunks = joined(parts, ["key", "_g", "pos", "_n"], ["_nth"], "text", "_text")
    chars = F.length(F.regexp_replace("_text", "@@[0-9]+.*?##", ""))
    item = F.struct("_g", "pos", F.when(F.col("_n") == 1, chars).alias("chars"), "_text")
    gathered = chunks.groupBy("key").agg(F.sort_array(F.collect_list(item)).alias("_all"))
    zero = F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("group"), F.lit(0).alias("n"))

    def grouped(state: Column, x: Column) -> Column:
        fits = F.coalesce(x["chars"] + state["n"] < SINGLES, F.lit(False))
        group = F.when(fits, state["group"]).otherwise(state["group"] + 1)
        n = F.when(fits, state["n"] + x["chars"]).otherwise(F.coalesce(x["chars"], F.lit(SINGLES)))
        return F.struct(F.concat(state["at"], F.array(group)).alias("at"), group.alias("group"), n.alias("n"))

    numbers = F.aggregate("_all", zero, grouped, lambda s: s["at"])
    every = gathered.select("key", F.posexplode(F.arrays_zip(F.col("_all").alias("x"), numbers.alias("number"))).alias("_i", "z"))
    return joined(every.select("key", "_i", "z.number", F.col("z.x._text").alias("_text")), ["key", "number"], ["_i"], "_text", "content")
