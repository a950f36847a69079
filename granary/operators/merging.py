"""Merging records that name the same thing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.sources.staging import staged


def exact_dedup(df: DataFrame, name: str, ord_: str, mentions: str) -> DataFrame:
    """Group by normalised name: first spelling, number of spellings, summed mentions."""
    key = F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")
    return df.groupBy(key.alias("name_key")).agg(
        F.min_by(name, ord_).alias("name"), F.countDistinct(name).alias("spellings"), F.sum(mentions).alias("mentions")
    )


def merge_entities(df: DataFrame, name: str, kind: str, ord_: str, text: str, mentions: str) -> DataFrame:
    """By lower-cased name and type: the longest description and its spelling (first on ties), summed mentions."""
    best = F.max_by(F.struct(F.col(text).alias("d"), F.col(name).alias("n")), F.struct(F.length(text), -F.col(ord_)))
    out = df.groupBy(F.lower(F.trim(name)).alias("name_key"), F.coalesce(kind, F.lit("unknown")).alias("kind")).agg(
        best.alias("b"), F.sum(mentions).alias("mentions"), F.countDistinct(ord_).alias("sources")
    )
    return out.select("name_key", "kind", F.col("b.n").alias("name"), F.col("b.d").alias("description"), "mentions", "sources")


def merge_relations(df: DataFrame, src: str, dst: str, kind: str, weight: str) -> DataFrame:
    """By trimmed, lower-cased ends and type (default ``related``): summed weight and number of records."""
    end = lambda c: F.lower(F.trim(c))
    kinds = F.coalesce(F.nullif(end(kind), F.lit("")), F.lit("related"))
    return df.groupBy(end(src).alias("src"), kinds.alias("kind"), end(dst).alias("dst")).agg(
        F.sum(weight).alias("weight"), F.count("*").alias("n")
    )


def most_common(df: DataFrame, keys: list[str], value: str, ord_: str) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(ord_).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("_n", -F.col("_first"))).alias(value))


#: Rows that one row of a pair of names is repeated to at most, before they are dealt to other tasks.
COPIES = 100_000


def shortened(text: Column, edits: int) -> Column:
    """The text and all that is left of it after leaving out up to ``edits`` characters."""

    def without_one(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
        return F.when(F.length(w) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    levels = [F.array(text)]
    for _ in range(edits):
        levels.append(F.array_distinct(F.flatten(F.transform(levels[-1], without_one))))
    return F.concat(*levels)


def edit_pairs(df: DataFrame, kind: str, name: str, edits: int) -> DataFrame:
    """``a < b`` of every two rows of one kind whose names differ by one to ``edits`` edits.

    Such names have a text in common after leaving out up to ``edits`` characters of each, so only names that do are
    compared. Different names are compared once; a pair is then repeated as often as rows have both names. A name of
    n characters has up to ``n ** edits`` such texts: this is for short names.
    """
    names = staged(df.where(F.col(kind).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(kind).alias("kind"), F.col(name).alias("a")).agg(F.count("*").alias("na")), "edit-names")
    spread = names.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "kind", "a")  # few bytes, but much work
    each = spread.withColumn("_v", F.explode(F.transform(shortened(F.col("a"), edits), lambda v: F.xxhash64(v))))
    other = each.withColumnsRenamed({"a": "b", "na": "nb"})
    near = each.join(other.hint("merge"), ["kind", "_v"]).where((F.col("a") < F.col("b")) & (F.levenshtein("a", "b", edits) >= 0))
    pairs = staged(near.select("kind", "a", "b", (F.col("na") * F.col("nb")).alias("n")).distinct(), "edit-pairs")
    parts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / COPIES) - 1)).alias("_part")
    some = pairs.where(F.col("n") > 1).select("a", "b", "n", parts).repartition("a", "b", "_part")
    copies = F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES), F.col("n") - F.col("_part") * COPIES))
    return pairs.where(F.col("n") == 1).select("a", "b").unionByName(some.select("a", "b", F.explode(copies)).select("a", "b"))


#: Hashes a task groups or sorts; slices of all hashes, ascending, by which sets that pair with none are found.
HASHES_A_TASK = 1_000_000
SLICES = (0.3, 0.6)


def hashed_sets(df: DataFrame, key: str, things: str) -> tuple[DataFrame, DataFrame]:
    """Staged ``key, s, n`` of rows with things (their distinct 64-bit hashes ascending), and staged ``key, id`` of copies.

    A copy has the same set as a smaller key, ``id`` is the smallest of them. Equal sets are found by 128 bits of their
    hashes, so whole sets are not shuffled for it.
    """
    hashes = F.array_sort(F.array_distinct(F.transform(things, lambda g: F.xxhash64(g))))
    sets = df.where(F.size(things) > 0).select(key, hashes.alias("s"))
    sets = staged(sets.select(key, "s", F.size("s").alias("n"), F.struct(F.xxhash64("s").alias("x"), F.xxhash64(F.lit(7), "s").alias("y")).alias("_k")), "hashed-sets")
    least = sets.groupBy("_k").agg(F.min(key).alias("id"))
    copies = staged(sets.select(key, "_k").join(least, "_k").where(F.col(key) != F.col("id")).select(key, "id"), "set-copies")
    return sets.select(key, "s", "n"), copies


def classes_of(sets: DataFrame, copies: DataFrame, key: str) -> DataFrame:
    """``key, id`` of all rows of ``hashed_sets``: rows with equal sets share the smallest key."""
    return sets.select(key).join(copies, key, "left").select(key, F.coalesce("id", key).alias("id"))


def near_text_pairs(df: DataFrame, key: str, shingles: str, share: float) -> DataFrame:
    """``near_set_pairs`` of rows with their distinct shingles."""
    return near_set_pairs(*hashed_sets(df, key, shingles), key, share)


def grouping_tasks(sets: DataFrame, part: float) -> int:
    """Tasks that group this part of the sets' hashes, so that tasks grow in number and not in size."""
    width = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(width, int((sets.agg(F.sum("n")).first()[0] or 0) * part / HASHES_A_TASK) + 1)


def sets_that_may_pair(sets: DataFrame, copies: DataFrame, key: str, share: float) -> DataFrame:
    """Staged ``id`` of the sets, copies aside, that may be alike to another by ``share``.

    A set of n hashes lacks at most ``n - ceil(share * n)`` of them in one like it. So it pairs with none if more of its
    hashes are in no other set, and a slice of all hashes often shows that many: only slices are shuffled, the second
    one of the sets that the first has left.
    """
    cuts = [round((2 * p - 1) * (1 << 63)) for p in (0.0, *SLICES)]
    spare = (F.col("n") - F.ceil(F.col("n") * share)).cast("long")
    left = None
    for low, high in zip(cuts, cuts[1:], strict=False):
        rows = sets.select(F.col(key).alias("id"), spare.alias("spare"), "n", F.filter("s", lambda g: (g >= low) & (g < high)).alias("s"))
        rows = rows.join(copies.select(F.col(key).alias("id")), "id", "left_anti") if left is None else rows.select("id", "s").join(left, "id")
        tasks = grouping_tasks(sets if left is None else left, (high - low) / (1 << 64))
        each = rows.select("id", F.explode("s").alias("g")).repartition(tasks, "g")
        alone = each.groupBy("g").agg(F.min("id").alias("id"), F.max("id").alias("_most")).where(F.col("id") == F.col("_most"))
        alone = alone.groupBy("id").agg(F.count("*").alias("alone"))
        now = rows.select("id", "n", "spare").join(alone, "id", "left").select("id", "n", (F.col("spare") - F.coalesce("alone", F.lit(0))).alias("spare"))
        left = staged(now.where("spare >= 0").groupBy("id").agg(F.max("n").alias("n"), F.max("spare").alias("spare")), "sets-left")
    return left


def near_set_pairs(sets: DataFrame, copies: DataFrame, key: str, share: float) -> DataFrame:
    """Pairs ``a < b, similarity`` of ``hashed_sets`` whose Jaccard similarity is at least ``share``.

    Prefix filter: such a pair shares one of its rarest ``n - ceil(share * n) + 1`` hashes. Hashes that one set alone has
    come first and pair with nothing, so a set with enough of them is done; most are by slices of their hashes. Of the
    others only the rest of that number is joined, rarest first. Every candidate is then compared in full. Rows with equal
    sets are one class: ``a`` and ``b`` are class ids (their smallest keys).
    """
    left = sets_that_may_pair(sets, copies, key, share)
    classes = sets.withColumnRenamed(key, "id").join(left.select("id"), "id", "left_semi").dropDuplicates(["id"])
    classes = staged(classes.select("id", "s", "n"), "near-classes")
    each = classes.select("id", "n", F.explode("s").alias("g")).repartition(grouping_tasks(left, 1.0), "g")
    counts = each.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(counts, "g").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("r"))
    left = (F.col("n") - F.ceil(F.col("n") * share) + 1 - (F.col("n") - F.size("r"))).cast("int")
    rare = shared.withColumn("_left", left).where("_left > 0").select("id", "n", F.explode(F.slice("r", F.lit(1), F.col("_left"))).alias("x"))
    rare = staged(rare.select("id", "n", "x.g"), "near-rare")
    a, b = rare.select(F.col("id").alias("a"), F.col("n").alias("na"), "g"), rare.select(F.col("id").alias("b"), F.col("n").alias("nb"), "g")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * share)
    pairs = a.join(b, "g").where(fits).select("a", "b").distinct()
    x, y = classes.select(F.col("id").alias("a"), F.col("s").alias("x")), classes.select(F.col("id").alias("b"), F.col("s").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    similarity = both / (F.size("x") + F.size("y") - both)
    return pairs.join(x, "a").join(y, "b").select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= share)
