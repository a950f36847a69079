"""Line-first quality rules, as DataFrame expressions only (operator 5).

A document is split at ``\\n``. Each line with a word is judged alone: markup symbols,
navigation separators, shouting, boilerplate phrases and missing punctuation fail it.
Failed lines go; a document whose surviving lines hold less than half of its word
characters is rejected. The base measures (length, repeated windows) are counted on the
whole text before any line goes.

Edge cases: a null or blank text has no words, so it fails the base rule; a null
``doc_id`` passes through; repeated rows are judged alike, one by one; further columns are kept,
and one that bears the name of a result column is replaced.
No row moves between partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import read_table

BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
MAX_SYMBOL_SHARE = 0.03
MIN_KEPT_SHARE = 0.5
BOILERPLATE = (
    r"\b(cookies? (policy|settings)|enable javascript|terms of (use|service)|privacy policy|"
    r"click here|sign (in|up)|log ?in to|subscribe (to|now)|lorem ipsum|skip to content)\b"
)
ENDS_SENTENCE = r"[.!?…:;。！？][\"'”’»)\]*]*\s*$"
HAS_SENTENCE = r"[.!?…。！？]\s"


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_array(text: Column) -> Column:
    """Maximal runs of characters other than the six ASCII blanks."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != F.lit(""))


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def has_word(line: Column) -> Column:
    return F.length(without(line, BLANKS)) > 0


def line_passes(line: Column) -> Column:
    size = F.length(line)
    symbols = size - F.length(without(line, SYMBOLS))
    separators = size - F.length(without(line, "|»›•"))
    low = F.lower(line)
    shouting = (F.upper(line) == line) & (low != line) & (size >= 20)
    return ~(
        (symbols > size * F.lit(MAX_SYMBOL_SHARE))
        | (separators >= 2)
        | shouting
        | low.rlike(BOILERPLATE)
        | ~(line.rlike(ENDS_SENTENCE) | line.rlike(HAS_SENTENCE))
    )


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` words that occur twice or more, the first included."""
    def windows(w: Column) -> Column:
        n = F.size(w)
        return F.when(n > width, F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(w, i, width))))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            marks = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]).otherwise(-1))
            return F.sort_array(F.filter(marks, lambda i: i >= 0))

        def step(acc: Column, i: Column) -> Column:
            return F.struct(
                (acc["n"] + width - F.greatest(F.lit(0), acc["to"] - i)).alias("n"), (i + width).alias("to")
            )

        return F.aggregate(
            bound(ordered, twins), F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"]
        )

    counted = bound(bound(words, windows), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)))
    return F.coalesce(counted, F.lit(0))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base measures, ``clean_text``, ``kept_share``, ``base_failed`` and ``kept``."""
    wanted = [c for c in docs.columns if c not in RESULT and c not in ("_words", "_lines", "_good")]
    out = docs.select(
        *wanted,
        word_array(text_of(text)).alias("_words"),
        F.filter(F.split(text_of(text), "\n"), has_word).alias("_lines"),
    )
    out = out.select(
        *wanted,
        F.size("_words").cast("long").alias("n_words"),
        F.length(without(text_of(text), BLANKS)).cast("long").alias("word_chars"),
        (F.length(text_of(text)) - F.length(without(text_of(text), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"),
        F.filter("_lines", line_passes).alias("_good"),
        F.size("_lines").cast("long").alias("n_lines"),
    )
    clean = F.array_join("_good", "\n")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = out.select(
        "*",
        clean.alias("clean_text"),
        F.size("_good").cast("long").alias("n_kept_lines"),
        failed.alias("base_failed"),
    ).withColumn(
        "kept_share",
        F.when(F.col("word_chars") > 0, F.length(without(F.col("clean_text"), BLANKS)) / F.col("word_chars")).otherwise(
            F.lit(0.0)
        ),
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_share") >= MIN_KEPT_SHARE)).drop("_good")


RESULT = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_kept_lines",
    "clean_text", "kept_share", "base_failed", "kept",
)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines", "n_kept_lines",
    )
