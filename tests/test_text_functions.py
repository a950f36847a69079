"""Text functions on literals."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from granary.functions import text as T
from granary.operators import ranking as R


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


STEMS = {
    "nations": "nation", "nation": "nat", "creations": "cre", "walking": "walk", "studies": "studi", "study": "studi", "stopped": "stop",
    "boxes": "box", "make": "mak", "cats": "cat", "ring": "ring", "see": "see", "falling": "fal",
}


def plain_stem(word: str) -> str:
    out = word
    for ending, rest in T.STEM_ENDINGS:
        if word.endswith(ending) and len(word) - len(ending) >= 3:
            out = word[: len(word) - len(ending)] + rest
            break
    if len(out) > 3 and out.endswith("y"):
        out = out[:-1] + "i"
    if len(out) > 3 and out.endswith("e"):
        out = out[:-1]
    if len(out) > 3 and out[-1] == out[-2] and out[-1] not in "aeiou":
        out = out[:-1]
    return out


def test_stems(spark):
    words = [*STEMS, "happiness", "agreed", "tries", "glass", "y", "be", "off"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.stem(F.col("w")).alias("s")).collect()
    assert {r["w"]: r["s"] for r in rows} == {w: plain_stem(w) for w in words}
    assert value(spark, T.stem(F.lit("studies"))) == "studi" and value(spark, T.stem(F.lit("stopped"))) == "stop"


@pytest.mark.parametrize(
    ("make", "want"),
    [
        (lambda: T.is_number(F.lit("1,234.5%")), True),
        (lambda: T.is_number(F.lit("12a")), False),
        (lambda: T.is_number(F.lit(",")), False),
        (lambda: T.is_mostly_cjk(F.lit("中文ab")), True),
        (lambda: T.is_mostly_cjk(F.lit("かなかな")), False),
        (lambda: T.is_mostly_cjk(F.lit("")), False),
        (lambda: T.is_alphabetic(F.lit("abc1")), False),
        (lambda: T.is_english_query(F.lit("what is it?")), True),
        (lambda: T.is_english_query(F.lit("什么 是 it")), False),
        (lambda: T.half_width(F.lit("ＡＢ１　！")), "AB1 !"),
        (lambda: T.arabic_digits(F.lit("٣۴5")), "345"),
        (lambda: T.tokens(F.lit("The 中文 Quick-fox")), ["中", "文", "中文", "quick", "fox"]),
        (lambda: T.token_count(F.lit("中文字 abcde")), 4),
        (lambda: T.token_count(F.lit(" . ")), 1),
        (lambda: T.token_count(F.lit("  ")), 0),
        (lambda: T.sentences(F.lit("One. Two!  Three\nFour")), ["One.", "Two!", "Three", "Four"]),
        (lambda: T.plain_sentences(F.lit("v1.2 is out. Is 3.14 it?! 好。是")), ["v1.2 is out.", " Is 3.14 it?!", " 好。", "是"]),
        (lambda: T.cited(F.lit("a [ID:3] b [٤] [ID:3]")), [3, 4]),
        (lambda: T.repaired_citations(F.lit("(ID: 3) [ID 12] 【ID:5】 ref 7 (ID: 40)"), 13), "[ID:3] [ID:12] [ID:5] [ID:7] (ID: 40)"),
        (lambda: T.garbled_share(F.lit("ab�")), 0.5),
        (lambda: T.garbled_share(F.lit("")), 0.0),
        (lambda: T.truncated(F.lit("abcd efgh ijkl"), 2), "abcd efgh "),
        (lambda: T.truncated(F.lit("abcd"), 0), ""),
        (lambda: T.highlight_sentences(F.lit("A cat. A dog. Cats!"), ["cat"]), "A <em>cat</em>....<em>Cat</em>s!"),
        (lambda: T.without_hex(F.lit("a 0123456789abcdef b 0123456789abcde")), "a  b 0123456789abcde"),
        (lambda: T.is_identifier(F.lit(" C12 ")), True),
        (lambda: T.is_identifier(F.lit("12345678-1234-1234-1234-123456789abc")), True),
        (lambda: T.spaced_scripts(F.lit("用Spark3做ETL")), "用 Spark3 做 ETL"),
        (lambda: T.clean_query(F.lit("Please tell me about Spark")), "about spark"),
        (lambda: T.expanded(F.lit("fast car"), {"car": ["auto", "vehicle", "x"], "fast": ["quick"]}, 2), "fast quick car auto"),
        (lambda: T.sub_queries(F.lit("short one")), ["short one"]),
        (lambda: T.sub_queries(F.lit("What is this thing? And what is that thing?")), ["What is this thing?", "And what is that thing?"]),
        (lambda: T.grep_terms(F.lit("v1.2 x A-b. a-b foo_"), 2), ["v1.2", "A-b"]),
        (lambda: T.escaped_query(F.lit("a'(b)")), "a\\(b\\)"),
        (lambda: T.snippet(F.lit("  abc def  "), 4), "abc..."),
        (lambda: T.tight_blanks(F.lit("( a ) now !")), "(a) now!"),
    ],
)
def test_literals(spark, make, want):
    assert value(spark, make()) == want


def test_below_matches_only_smaller_numbers():
    for most in (1, 7, 10, 13, 100, 205):
        pattern = re.compile(f"^(?:{T.below(most)})$")
        assert [n for n in range(300) if pattern.match(str(n))] == list(range(min(most, 300)))


def test_term_weights_and_keys(spark):
    found = R.query_weights(spark, ["spark", "12.5", "ab"])
    assert set(found) == {"spark", "12.5", "ab", "spark12.5", "12.5ab"}
    assert found["12.5"] > found["spark"] > found["ab"]
    rows = spark.createDataFrame([(["spark", "12.5"],), (["12.5", "spark"],), ([],)], "t array<string>")
    scores = [r[0] for r in rows.select(R.token_similarity(F.col("t"), found)).collect()]
    assert scores[0] > scores[1] > scores[2] >= 0 and scores[0] < 1


def test_narrowing_keeps_neighbours(spark):
    text = "One is here. Two is there. Cats sleep. Four ends. Five ends. Six ends. Seven has 7 lives. Eight."
    got = value(spark, R.narrowed(F.lit(text), ["cat"]))
    assert got == "One is here. Two is there. Cats sleep. Four ends. Five ends. Six ends. Seven has 7 lives. Eight."
    assert value(spark, R.narrowed(F.lit(text), ["dog"])) is None
    assert value(spark, R.narrowed(F.lit("a | b | c\n1 | 2 | 3\n4 | 5 | 6"), ["dog"])).startswith("a | b")


def test_html_to_text(spark):
    html = "<html><script>x</script><p>One &amp; two<br>three</p><!-- no --><ul><li>four</li></ul></html>"
    assert value(spark, T.html_to_text(F.lit(html))) == "One & two\nthree\nfour"


def test_approximate_distinct_is_near(spark, sf_dir):
    from granary.plans.registry import QUERIES

    rows = QUERIES["approx_distinct"](spark, sf_dir).collect()
    assert rows and all(v is not None for r in rows for v in r)


def test_runs_at_the_edge_of_ascii(spark):
    """Runs of ASCII that end at, or go on in, other characters; letters and blanks of a mostly English text."""
    texts = {"abc 12x": ["abc", "12x"], "café x1": ["café", "x1"], "ab—cd": ["ab", "cd"], "a中文b1": ["a", "中文", "b1"], "éa b。C": ["éa", "b", "c"], "K9é٣": ["k9é٣"]}
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.runs(F.col("t")).alias("r"), T.is_english(F.col("t")).alias("e"))
    found = {r["i"]: (r["r"], r["e"]) for r in rows.collect()}
    want = [(w, sum(c == " " or c.isascii() and c.isalpha() for c in t) >= 0.7 * len(t)) for t, w in texts.items()]
    assert found == dict(enumerate(want))
