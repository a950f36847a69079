"""Phrase mining against dictionaries of all word sequences."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from granary.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, score string"
CUT, WORD = re.compile(r"[.,;:!?\x0A-\x0D]"), re.compile(r"[^\x20\x09]+")


def plain(rows, least, longest=5, top=2000):
    count, total = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in CUT.split(text):
            w = WORD.findall(piece)
            total[lang] += len(w)
            for m in range(1, longest + 1):
                count.update((lang, tuple(w[i : i + m])) for i in range(len(w) - m + 1))
    candidates = {k: a for k, a in count.items() if a >= least and len(k[1]) > 1}
    gone = set()
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                if a >= count[lang, w[i : i + size]]:
                    gone.add((lang, w[i : i + size]))
    found = {}
    for (lang, w), a in candidates.items():
        if (lang, w) in gone:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = count[lang, w[:k]], count[lang, w[k:]]
            cuts.append((1000 * a * total[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    out = []
    for lang, own in found.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed, n=120, words=40):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["É", "日本", "🙂", "A", "Zed", "a b", "the"]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    fixed = [" ".join(draw.choices(vocabulary, k=k)) for k in (2, 3, 4, 5, 6, 9)]
    rows = [(0, None, "en"), (1, "", None), (2, " \t.\n", "en"), (None, "the the the the the the the", "und"), (3, "x" * 5000, "de")]
    for i in range(n):
        parts = []
        for _ in range(draw.randint(1, 25)):
            parts.append(draw.choice(fixed) if draw.random() < 0.3 else " ".join(draw.choices(vocabulary, weight, k=draw.randint(1, 6))))
        text = "".join(p + draw.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\u000b", "; "]) for p in parts)
        rows.append((i + 9, text, draw.choice(["en", "en", "en", "en", None, "de", "und"])))
    return rows + rows[20:30]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(4)


def got(df, top=2000):
    return sorted(tuple(r) for r in phrases.ranked(df, top).collect())


@pytest.mark.parametrize("least,shard,span", [(5, 1 << 24, 1 << 20), (5, 1500, 40), (12, 4000, 15), (1, 3000, 200)])
def test_equals_plain_counts(spark, least, shard, span):
    rows = corpus(1)
    assert got(phrases.mine(frame(spark, rows), least=least, shard_bytes=shard, range_nodes=span)) == plain(rows, least)


def test_ranges_split_a_hot_word(spark, monkeypatch):
    """With a sample of every node, borders of any depth fall inside one word's branch."""
    monkeypatch.setattr(phrases, "SAMPLE_EVERY", 2)
    rows = corpus(2, words=4)
    tries_of = frame(spark, rows)
    found = phrases.mine(tries_of, least=3, shard_bytes=1200, range_nodes=10)
    assert got(found) == plain(rows, 3)


def test_cut_puts_each_path_on_its_side():
    """Every border, against the order of paths."""
    shard = phrases.Shard([b"a b c a b d b a b", b"b b a c"], [b"en", b"de"])
    words, levels = shard.trie(phrases.np.full(1 << phrases.FILTER_BITS - 3, 255, phrases.np.uint8), 3)
    names = words.to_pylist()
    for level in levels:
        level.keys = level.parent * len(names) + level.word
    paths = [[tuple(phrases.path(names, levels, j, i)) for i in range(len(x.word))] for j, x in enumerate(levels)]
    assert all(p == sorted(p) for p in paths)
    borders = [p for own in paths for p in own] + [(b"en", b"aa"), (b"en", b"a", b"bb", b"c"), (b"dz",), (b"zz", b"a"), (b"en", b"d", b"x")]
    for border in borders:
        cuts, above = phrases.cut_at(names, levels, border)
        assert cuts == [sum(p < border for p in own) for own in paths]
        assert above == [any(p == border[: len(p)] and len(p) < len(border) for p in own) for own in paths]


def test_only_first_ones(spark):
    rows = corpus(3)
    assert got(phrases.mine(frame(spark, rows), least=4), 7) == plain(rows, 4, top=7)


def test_long_text_is_cut_between_pieces(spark):
    text = ("One two three, four FIVE! " * 4000) + ("no end " * 3000)
    rows = [(1, text, "en"), (2, "one two three", "en")]
    assert got(phrases.mine(frame(spark, rows), shard_bytes=2000)) == plain(rows, 100)


def test_numbers_past_64_bits(spark):
    """1000 * a * n of large counts is exact."""
    big = 3_000_000_019
    rows = [("en", "p q", 2 * big + 1, 5 * big + 3, [4 * big + 9]), ("en", "p", 4 * big + 9, 5 * big + 3, []), ("en", "q", 3 * big, 5 * big + 3, [])]
    found = spark.createDataFrame(rows, "lang string, phrase string, a long, n long, firsts array<long>")
    score = 1000 * (2 * big + 1) * (5 * big + 3) // ((4 * big + 9) * 3 * big)
    assert [r["score"] for r in phrases.scored(found).collect()] == [score]


def test_empty_table(spark):
    assert got(phrases.mine(frame(spark, corpus(4)).where("false"))) == []
