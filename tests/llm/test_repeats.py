"""Operators 1 and 8 against brute force over all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from granary.llm import suffix_dedup
from granary.llm.exchange import FirstOccurrence, bits_of, decide_first
from granary.llm.kernels import Block, pack
from granary.llm.substring_dedup import op1_substring_dedup, remove_repeats
from granary.llm.suffix_dedup import op8_suffix_dedup, remove_repeated_bytes

from .corpus import corpus, frame, repeated_windows, runs, words_of


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def test_op1_equals_brute_force(spark, rows, docs, table_of):
    got = {r["doc_id"]: r for r in op1_substring_dedup(spark, table_of(docs)).collect()}
    want = repeated_windows(rows, words_of, 20)
    assert len(got) == len(rows)
    for doc, text in rows:
        words = words_of(text)
        left = " ".join(w for w, g in zip(words, want[doc], strict=True) if not g)
        assert (got[doc]["n_words"], got[doc]["n_removed"], got[doc]["n_spans"]) == (len(words), sum(want[doc]), runs(want[doc]))
        assert got[doc]["kept_sha256"] == sha(left.encode())
    assert sum(map(sum, want.values())) > 100


@pytest.mark.parametrize("crowd", [1024, 0, 2])
def test_op8_equals_brute_force(spark, rows, docs, table_of, monkeypatch, crowd):
    """Also with every shared anchor treated as crowded."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    got = {r["doc_id"]: r for r in op8_suffix_dedup(spark, table_of(docs)).collect()}
    want = repeated_windows(rows, lambda t: (t or "").encode(), 100)
    assert len(got) == len(rows)
    for doc, text in rows:
        raw = (text or "").encode()
        left = bytes(b for b, g in zip(raw, want[doc], strict=True) if not g)
        assert (got[doc]["n_bytes"], got[doc]["n_removed"], got[doc]["n_spans"]) == (len(raw), sum(want[doc]), runs(want[doc]))
        assert got[doc]["kept_sha256"] == sha(left)
    assert sum(map(sum, want.values())) > 1000


def test_op8_whole_characters(spark):
    text = "日本語の文章です。" * 20
    rows = [(1, text), (2, "x" + text[5:60] + "yz")]
    got = {r["doc_id"]: bytes(r["kept"]) for r in remove_repeated_bytes(frame(spark, rows), whole_characters=True).collect()}
    for raw in got.values():
        raw.decode()
    assert got[2].decode() == "xyz"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_small_alphabets(spark, seed):
    """Dense repeats: few words, few bytes."""
    draw = random.Random(seed)
    rows = [(i, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 90)))) for i in range(30)]
    df = frame(spark, rows)
    words = {r["doc_id"]: sum(s["length"] for s in r["spans"]) for r in remove_repeats(df).collect()}
    assert words == {d: sum(g) for d, g in repeated_windows(rows, words_of, 20).items()}
    raw = {r["doc_id"]: sum(s["length"] for s in r["spans"]) for r in remove_repeated_bytes(df, 30, 8).collect()}
    assert raw == {d: sum(g) for d, g in repeated_windows(rows, lambda t: t.encode(), 30).items()}


def test_rows_that_repeat(spark, rows, docs, twice):
    """Each row once more: exactly one of two equal rows is the earlier one."""
    got = remove_repeats(twice).collect()
    assert len(got) == 2 * len(rows)
    n = {}
    for r in got:
        n.setdefault(r["doc_id"], []).append(sum(s["length"] for s in r["spans"]))
    sizes = {d: len(words_of(t)) for d, t in rows}
    for doc, removed in n.items():
        assert max(removed) == (sizes[doc] if sizes[doc] >= 20 else 0)
    assert remove_repeated_bytes(twice).count() == 2 * len(rows)


def test_no_rows(no_docs):
    assert remove_repeats(no_docs).collect() == []
    assert remove_repeated_bytes(no_docs).collect() == []


def test_suffix_sort_orders_suffixes():
    draw = random.Random(5)
    text = np.frombuffer(bytes(draw.choice(b"ab") for _ in range(400)), np.uint8)
    starts = np.arange(300)
    found = suffix_dedup.Suffixes(text, np.arange(400), 60).sorted(starts, np.zeros(300, np.int64))
    raw = text.tobytes()
    assert [raw[starts[i] : starts[i] + 60] for i in found] == sorted(raw[s : s + 60] for s in starts)


def test_equal_hashes_are_verified(monkeypatch):
    """With a hash that never differs, the bytes decide."""
    monkeypatch.setattr(suffix_dedup.Suffixes, "hashes", lambda self, starts, size: np.zeros(len(starts), np.uint64))
    text = np.frombuffer(b"abcdabceabcd", np.uint8)
    found = suffix_dedup.repeats_of(text, np.arange(12), np.array([0, 4, 8]), np.zeros(3, np.uint64), np.arange(3), 4)
    assert found.tolist() == [False, False, True]


def block_of(*texts: bytes) -> Block:
    return Block(np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))))


def constant(*args) -> np.ndarray:
    return np.zeros(len(args[1]), np.uint64)


def test_equal_stretches_of_a_batch_are_verified(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "span_hashes", constant)
    block = block_of(b"abcdefgh", b"abcdefgX", b"abcdefgh", b"Xbcdefgh")
    found = suffix_dedup.Stretches(block, 8, 8)
    assert len(set(found.whole.tolist())) == 1
    kinds = suffix_dedup.Distinct(found, block.data, 8)
    assert sorted(kinds.first.tolist()) == [0, 1, 3]
    assert kinds.group[0] == kinds.group[2]


def test_whole_stretches_of_several_batches_are_verified(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "span_hashes", constant)
    text = np.frombuffer(b"abcdXbcdabcdabcdXbcd", np.uint8)
    n = np.arange(5)
    same = np.zeros(5, np.int64)
    found = suffix_dedup.whole_repeats(text, n * 4, same + 4, same.astype(np.uint64), same, n)
    assert found.tolist() == [False, False, True, True, True]


def test_crowded_windows_are_verified(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "window_hashes", constant)
    block = block_of(b"abcdabceabcd")
    windows = suffix_dedup.Windows(block, np.array([0, 4, 8]), 4)
    assert windows.repeats(np.zeros(0, np.int64)).tolist() == [8]
    monkeypatch.setattr(suffix_dedup.Suffixes, "hashes", lambda self, starts, size: np.zeros(len(starts), np.uint64))
    keys, first = np.zeros(2, np.uint64), np.zeros(2, np.uint32)
    parts = [[keys, np.array([1, 2]), first, np.frombuffer(b"abcdabce", np.uint8)], [keys, np.array([3, 4]), first, np.frombuffer(b"abceabcf", np.uint8)]]
    found = suffix_dedup.sort_windows(parts, np.array([0, 1]), 4)
    assert [f.tolist() for f in found] == [[False, False], [True, False]]


def test_windows_with_one_hash_and_other_words():
    keys, checks = np.zeros(4, np.uint64), np.array([7, 8, 7, 9], np.uint64)
    first = FirstOccurrence(keys, checks)
    assert first.repeats(np.zeros(3, bool)).tolist() == [False, False, True, False]
    one = pack(keys[:2], checks[:2], np.array([1, 2]), np.zeros(2, np.uint32))
    two = pack(keys[:2], checks[2:], np.array([3, 4]), np.zeros(2, np.uint32))
    assert [bits_of([x], 1, 2).tolist() for x in decide_first(np.array([0, 1]), [one, two])] == [[False, False], [True, False]]


def test_words_whose_polynomial_hashes_are_equal():
    """Two Thue-Morse words, which no polynomial modulo 2**64 tells apart."""
    one = b"a"
    while len(one) < 2048:
        one += bytes(195 - c for c in one)
    other = bytes(195 - c for c in one)
    hashes = block_of(one, other).words()[3]
    assert hashes[0] != hashes[1]


def test_op1_and_long_words(spark):
    one = "a"
    while len(one) < 2048:
        one += one.translate(str.maketrans("ab", "ba"))
    words = [f"w{i}" for i in range(19)]
    rows = [(1, " ".join([one, *words])), (2, " ".join([one.translate(str.maketrans("ab", "ba")), *words]))]
    assert [sum(s["length"] for s in r["spans"]) for r in remove_repeats(frame(spark, rows)).collect()] == [0, 0]


def test_cut_characters_do_not_fuse(spark):
    """Bytes on both sides of a cut are no character, even if they look like one."""
    middle = " ".join(str(i) for i in range(100, 140))
    for left, right in (("中", "国"), ("é", "è"), ("日", "本")):
        rows = [(1, f"{left}{middle}{right}"), (2, f"园{middle}四"), (3, f"ê{middle}É")]
        got = {r["doc_id"]: bytes(r["kept"]).decode() for r in remove_repeated_bytes(frame(spark, rows), whole_characters=True).collect()}
        assert got[1] == rows[0][1]
        for doc, text in rows[1:]:
            assert set(got[doc]) <= {text[0], text[-1]}


def test_words_of_blocks():
    texts = [t or "" for _, t in corpus(3, 40)]
    raw = [t.encode() for t in texts]
    block = Block(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))))
    starts, ends, owner, _ = block.words()
    data = b"".join(raw)
    got = [[] for _ in texts]
    for s, e, o in zip(starts, ends, owner, strict=True):
        got[o].append(data[s:e].decode())
    assert got == [words_of(t) for t in texts]
