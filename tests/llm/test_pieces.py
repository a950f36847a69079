"""Ids and texts against the sentencepiece library."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from granary.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", "b", "e", "x", " ", " ", "\n", "▁", "  ", "é", "日", "本", "🙂", "ﬁ", "́", "\x00", "\t", "<0x41>", "</s>", "ing", "   ", "==", "1", "A", "ß", "п", " ", "﻿"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(PATH)


def test_random_texts(library, own):
    draw = random.Random(1)
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    for _ in range(300):
        texts = ["".join(draw.choices(ODD, k=draw.randint(0, 60))) for _ in range(5)]
        texts += ["".join(draw.choices(names, k=draw.randint(0, 12))) for _ in range(5)]
        texts += [draw.choice("abx=- 0▁") * draw.randint(0, 300)]
        assert [x.tolist() for x in own.encode(texts)] == library.encode(texts)


@pytest.mark.parametrize("kind", ["letters", "blanks", "one letter", "unknown", "mixed"])
def test_long_words(library, own, kind):
    draw = random.Random(2)
    text = {
        "letters": "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=30_000)),
        "blanks": "x" + " " * 9_000 + "y",
        "one letter": "a" * 20_001,
        "unknown": "🙂" * 6_000,
        "mixed": "".join(draw.choices(["ab", "thequick", "日本", "é", "===="], k=4_000)),
    }[kind]
    assert own.encode([text, text[:3000]]) [0].tolist() == library.encode(text)
    assert own.encode([text[:3000]])[0].tolist() == library.encode(text[:3000])


def test_rounds_equal_the_heap(own):
    draw = random.Random(3)
    for _ in range(200):
        text = draw.choice(["".join(draw.choices("▁abcdest", k=draw.randint(1, 80))), draw.choice("▁a=") * draw.randint(1, 90)])
        symbols = own.char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        a = own.merged(symbols.copy(), np.zeros(len(symbols), np.int64))
        b = own.merged_by_heap(symbols.tolist())
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_memo_is_bounded(library, own, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_WORDS", 5)
    for k in range(20):
        text = f"word{k} and{k} a"
        assert own.encode([text])[0].tolist() == library.encode(text)
        assert len(own.words.place) <= 8


def test_pair_table():
    draw = random.Random(4)
    pairs = {(draw.randrange(1 << 20), draw.randrange(1 << 20)): i for i in range(500)}
    table = pieces.PairTable(pairs)
    left, right = np.array([*pairs, (1 << 21, 5)]).T
    assert table.of(left, right).tolist() == [*pairs.values(), -1]


def digests(library, text):
    ids = library.encode(text or "")
    both = ",".join(map(str, ids)), library.decode(ids)
    return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in both)


def test_query(spark, docs, rows, table_of, library):
    got = pieces.op13_pieces(spark, table_of(docs)).collect()
    want = [(doc, *digests(library, text)) for doc, text in rows]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_ids_and_texts_back(docs, twice, rows):
    ids = pieces.encode(twice, PATH)
    back = sorted(((r[0], r[1]) for r in pieces.decode(ids, PATH).collect()), key=str)
    assert back == sorted([(doc, (text or "").replace("▁", " ")) for doc, text in rows * 2], key=str)


def test_empty_table(no_docs):
    assert pieces.digests(no_docs, PATH).collect() == []
