"""Operators 3 to 7 and 9 against plain Python, exact round trips and held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import binary_ids, exchange, language_model, licences, mixing, ngram_trie, packing, quality, tokens
from granary.llm.binary_ids import op6_binary_ids
from granary.llm.language_model import op7_language_model
from granary.llm.licences import LicenceModel, by_document, op9_licence_scan, scan
from granary.llm.mixing import mix, op3_mixing, sainte_lague
from granary.llm.packing import op4_packing, pack, pack_lengths
from granary.llm.quality import judge, op5_quality_rules

from .corpus import base_measures, corpus, first_of, frame, words_of

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "", " ", "  a", "a  b", "a\tb c\n d", " x y", "x  y", "a\x1c b", "don't can't we'll", "<|endoftext|> a", "a <|x b", "1234567 8",
    "日本 語。 テキスト", "🙂 🙂🙂x", "é ́ a", "A.B,C; d—e", "﻿a b", "a​ b", "\r\n a \r\n", "ſ K Å", "lİ x", "a" * 3000,
    "Ça É'S l'Été ÀB×÷ ß ÿ're", "x'S y's ''ve 12a3 b'llm", "Été.\nNon x\ny\n\nz", "ª º ¹² µm ÿ́",
]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# ── 3: mixing ────────────────────────────────────────────────────────────────


def targets(sizes: dict) -> dict:
    """Water filling by hand: the share by weight, none above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return out


def test_op3_targets_and_takes(spark, rows, docs, table_of):
    folder = table_of(docs)
    got = op3_mixing(spark, folder).collect()
    assert len(got) == len(rows)
    size = {d: len(words_of(t)) for d, t in rows}
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = op3_mixing(spark, folder).repartition(3).collect()
    assert {r["doc_id"]: r["taken"] for r in again} == {r["doc_id"]: r["taken"] for r in got}


def test_op3_many_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 10)
    draw = random.Random(1)
    rows = [(i, " ".join("w" * draw.choice([0, 3, 40, 200, 900]))) for i in range(90)]
    got = mix(frame(spark, rows)).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())


def test_sainte_lague_by_hand():
    assert sainte_lague(np.array([53.0, 24, 23]), 7, np.array([99, 99, 99])).tolist() == [3, 2, 2]
    draw = np.random.default_rng(2)
    for _ in range(30):
        w, seats = draw.integers(0, 50, 6).astype(float), int(draw.integers(0, 60))
        most = draw.integers(0, 20, 6)
        held = np.zeros(6, np.int64)
        for _ in range(min(seats, int(most[w > 0].sum()))):
            q = np.where((held < most) & (w > 0), w / (2 * held + 1), -1)
            held[int(q.argmax())] += 1
        assert sainte_lague(w, seats, most).tolist() == held.tolist()


def test_op3_no_rows(no_docs, twice, rows):
    assert mix(no_docs).collect() == []
    assert mix(twice).count() == 2 * len(rows)


# ── 4: packing ───────────────────────────────────────────────────────────────


def check_pieces(got, texts: dict):
    tokenizer = Tokenizer.from_file(BYTES)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1]
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            at += p["length"]
            assert p["ids_crc32"] == crc(ids[p["start"] : at])
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    return len(by_sequence)


def test_op4_pieces(spark, rows, docs, table_of):
    extra = [(5000 + i, t) for i, t in enumerate(HARD)]
    df = docs.unionByName(frame(spark, extra))
    got = op4_packing(spark, table_of(df)).collect()
    sequences = check_pieces(got, dict(rows) | dict(extra))
    assert sequences <= sum(p["length"] for p in got) // 2048 + 2


def test_best_fill_by_all_sums():
    draw = random.Random(4)
    for _ in range(40):
        items = [draw.randint(1, 40) for _ in range(12)]
        room = draw.randint(1, 120)
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums}
        found = packing.fill(dict(Counter(items)), room)
        assert sum(a * b for a, b in found) == max(s for s in sums if s <= room)
        assert all(Counter(items)[a] >= b for a, b in found)


def test_pack_lengths_wastes_little():
    lengths = np.random.default_rng(1).integers(1, 2048, 3000)
    sequence, offset = pack_lengths(lengths)
    assert sequence.max() + 1 <= math.ceil(lengths.sum() / 2048 * 1.01) + 1
    assert (offset + lengths <= 2048).all()


def test_op4_no_rows_and_repeated_rows(no_docs, twice, docs):
    assert pack(no_docs, BYTES).collect() == []
    once = pack(docs, BYTES).agg(F.sum("length")).first()[0]
    assert pack(twice, BYTES).agg(F.sum("length")).first()[0] == 2 * once


@pytest.mark.parametrize(("path", "blank"), [(BYTES, True), (WORDS, False)])
def test_ids_equal_the_tokenizers(rows, path, blank):
    texts = [t or "" for _, t in rows] + HARD + [f"{a} {b}" for a in HARD[:-1] for b in HARD[:-1]]
    tokenizer = Tokenizer.from_file(path)
    got = tokens.encode_texts(texts, path, blank)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:60]


# ── 6: binary ids ────────────────────────────────────────────────────────────


def test_op6_round_trip(spark, rows, docs, table_of):
    got = {r["doc_id"]: r for r in op6_binary_ids(spark, table_of(docs)).collect()}
    tokenizer, at = Tokenizer.from_file(WORDS), 0
    for doc, text in sorted(rows, key=first_of(rows)):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        r = got.pop(doc)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not got


def test_codes_round_trip():
    draw = np.random.default_rng(9)
    for top in (1, 200, 256, 65535, 65536, 1 << 24, 1 << 32):
        for n in (0, 1, 2, 3, 4, 5, 1001):
            ranks = draw.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
            control, data = binary_ids.encode_ranks(ranks)
            assert binary_ids.decode_ranks(control, data, n).tolist() == ranks.tolist()
    with pytest.raises(ValueError):
        binary_ids.read_block(b"no block of ids" * 9)


def test_op6_small_blocks_no_rows_repeated_rows(no_docs, twice, docs):
    blocks, table = binary_ids.write_ids(docs, WORDS, block_ids=50)
    large, _ = binary_ids.write_ids(docs, WORDS)
    assert blocks.count() > large.count()
    rows = lambda b: sorted(map(tuple, binary_ids.read_ids(b, table).collect()), key=str)
    assert rows(blocks) == rows(large)
    none, table = binary_ids.write_ids(no_docs, WORDS)
    assert binary_ids.read_ids(none, table).collect() == []
    assert binary_ids.read_ids(*binary_ids.write_ids(twice, WORDS)).count() == twice.count()


# ── 5: quality ───────────────────────────────────────────────────────────────


def test_op5_base_measures(spark, rows, docs, table_of):
    got = {r["doc_id"]: r.asDict() for r in op5_quality_rules(spark, table_of(docs)).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        want = base_measures(text)
        assert {k: got[doc][k] for k in want} == want, doc
        assert not (want["base_failed"] and got[doc]["kept"])


def test_op5_line_rules(spark):
    good = ["The river ran past the old mill.", "She said: “Come in!”", "Was it late? Nobody knew it then", "他走了。"]
    bad = ["Home | News | Contact | About", "SUBSCRIBE TO OUR LETTER TODAY!!!", "click here to read more.", "no punctuation at all here",
           "### *** $$$ &&& words here.", "We use cookies. See our cookie policy."]
    df = spark.createDataFrame([(x,) for x in good + bad], "line string")
    got = [r[0] for r in df.select(quality.line_passes(F.col("line"))).collect()]
    assert got == [True] * len(good) + [False] * len(bad)
    unique = [" ".join(f"word{i}{j}" for j in range(12)) + "." for i in range(5)]
    rows = [(1, "\n".join(unique + bad[:2])), (2, "\n".join(unique[:1] + [b + f" {i}" for i in range(9) for b in bad[:4]])), (3, "\n".join(unique))]
    got = {r["doc_id"]: r for r in judge(frame(spark, rows)).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3)] == [True, False, True]
    assert got[1]["clean_text"] == "\n".join(unique) and got[3]["kept_share"] == 1.0


def test_op5_no_rows_and_columns(no_docs, twice, docs):
    assert judge(no_docs).collect() == []
    out = judge(twice)
    assert out.count() == twice.count()
    assert len(out.columns) == len(set(out.columns)) and "batch" in out.columns


# ── 7: language model ────────────────────────────────────────────────────────


def test_op7_base_scores(spark, rows, docs, table_of):
    got = {r["doc_id"]: r for r in op7_language_model(spark, table_of(docs)).collect()}
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    text = {d: [*words_of(t, lower=True), None] for d, t in rows}
    counts = Counter(w for d in text for w in text[d] if not held[d])
    n, v = sum(counts.values()), len(counts)
    assert any(held.values())
    for doc, words in text.items():
        r = got.pop(doc)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[doc], len(words), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        assert abs(r["base_score"] - base) < 1e-6 * max(1, -base)
        assert r["score"] <= 0
    assert not got


def test_op7_beats_the_base_on_held_out_texts(spark):
    draw = random.Random(3)
    after = {f"w{i}": [f"w{draw.randrange(60)}" for _ in range(4)] for i in range(60)}

    def chain() -> str:
        out = ["w0"]
        for _ in range(150):
            out.append(draw.choice(after[out[-1]]))
        return " ".join(out)

    got = language_model.scores(frame(spark, [(i, chain()) for i in range(120)])).where("held_out").collect()
    assert sum(r["score"] for r in got) / sum(r["base_score"] for r in got) < 0.6


def plain_trigram_scores(rows) -> dict:
    """Interpolated absolute discounting from dictionaries."""
    texts = [(d, [None, None, *words_of(t, lower=True), ""]) for d, t in rows]
    held = {d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows}
    one, two, three = Counter(), Counter(), Counter()
    for d, t in texts:
        if not held[d]:
            one.update(t[2:])
            two.update(zip(t[1:], t[2:], strict=False))
            three.update(zip(t, t[1:], t[2:], strict=False))
    n, v = sum(one.values()), len(one)

    def context(counts) -> tuple[Counter, Counter, float]:
        total, fan = Counter(), Counter()
        for k, c in counts.items():
            total[k[:-1]] += c
            fan[k[:-1]] += 1
        once, twice = (sum(c == x for c in counts.values()) for x in (1, 2))
        return total, fan, min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)

    (n2, f2, d2), (n3, f3, d3) = context(two), context(three)

    def chance(a, b, c) -> float:
        p = (one[c] + 0.5) / (n + 0.5 * (v + 1))
        if n2[b,]:
            p = max(two[b, c] - d2, 0) / n2[b,] + d2 * f2[b,] / n2[b,] * p
        if n3[a, b]:
            p = max(three[a, b, c] - d3, 0) / n3[a, b] + d3 * f3[a, b] / n3[a, b] * p
        return p

    return {d: sum(math.log10(chance(*x)) for x in zip(t, t[1:], t[2:], strict=False)) for d, t in texts}


@pytest.mark.parametrize("shard_tokens", [None, 3000, 40])
def test_op7_equals_a_plain_model(spark, rows, monkeypatch, shard_tokens):
    """Whatever the number of shards, also where the start of a text and common words are split."""
    if shard_tokens:
        monkeypatch.setattr(language_model, "SHARD_TOKENS", shard_tokens)
    want = plain_trigram_scores(rows)
    got = {r["doc_id"]: r for r in language_model.scores(frame(spark, rows)).collect()}
    assert set(got) == set(want)
    for d, r in got.items():
        assert abs(r["score"] - want[d]) <= 1e-3 * max(1.0, r["n_tokens"]), d


def test_trie_probabilities_sum_to_one():
    draw = np.random.default_rng(6)
    u, v, w = (draw.integers(0, 12, 3000) ** 2 // 12 for _ in range(3))
    counts = np.bincount(w, minlength=12)
    base = np.log10((counts + 0.5) / (counts.sum() + 0.5 * 12))
    model = ngram_trie.Trie.trained(u, v, w, base)
    every = np.arange(12)
    for a, b in [(0, 0), (1, 3), (11, 0), (7, 7), (99, 1), (0, 99)]:
        p = 10 ** model.score(np.full(12, a), np.full(12, b), every, base)
        assert abs(p.sum() - 1) < 0.01


def test_elias_fano_round_trip(tmp_path):
    draw = np.random.default_rng(8)
    for n, top in [(0, 1), (1, 1), (1, 1 << 40), (5, 3), (1000, 1 << 45), (1000, 900)]:
        values = np.sort(draw.integers(0, top, n))
        ef = ngram_trie.EliasFano.of(values)
        assert ef.at(np.arange(n)).tolist() == values.tolist()
        wanted = draw.integers(0, top + 2, 50)
        got = ef.successor(np.zeros(50, np.int64), np.full(50, n), wanted)
        assert got.tolist() == np.searchsorted(values, wanted).tolist()


def test_op7_no_rows_and_repeated_rows(no_docs, twice):
    assert language_model.scores(no_docs).collect() == []
    assert language_model.scores(twice).count() == twice.count()


def test_op7_texts_lie_on_disk_smaller_than_by_the_fastest_level(spark):
    rows = list(enumerate(t or "" for _, t in corpus(3, 400)))
    content = exchange.text_batches(frame(spark, rows).coalesce(1)).first()["content"]
    ids, block = exchange.opened(content)
    assert ids.tolist() == [d for d, _ in rows]
    assert bytes(block.data) == "".join(t for _, t in rows).encode()
    assert len(content) < 0.97 * len(pa.Codec("zstd", 1).compress(bytes(block.data), asbytes=True))


# ── 9: licences ──────────────────────────────────────────────────────────────


@pytest.fixture(scope="module")
def model(docs):
    return LicenceModel.fit(docs)


def test_op9_finds_planted_notices(spark, model):
    """Altered copies that the training set does not hold, and plain lines with cue words."""
    draw = random.Random(11)
    rows, want = [], {}
    for i, (family, text) in enumerate(licences.NOTICES):
        words = text.split(" ")
        for k in range(4):
            own = [w for w in words if draw.random() > 0.1 * (k > 0) or len(words) < 8]
            rows.append((10 * i + k, f"A first line of prose.\n{' '.join(own).upper() if k == 3 else ' '.join(own)}\nAnother line."))
            want[10 * i + k] = family
    none = ["The driver had a licence to drive lorries across the county.", "He asked permission to leave the table early.", "Nothing here."]
    rows += [(9000 + i, t) for i, t in enumerate(none)]
    got = {r["doc_id"]: r["licence"] for r in by_document(frame(spark, rows), scan(frame(spark, rows), model)).collect()}
    assert sum(got[d] == f for d, f in want.items()) / len(want) >= 0.9
    assert [got[9000 + i] for i in range(3)] == ["unknown", "unknown", "none"]


def test_op9_is_calibrated(model, docs):
    rows = model.classify(licences.training_set(docs).where("held").select("words", "label"))
    numbers = F.create_map(*[x for i, f in enumerate(licences.FAMILIES) for x in (F.lit(f), F.lit(float(i)))])
    r = rows.agg(F.avg((numbers[F.col("predicted")] == F.col("label")).cast("int")).alias("right"), F.avg("probability").alias("said")).first()
    assert r["right"] > 0.9 and abs(r["right"] - r["said"]) < 0.1


WRAPPED_MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, subject to the following conditions:
"""
WRAPPED_BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:
"""


def test_op9_wrapped_and_altered_notices(spark, model):
    cases = {
        "Use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.": "bsd",
        "Free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.": "mit",
        WRAPPED_MIT: "mit",
        WRAPPED_BSD: "bsd",
        "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "gpl",
        "Prose.\n\nAll\nrights\nreserved.\n\nProse.": "proprietary",
        "All of the rights that he had reserved were lost.": "none",
        "The notice said that permission to use the software had been withdrawn by its authors.": "unknown",
    }
    rows = list(enumerate(cases)) + [(None, "Licensed under the Apache License, Version 2.0.")]
    got = {r["doc_id"]: r["licence"] for r in by_document(frame(spark, rows), scan(frame(spark, rows), model)).collect()}
    assert got == {None: "apache", **dict(enumerate(cases.values()))}


def test_op9_looks_at_every_paragraph_that_a_notice_confirms(spark, docs):
    """Similarity to all notices by plain Python: none that reaches the threshold is left out."""
    draw = random.Random(4)
    texts = [t or "" for _, t in corpus(8, 60)]
    for _, notice in licences.NOTICES:
        words = notice.split(" ")
        for _ in range(30):
            low = draw.randrange(len(words))
            texts.append(" ".join(w for w in words[low:] + words[: low // 2] if draw.random() > 0.15))

    def pairs(text: str) -> set:
        words = [w for w in re.split(r"[^a-z0-9]+", text.lower()) if w]
        return set(zip(words, words[1:], strict=False))

    lines = {line for t in texts for line in t.split("\n")}
    wanted = [pairs(n) for _, n in licences.NOTICES]
    confirmed = {x for x in lines if max(len(w & pairs(x)) / len(w) for w in wanted) >= licences.MIN_SIMILARITY}
    found = {r["paragraph"] for r in licences.paragraphs(frame(spark, list(enumerate(texts)))).collect()}
    assert len(confirmed) > 100 and confirmed <= found


def test_op9_makes_no_value_twice(spark):
    """Inside a lambda function Spark computes an expression anew wherever it is written."""
    assert str(licences.worth_a_score(F.lower("t"))).lower().count("lower(t") == 1
    assert str(licences.softened(F.col("raw"), 1.0)).count("array_max") == 1
    rows = spark.createDataFrame([("a b a b",), ("a",), ("",)], "t string").select(licences.grams(licences.word_list(F.col("t"))))
    assert [r[0] for r in rows.collect()] == [["a", "b", "a", "b", "a b", "b a", "a b"], ["a"], []]


def test_op9_edge_cases(spark, rows, docs, no_docs, twice, model, table_of):
    assert op9_licence_scan(spark, table_of(docs)).count() == len(rows)
    assert by_document(no_docs, scan(no_docs)).collect() == []
    assert by_document(twice, scan(twice, model)).count() == twice.count()


# ── what the mix and the packing give ────────────────────────────────────────


def test_mix_names_its_blocks(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(700))) for i in range(9)]
    got = mix(frame(spark, rows)).collect()
    for r in got:
        assert r["taken"] == r["passes"] * r["size"] + sum(s["length"] for s in r["spans"])
        ends = [(s["start"], s["start"] + s["length"]) for s in r["spans"]]
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False)) and all(0 <= a < b <= r["size"] for a, b in ends)
    assert any(s["start"] + s["length"] == r["size"] for r in got for s in r["spans"])


def test_pack_returns_the_ids(spark):
    texts = {i: " ".join(f"word{i * k}" for k in range(n)) for i, n in enumerate([0, 3, 50, 900, 3000])}
    tokenizer, found = Tokenizer.from_file(BYTES), defaultdict(list)
    for r in pack(frame(spark, list(texts.items())), BYTES).orderBy("start").collect():
        assert len(r["ids"]) == r["length"] and crc(r["ids"]) == r["ids_crc32"]
        found[r["doc_id"]] += r["ids"]
    assert found == {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}


def test_rests_that_never_fit_do_not_pile_up():
    """100,000 rests of which no two fit together: few wait, and each is looked at a bounded number of times."""
    task = packing.Task(0, packing.CAPACITY, False, packing.GROUP)
    most, placed, enough = 0, 0, packing.GROUP
    for at in range(0, 100_000, 500):
        task.cut(list(range(at, at + 500)), [np.zeros(1100, np.uint32)] * 500)
        if len(task.rests) >= enough:
            placed += task.place(False).num_rows
            enough = packing.GROUP + len(task.rests)
        most = max(most, len(task.rests))
    placed += task.place(True).num_rows
    assert placed == 100_000 and most <= 3 * packing.GROUP


def test_mix_parts_rows_without_an_id(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 50)
    rows = [(None if i % 2 else i, f"a b c {i if i % 3 else 0}", "s") for i in range(1000)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert found.count() == 1000 and abs(found.agg({"taken": "sum"}).first()[0] - 1.5 * 4000) <= 1
