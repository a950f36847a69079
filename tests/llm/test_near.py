"""Operator 10 against all pairs, and operator 2's estimates against true shares."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import fingerprint, minhash
from granary.llm.fingerprint import op2_document_fingerprints
from granary.llm.minhash import near_duplicates, op10_near_duplicates

from .corpus import components, first_of, frame, shingles


def checked(got, rows, width=3):
    want = components(rows, width)
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t in rows if d == r["doc_id"])
        assert r["n_shingles"] == len(shingles(text, width))
        assert r["component_id"] == want.get(r["doc_id"])
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
    return want


def test_op10_equals_all_pairs(spark, rows, docs, table_of):
    want = checked(op10_near_duplicates(spark, table_of(docs)).collect(), rows)
    assert sum(k != v for k, v in want.items()) > 5


def mutated(seed: int, n: int, length: int, most: int) -> list[tuple[int, str]]:
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(length)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(draw.randint(0, most)):
            own[draw.randrange(length)] = word()
        rows.append((i, " ".join(own)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "n", "length", "most"), [(1, 150, 120, 3), (2, 200, 60, 3), (3, 120, 30, 1), (4, 90, 300, 14)])
def test_op10_on_one_large_group(spark, seed, n, length, most):
    """Groups above SMALL, with chains and with members just below the limit."""
    rows = mutated(seed, n, length, most)
    checked(near_duplicates(frame(spark, rows)).collect(), rows)


def test_op10_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 40)
    monkeypatch.setattr(minhash, "BLOCK_SETS", 16)
    rows = mutated(8, 160, 80, 4) + [(1000 + i, t) for i, t in mutated(9, 60, 50, 2)]
    checked(near_duplicates(frame(spark, rows)).collect(), rows)


def test_op10_short_texts(spark):
    rows = [(i, t) for i, t in enumerate(["a b", "A B", "a b c", "a b c d", "a", None, "", " \n", "a", "x y z x y z", "X Y Z x y z x"])]
    checked(near_duplicates(frame(spark, rows)).collect(), rows)


def test_op10_rows_that_share_an_id(spark, rows):
    """Its texts link one document; each row is answered."""
    same = [(1, "p q r s t u v"), (1, "k l m n o"), (2, "k l m n o"), (3, "p q r s t u v")]
    got = near_duplicates(frame(spark, same)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == [(1, 1), (1, 1), (2, 1), (3, 1)]
    both = near_duplicates(frame(spark, rows + rows)).collect()
    assert len(both) == 2 * len(rows)


def test_op10_no_rows(no_docs):
    assert near_duplicates(no_docs).collect() == []


def test_registers_estimate_jaccard():
    draw = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.85, 0.95):
        n = 4000
        both = draw.integers(0, 1 << 63, int(n * share), dtype=np.uint64) * np.uint64(2)
        one, two = (draw.integers(0, 1 << 63, (n - len(both)) // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in "ab")
        sets = [np.sort(minhash.mix(np.concatenate((both, x)))) for x in (one, two)]
        regs = [minhash.registers(np.zeros(len(s), np.int64), s, 1)[0] for s in sets]
        guess, _ = minhash.estimates(regs[0], regs[1], np.array(len(sets[0])), np.array(len(sets[1])))
        assert abs(guess - len(both) / (len(both) + len(one) + len(two))) < 4 * np.sqrt(share * (1 - share) / 128)


# ── operator 2 ───────────────────────────────────────────────────────────────


def expected_edits(rows):
    order = sorted(rows, key=first_of(rows))
    out = {}
    for k, (doc, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 4
        out[doc] = (text, text[: len(text) - cut] + following[:cut], following)
    return out


def exact(a: str, b: str) -> float:
    x, y = sensitive(a), sensitive(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def sensitive(text: str) -> frozenset:
    from .corpus import words_of

    w = words_of(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_op2_edits_and_estimates(spark, rows, docs, table_of):
    got = {r["doc_id"]: r for r in op2_document_fingerprints(spark, table_of(docs)).collect()}
    want = expected_edits(rows)
    assert got.keys() == want.keys()
    prints: dict[str, set] = {}
    for doc, (text, changed, following) in want.items():
        r = got[doc]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        prints.setdefault(text, set()).add(r["fingerprint"])
        prints.setdefault(changed, set()).add(r["edited_fingerprint"])
        for name, other in (("near_edited", changed), ("near_next", following)):
            true = exact(text, other)
            room = 1e-9 if len(sensitive(text) | sensitive(other)) <= fingerprint.K else 0.2
            assert abs(r[name] - true) <= room, (doc, name)
        n = len(sensitive(text))
        assert abs(r["distinct_shingles"] - n) <= (0 if n < fingerprint.K else 0.4 * n)
    assert all(len(p) == 1 for p in prints.values())
    assert len({min(p) for p in prints.values()}) >= len({sensitive(t) for t in prints}) 


def test_op2_sketches_merge(spark, docs):
    """Merged over groups, sketches equal the sketch of all their shingles together."""
    parts = docs.select("source", fingerprint.sketch(F.coalesce("text", F.lit(""))).alias("s"))
    merged = {r["source"]: r["s"] for r in fingerprint.merge_groups(parts, ["source"], "s", salts=3).collect()}
    plain = parts.groupBy("source").agg(fingerprint.merge_all("s").alias("s"))
    assert merged == {r["source"]: r["s"] for r in plain.collect() if r["s"]}


def test_op2_containment(spark):
    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(" ".join(words[:200]), " ".join(words), "")], "a string, b string, c string")
    s = {c: fingerprint.sketch(F.col(c)) for c in "abc"}
    r = df.select(fingerprint.containment(s["a"], s["b"]), fingerprint.containment(s["b"], s["a"]), fingerprint.resemblance(s["c"], s["c"]),
                  fingerprint.resemblance(s["a"], s["c"])).first()
    assert r[0] > 0.75 and 0.3 < r[1] < 0.7 and r[2] == 1.0 and r[3] == 0.0


def test_op2_no_rows_and_repeated_rows(spark, no_docs, twice, table_of, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op2_document_fingerprints(spark, f"{tmp_path}/none").collect() == []
    assert op2_document_fingerprints(spark, table_of(twice)).count() == twice.count()
