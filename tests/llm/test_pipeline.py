"""The pipeline, stage by stage, against plain Python versions of its stages."""

from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from granary.llm import mixing, quality

from .corpus import components, repeated_windows, words_of
from .test_rows import check_pieces, targets


@pytest.fixture(scope="module")
def prose(spark):
    """Documents that mostly pass the quality rules, with copies, near copies and shared passages."""
    draw = random.Random(12)
    vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(2, 8))) for _ in range(2000)]
    sentence = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k)).capitalize() + "."
    shared = [" ".join(sentence(12) for _ in range(6)) for _ in range(3)]
    rows: list[tuple] = []
    for i in range(70):
        kind = i % 7
        if kind == 0 and rows:
            text = rows[draw.randrange(len(rows))][1]
        elif kind == 1 and rows:
            words = (rows[draw.randrange(len(rows))][1] or "").split(" ")
            words[len(words) // 2] = "changed"
            text = " ".join(words)
        elif kind == 2:
            text = "\n".join([sentence(15), draw.choice(shared), "Home | About | News", sentence(20)])
        elif kind == 3:
            text = draw.choice([None, "", "too short.", "Menu | x\n" * 30, "日本語" * 40 + sentence(30)])
        else:
            text = "\n".join(sentence(draw.randint(8, 30)) for _ in range(draw.randint(2, 12)))
        rows.append((i, text, "en", f"src{i % 4}" if i % 9 else None, len(text or "")))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="module")
def after(spark, prose):
    found = [prose.select("*").cache()]
    for _, stage in cp.STAGES:
        found.append(stage(spark, found[-1], "").cache())
    return found


def texts(df) -> dict:
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_return_documents(after):
    for df in after[:-1]:
        assert sorted(df.columns) == sorted(cp.COLUMNS)
        assert all(r["n_chars"] == len(r["text"] or "") for r in df.collect())


def test_quality_stage(after):
    judged = {r["doc_id"]: r for r in quality.judge(after[0]).collect()}
    got = texts(after[1])
    assert got == {d: r["clean_text"] for d, r in judged.items() if r["kept"]}
    assert 40 < len(got) < len(judged)


def test_near_dedup_stage(after):
    before, got = texts(after[1]), texts(after[2])
    root = components(list(before.items()), 5)
    assert got == {d: t for d, t in before.items() if root[d] == d}
    assert len(got) < len(before)


def test_suffix_dedup_stage(after):
    before, got = texts(after[2]), texts(after[3])
    gone = repeated_windows(list(before.items()), lambda t: t.encode(), 100)
    for doc, text in before.items():
        left, at = "", 0
        for c in text:  # a character that loses a byte goes whole
            size = len(c.encode())
            left += "" if any(gone[doc][at : at + size]) else c
            at += size
        assert got.get(doc, "") == left
    assert any(map(any, gone.values()))


def picked(spark, rows, seed=mixing.SEED) -> dict:
    """Passes and picked blocks of each (doc_id, source, n_words) row of sources of one shard, by plain selection."""
    sizes = Counter()
    for _, source, n in rows:
        sizes[source] += n
    blocks = [(doc, source, at, min(mixing.BLOCK, n - at * mixing.BLOCK)) for doc, source, n in rows for at in range(-(-n // mixing.BLOCK))]
    ranks = spark.createDataFrame([(d, a) for d, _, a, _ in blocks], "d long, a long").select(F.xxhash64(F.lit(seed), "d", "a")).collect()
    ordered = sorted(zip((r[0] for r in ranks), blocks, strict=True), key=lambda x: (x[0], x[1][0], x[1][2]))
    out = {}
    for source, target in targets(sizes).items():
        passes, rest = divmod(round(target), sizes[source]) if sizes[source] else (0, 0)
        own = {doc: (passes, []) for doc, s, n in rows if s == source}
        for _, (doc, s, at, n) in ordered:
            if s == source and rest > 0:
                own[doc][1].append((at * mixing.BLOCK, min(n, rest)))
                rest -= min(n, rest)
        out.update({doc: (p, sorted(b)) for doc, (p, b) in own.items()})
    return out


def expected_copies(spark, rows) -> Counter:
    """``rows``: (doc_id, text, source)."""
    plan, out = picked(spark, [(d, s, len(words_of(t))) for d, t, s in rows]), Counter()
    for doc, text, _ in rows:
        passes, blocks = plan[doc]
        parts = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text)
        out[doc, text] += passes
        if blocks:
            out[doc, "".join(w for start, n in blocks for w in parts[start : start + n])] += 1
    return +out


def test_mix_stage(spark, after):
    """Whole passes and the picked blocks of each document, and nothing else."""
    rows = [(r["doc_id"], r["text"], r["source"]) for r in after[3].collect()]
    got = Counter((r["doc_id"], r["text"]) for r in after[4].collect())
    assert got == expected_copies(spark, rows)
    taken = Counter()
    for r in after[4].collect():
        taken[r["source"]] += len(words_of(r["text"]))
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words_of(text))
    assert all(abs(taken[s] - t) <= 1 for s, t in targets(sizes).items())


def test_mix_of_long_texts_and_clashing_names(spark):
    """Middles and ends of long texts are taken as often as their beginnings; other columns don't matter."""
    rows = [(i, "\n".join(f"w{i}x{k} and more" for k in range(1 + 900 * (i % 4))), f"s{i % 3}") for i in range(12)]
    full = [(d, t, "en", s, len(t), 7, 8, 9, "z") for d, t, s in rows]
    names = "doc_id long, text string, lang string, source string, n_chars long, size long, taken long, _row long, passes string"
    got = Counter((r["doc_id"], r["text"]) for r in cp.mix_stage(spark, spark.createDataFrame(full, names), "").collect())
    assert got == expected_copies(spark, rows)
    assert any(not rows[d][1].startswith(t) for d, t in got)


def test_pack_stage(after):
    """Ids of all copies of a document are packed; each sequence is gapless."""
    rows = after[5].collect()
    ids = Counter()
    for r in rows:
        ids[r["doc_id"]] += r["length"]
    assert ids.keys() == set(texts(after[4]))
    named = after[4].withColumn("n", F.monotonically_increasing_id())
    one_each = cp.pack_stage(named.sparkSession, named.select(F.col("n").alias("doc_id"), "text"), "").collect()
    assert sum(r["length"] for r in one_each) == sum(ids.values())
    check_pieces(one_each, {r["n"]: r["text"] for r in named.collect()})


def test_run_equals_the_stages(spark, prose, after, tmp_path):
    prose.write.parquet(f"{tmp_path}/documents.parquet")
    rows = lambda df: Counter(tuple(r)[:5] for r in df.collect())
    assert rows(cp.run(spark, str(tmp_path))) == rows(after[-1])


def test_no_documents(spark, prose, tmp_path):
    prose.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_null_and_repeated_ids(spark):
    """A row is neither lost for a null id nor multiplied by rows that share its id."""
    draw = random.Random(5)
    text = lambda n: "\n".join(" ".join(f"w{draw.randrange(10**6)}" for _ in range(10)) for _ in range(n))
    rows = [(i, text(9), "en", f"s{i % 2}") for i in range(12)]
    rows += [(None, text(9), "de", "s0"), (None, text(5), "fr", "s1"), (3, text(7), "it", "s2"), (3, text(20), "nl", None)]
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = cp.suffix_dedup_stage(spark, df, "").cache()
    assert Counter(tuple(r)[:4] for r in left.collect()) == Counter(rows)
    sizes, taken, copies = Counter(), Counter(), Counter()
    for _, t, _, source in rows:
        sizes[source] += len(words_of(t))
    for r in cp.mix_stage(spark, left, "").collect():
        n = len(words_of(r["text"]))
        taken[r["source"]] += n
        copies[r["lang"], r["doc_id"]] += n
    for source, target in targets(sizes).items():
        assert abs(taken[source] - target) <= 1
    per = Counter()
    for d, t, lang, _ in rows:
        per[lang, d] += len(words_of(t))
    assert all(n <= 2 * per[key] for key, n in copies.items())
    assert {("de", None), ("fr", None), ("it", 3), ("nl", 3)} & copies.keys()


def test_near_dedup_links_from_80_percent(spark):
    """One changed word in 50 to 62 leaves a five-word Jaccard of 0.80 to 0.85; in 40 it leaves less."""
    rows = []
    for i, n in enumerate([40, 45, 50, 54, 58, 62, 80]):
        words = [f"w{i}x{k}" for k in range(n)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[: n // 2], "changed", *words[n // 2 + 1 :]]))]
    df = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    root = components(rows, 5, 80)
    assert root != components(rows, 5)
    assert texts(cp.near_dedup_stage(spark, df, "")) == {d: t for d, t in rows if root[d] == d}


def test_mix_keeps_line_breaks(spark):
    rows = [(i, "\n".join(f" a{i} b\tc{k} d" for k in range(40)) + "\n", f"s{i % 3}") for i in range(9)]
    df = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in cp.mix_stage(spark, df, "").collect())
    assert got == expected_copies(spark, rows)
    assert any(t != rows[d][1] and "\n" in t for d, t in got)


def test_all_stages_take_clashing_names_and_long_texts(spark, prose, after):
    """Further columns change nothing; a text of a megabyte passes."""
    more = prose.withColumns({c: F.lit("x") for c in ("kept", "size", "taken", "batch", "bucket", "n_words", "spans", "row_id", "_row")})
    df = more
    for (_, stage), want in zip(cp.STAGES[:-1], after[1:-1], strict=True):
        df = stage(spark, df, "").cache()
        assert texts(df) == texts(want)
        df = df.withColumn("size", F.lit(1)).withColumn("kept", F.lit(False))
    draw = random.Random(3)
    long = "\n".join(" ".join(f"w{draw.randrange(10**6)}" for _ in range(12)) + "." for _ in range(12_000))
    rows = [(1, long, "en", "a", len(long)), (2, long + " end.", "en", "b", len(long)), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        df = stage(spark, df, "").cache()
    assert {r["doc_id"] for r in df.collect()} == {1}
