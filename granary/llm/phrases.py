"""Phrases that hold together, mined from counts of word sequences (operator 11).

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and pieces into words. Everything is per
language. A phrase of two to five words is a candidate from 100 occurrences on; its score is the lowest of
``floor(1000 a n / (l r))`` over its cuts into a first part (l occurrences) and a rest (r), with a occurrences of its own
and n words of the language.

1. A shard (some megabytes of text) counts its words and word pairs; the counts meet by hash, and what reaches the
   least count sets a bit in a filter of fixed size (``FILTER_BITS``). The filter may let a rare pair through, never
   stop a frequent one: results don't depend on it, only how much the next step has to carry.
2. A shard builds a trie of its phrases, language first, of no more than six levels, and writes it as sorted arrays:
   for each level the parents, the words (by place in the shard's sorted lexicon) and the counts.
3. Key ranges are drawn from samples of the tries' paths, as many as the number of nodes asks for; a path of any length
   may be a border, so a language or word that holds a third of all rows is split. Each shard's trie is cut at the
   borders; a range also gets the shard's counts of the border's own ancestors. A range's sorted runs are merged level
   by level, and branches below the least count are dropped as soon as their total is known.
4. A walk up the merged trie gives the counts of a candidate's first parts; its rests are found by their own rows
   (suffix links, a join by phrase). Words are compared as bytes throughout, counts are exact.

A text longer than a shard is cut between pieces, so memory is bounded by the longest piece.

Edge cases: a null or empty text has no words; a null language is ``und``, one with texts of that name; documents that
repeat count again; ``doc_id`` isn't used. A tie of scores goes to the smallest first part, a tie of ranks to the
phrase's bytes. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .exchange import slices
from .kernels import LOWER, SEED, U64, Block, mix, pack, unpack
from .staging import read_table, shuffle_width, staged

LONGEST, LEAST, TOP = 5, 100, 2000
NO_LANG = b"und"
SHARD_BYTES = 8 << 20
#: Bits of the filter of frequent words and pairs: 8 MB at any size of the corpus.
FILTER_BITS = 26
BUCKET_BYTES = 32 << 20
RANGE_NODES = 1 << 20
#: Groups in which a language's phrases are ranked first.
MOST_SALTS = 256
#: A path in so many nodes of a shard is a sample; so many samples for each range come to the driver.
SAMPLE_EVERY, SAMPLES_A_RANGE = 1 << 10, 40

#: What a byte is: 0 part of a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


@dataclass
class Level:
    """Nodes of one depth in the order of their paths; ``parent`` is a place in the level above."""

    parent: np.ndarray
    word: np.ndarray
    count: np.ndarray
    keys: np.ndarray | None = None


def string_hashes(words: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words):
        return np.zeros(0, U64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(mix((data.astype(U64) | place.astype(U64) << U64(8)) + SEED), out=total[1:])
    return mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(U64))


def sorted_lexicon(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct words in byte order, and each word's place among them."""
    coded = words.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


class Shard:
    """Words of some texts: their places in the lexicon, language, and whether the next word is in the same piece."""

    def __init__(self, texts: list[bytes], langs: list[bytes]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds = np.cumsum([0, *map(len, texts)]).astype(np.int64)
        letters, sizes, joined, owner = [], [], [], []
        for text, _, part in Block(data, bounds).parts():
            kind = KIND[part.data]
            full = kind == 0
            n = len(full)
            edge = np.zeros(n + 1, bool)
            edge[part.bounds] = True
            before, after = np.zeros(n, bool), np.zeros(n, bool)
            before[1:], after[:-1] = full[:-1], full[1:]
            starts = np.flatnonzero(full & (edge[:n] | ~before))
            ends = np.flatnonzero(full & (edge[1:] | ~after)) + 1
            own = np.searchsorted(part.bounds, starts, side="right") - 1
            breaks = np.cumsum(kind == 2)
            same = np.zeros(len(starts), bool)
            same[:-1] = (own[1:] == own[:-1]) & (breaks[starts[1:]] == breaks[starts[:-1]])
            letters.append(LOWER[part.data[full]])
            sizes.append(ends - starts)
            joined.append(same)
            owner.append(own + text)
        lang_names, lang_place = sorted_lexicon(pa.array(langs, pa.large_binary()))
        flat = np.concatenate(letters) if letters else np.zeros(0, np.uint8)
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes) if sizes else np.zeros(0, np.int64)))).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        self.words, self.ids = sorted_lexicon(words)
        self.langs = lang_names
        self.lang = lang_place[np.concatenate(owner)] if owner else np.zeros(0, np.int64)
        self.joined = np.concatenate(joined) if joined else np.zeros(0, bool)

    def grown(self, node: np.ndarray, at: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Parent, word and count of each distinct continuation of the nodes at places ``at``; and their numbers."""
        keys, inverse, counts = np.unique(node * len(self.words) + self.ids[at + step], return_inverse=True, return_counts=True)
        return keys // max(len(self.words), 1), keys % max(len(self.words), 1), counts, inverse

    def singles(self) -> tuple[Level, np.ndarray]:
        parent, word, count, node = self.grown(self.lang, np.arange(len(self.ids)), 0)
        return Level(parent, word, count), node

    def hashes(self, singles: Level) -> np.ndarray:
        """Of each (language, word)."""
        return mix(string_hashes(self.words)[singles.word] ^ mix(string_hashes(self.langs)[singles.parent] + U64(1)))

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Ascending hashes of the words and pairs, and their counts."""
        singles, node = self.singles()
        one = self.hashes(singles)
        at = np.flatnonzero(self.joined)
        parent, word, count, _ = self.grown(node[at], at, 1)
        two = mix(one[parent] * U64(3) + string_hashes(self.words)[word])
        both, counts = np.concatenate((one, two)), np.concatenate((singles.count, count))
        order = np.argsort(both)
        return both[order], counts[order]

    def trie(self, frequent: np.ndarray, longest: int) -> tuple[pa.Array, list[Level]]:
        """Lexicon and levels (languages, words, pairs, ...) of what the filter lets through."""
        singles, node = self.singles()
        one = self.hashes(singles)
        totals = np.bincount(self.lang, minlength=len(self.langs))
        at = np.flatnonzero(self.joined)
        at = at[hit(frequent, mix(one[node[at]] * U64(3) + string_hashes(self.words)[self.ids[at + 1]]))]
        linked = np.zeros(len(self.ids) + 1, bool)
        linked[at] = True
        kept = hit(frequent, one)
        place = np.cumsum(kept) - 1
        levels = [Level(singles.parent[kept], singles.word[kept], singles.count[kept])]
        at = at[kept[node[at]]]
        node = place[node[at]]
        for step in range(1, longest):
            parent, word, count, node = self.grown(node, at, step)
            levels.append(Level(parent, word, count))
            on = linked[at + step]
            at, node = at[on], node[on]
        # languages join the lexicon, which stays sorted
        lexicon, where = sorted_lexicon(pa.concat_arrays([self.langs, self.words]))
        names, words = where[: len(self.langs)], where[len(self.langs) :]
        for level in levels:
            level.word = words[level.word]
        return lexicon, [Level(np.zeros(len(totals), np.int64), names, totals), *levels]


def hit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> U64(64 - FILTER_BITS)
    return (bits[(at >> U64(3)).astype(np.int64)] >> (7 - (at & U64(7))).astype(np.uint8) & 1).astype(bool)


def cut_text(text: bytes, limit: int) -> Iterator[bytes]:
    """A long text in stretches of whole pieces."""
    at = 0
    while len(text) - at > limit:
        window = KIND[np.frombuffer(text, np.uint8, limit, at)] == 2
        if window.any():
            to = at + int(np.flatnonzero(window)[-1]) + 1
        else:
            after = np.flatnonzero(KIND[np.frombuffer(text, np.uint8, -1, at + limit)] == 2)
            to = at + limit + int(after[0]) + 1 if len(after) else len(text)
        yield text[at:to]
        at = to
    yield text[at:]


def shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[Shard]:
    """Of ``text, lang`` rows."""
    texts, langs, held = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            lang = lang.as_buffer().to_pybytes() if lang.is_valid else NO_LANG
            for part in cut_text(text.as_buffer().to_pybytes(), limit):
                if held and held + len(part) > limit:
                    yield Shard(texts, langs)
                    texts, langs, held = [], [], 0
                texts.append(part)
                langs.append(lang)
                held += len(part)
    if texts:
        yield Shard(texts, langs)


def frequent_filter(rows: DataFrame, least: int, shard_bytes: int) -> np.ndarray:
    """The filter's bytes: a bit for every word and pair of at least ``least`` occurrences."""
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = int(np.ceil(np.log2(max(size / BUCKET_BYTES, shuffle_width(rows.sparkSession), 2))))
    bits = min(bits, FILTER_BITS - 3)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_bytes):
            hashes, counts = shard.counts()
            parts = [(b, pack(hashes[s], counts[s])) for b, s in slices(hashes, bits)]
            yield pa.RecordBatch.from_pydict(
                {"bucket": [p[0] for p in parts], "payload": [p[1] for p in parts]},
                pa.schema([("bucket", pa.int64()), ("payload", pa.binary())]),
            )

    def total(table: pa.Table) -> pa.Table:
        parts = [unpack(p) for p in table["payload"].to_pylist()]
        hashes, counts = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        often = hashes[first][np.add.reduceat(counts[order], first) >= least]
        flags = np.zeros(1 << FILTER_BITS - bits, bool)
        flags[(often << U64(bits) >> U64(64 - FILTER_BITS + bits)).astype(np.int64)] = True
        return pa.table({"bucket": table["bucket"][:1], "bits": [np.packbits(flags).tobytes()]})

    counted = rows.select("text", "lang").mapInArrow(count, "bucket long, payload binary")
    out = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    each = len(out) >> bits
    for row in counted.groupBy("bucket").applyInArrow(total, "bucket long, bits binary").collect():
        out[row["bucket"] * each : (row["bucket"] + 1) * each] = np.frombuffer(row["bits"], np.uint8)
    return out


def packed_words(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.diff(offsets).astype(np.uint32), data[offsets[0] : offsets[-1]]


def opened_words(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes.astype(np.int64)))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )


def written(words: pa.Array, levels: list[Level], first: list[int], last: list[int], inherited: list[bool]) -> bytes:
    """The nodes ``first[j]:last[j]`` of each level with the words they need; ``inherited``: a level's first is a border's ancestor."""
    some = [level.word[a:b] for level, a, b in zip(levels, first, last, strict=True)]
    used, place = np.unique(np.concatenate(some), return_inverse=True)
    arrays = [np.array(inherited, np.uint8), *packed_words(words.take(pa.array(used)))]
    at = 0
    for j, (level, a, b) in enumerate(zip(levels, first, last, strict=True)):
        arrays += [(level.parent[a:b] - (first[j - 1] if j else 0)).astype(np.uint32), place[at : at + b - a].astype(np.uint32)]
        arrays.append(level.count[a:b].astype(np.int64))
        at += b - a
    return pack(*arrays)


def read_trie(raw: bytes) -> tuple[np.ndarray, pa.Array, list[Level]]:
    inherited, sizes, data, *rest = unpack(raw)
    levels = [Level(*(x.astype(np.int64) for x in rest[i : i + 3])) for i in range(0, len(rest), 3)]
    return inherited.astype(bool), opened_words(sizes, data), levels


def path(names: list[bytes], levels: list[Level], depth: int, node: int) -> list[bytes]:
    out = []
    for j in range(depth, -1, -1):
        out.append(names[levels[j].word[node]])
        node = levels[j].parent[node]
    return out[::-1]


def shard_tries(rows: DataFrame, frequent: np.ndarray, longest: int, shard_bytes: int) -> DataFrame:
    """Staged ``nodes, trie, samples`` (paths of some nodes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, shard_bytes):
            words, levels = shard.trie(frequent, longest)
            sizes = [len(level.word) for level in levels]
            names, ends, found = words.to_pylist(), np.cumsum(sizes), []
            for i in range(SAMPLE_EVERY // 2, int(ends[-1]), SAMPLE_EVERY):
                depth = int(np.searchsorted(ends, i, side="right"))
                found.append(path(names, levels, depth, i - int(ends[depth]) + sizes[depth]))
            raw = written(words, levels, [0] * len(levels), sizes, [False] * len(levels))
            yield pa.RecordBatch.from_pydict(
                {"nodes": [int(ends[-1])], "trie": [raw], "samples": [found]},
                pa.schema([("nodes", pa.int64()), ("trie", pa.binary()), ("samples", pa.list_(pa.list_(pa.binary())))]),
            )

    tries = rows.select("text", "lang").mapInArrow(run, "nodes long, trie binary, samples array<array<binary>>")
    return staged(tries, "phrase-tries")


def borders(tries: DataFrame, range_nodes: int) -> list[tuple[bytes, ...]]:
    """Ascending paths that part the ranges; their number grows with the tries."""
    nodes = tries.agg(F.sum("nodes").alias("n")).first()["n"] or 0
    ranges = max(shuffle_width(tries.sparkSession), -(-nodes // range_nodes))
    each = tries.select(F.explode("samples").alias("path"))
    share = max(1, nodes // SAMPLE_EVERY // (ranges * SAMPLES_A_RANGE))
    if share > 1:
        each = each.where(F.pmod(F.xxhash64("path"), F.lit(share)) == 0)
    paths = sorted(tuple(bytes(w) for w in r["path"]) for r in each.collect())
    return sorted({paths[i * len(paths) // ranges] for i in range(1, ranges)}) if paths else []


def cut_at(names: list[bytes], levels: list[Level], border: tuple[bytes, ...]) -> tuple[list[int], list[bool]]:
    """For each level, how many nodes have a path below ``border``, and whether the last of them is its ancestor."""
    cuts, above, parent = [], [], 0
    for j, level in enumerate(levels):
        exact = False
        if parent is not None and j < len(border):
            word = bisect.bisect_left(names, border[j])
            key = parent * len(names) + word
            keys = level.keys
            at = int(np.searchsorted(keys, key))
            exact = at < len(keys) and keys[at] == key and word < len(names) and names[word] == border[j]
            ancestor = exact and j < len(border) - 1
            cuts.append(at + ancestor)
            above.append(ancestor)
            parent = at if exact else None
        else:
            cuts.append(int(np.searchsorted(level.parent, cuts[-1])))
            above.append(False)
    return cuts, above


def cut_tries(tries: DataFrame, lines: list[tuple[bytes, ...]]) -> DataFrame:
    """``range, payload``: each shard's nodes of each range, with the counts of the ancestors of the range's lower border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                _, words, levels = read_trie(raw.as_py())
                names = words.to_pylist()
                for level in levels:
                    level.keys = level.parent * len(names) + level.word
                first, inherited, found = [0] * len(levels), [False] * len(levels), []
                for r in range(len(lines) + 1):
                    if r < len(lines):
                        cuts, above = cut_at(names, levels, lines[r])
                    else:
                        cuts, above = [len(level.word) for level in levels], []
                    begin = [a - i for a, i in zip(first, inherited, strict=True)]
                    if any(b > a for a, b in zip(begin, cuts, strict=True)):
                        found.append((r, written(words, levels, begin, cuts, inherited)))
                    first, inherited = cuts, above
                yield pa.RecordBatch.from_pydict(
                    {"range": [f[0] for f in found], "payload": [f[1] for f in found]},
                    pa.schema([("range", pa.int64()), ("payload", pa.binary())]),
                )

    return tries.select("trie").mapInArrow(run, "range long, payload binary")


def merged(runs: list[bytes], least: int) -> Iterator[tuple[pa.Array, list[Level], np.ndarray]]:
    """Level by level: the lexicon, all levels so far, and which nodes of the last are the range's own."""
    tries = [read_trie(r) for r in runs]
    words, place = sorted_lexicon(pa.concat_arrays([t[1] for t in tries]))
    starts = np.cumsum([0, *(len(t[1]) for t in tries)])
    levels: list[Level] = []
    above = [np.zeros(1, np.int64)] * len(tries)  # of each trie's nodes one level up: their place in the merged one
    for j in range(len(tries[0][2])):
        parents = [a[t[2][j].parent] for a, t in zip(above, tries, strict=True)]
        sizes = [len(p) for p in parents]
        parent = np.concatenate(parents)
        word = place[np.concatenate([t[2][j].word + s for t, s in zip(tries, starts[:-1], strict=True)])]
        count = np.concatenate([t[2][j].count for t in tries])
        border = np.zeros(len(parent), bool)
        begin = np.cumsum([0, *sizes])
        border[[b for b, t, n in zip(begin[:-1].tolist(), tries, sizes, strict=True) if n and t[0][j]]] = True
        alive = np.flatnonzero(parent >= 0)
        keys = parent[alive] * len(words) + word[alive]
        order = np.argsort(keys, kind="stable")  # sorted runs: each trie's nodes ascend
        keys = keys[order]
        new = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
        total = np.add.reduceat(count[alive][order], new) if len(new) else np.zeros(0, np.int64)
        inherited = np.maximum.reduceat(border[alive][order], new) if len(new) else np.zeros(0, bool)
        kept = (total >= least) | inherited | (j == 0)
        number = np.where(kept, np.cumsum(kept) - 1, -1)
        to = np.full(len(parent), -1, np.int64)
        to[alive[order]] = np.repeat(number, np.diff(np.append(new, len(keys))))
        above = np.split(to, begin[1:-1])
        keys = keys[new][kept]
        levels.append(Level(keys // len(words), keys % len(words), total[kept]))
        yield words, levels, ~inherited[kept]


PHRASE = pa.schema(
    [("lang", pa.binary()), ("phrase", pa.binary()), ("a", pa.int64()), ("n", pa.int64()), ("firsts", pa.list_(pa.int64()))]
)


def frequent_phrases(parts: DataFrame, least: int) -> DataFrame:
    """Staged ``lang, phrase, a, n, firsts`` (counts of the first 1, 2, ... words) of all phrases of at least ``least``."""

    def run(table: pa.Table) -> pa.Table:
        out = {name: [] for name in PHRASE.names}
        for words, levels, own in merged(table["payload"].to_pylist(), least):
            depth = len(levels) - 1
            if not depth:
                continue
            node = np.flatnonzero(own)
            walk, counts = [], []
            for level in levels[::-1]:
                walk.append(words.take(pa.array(level.word[node])).to_pylist())
                counts.append(level.count[node].tolist())
                node = level.parent[node]
            walk, counts = walk[::-1], counts[::-1]
            out["lang"] += walk[0]
            out["phrase"] += map(b" ".join, zip(*walk[1:], strict=True))
            out["a"] += counts[-1]
            out["n"] += counts[0]
            out["firsts"] += [list(c) for c in zip(*counts[1:-1], strict=True)] if depth > 1 else [[]] * len(counts[0])
        return pa.table(out, PHRASE)

    schema = "lang binary, phrase binary, a long, n long, firsts array<long>"
    found = parts.groupBy("range").applyInArrow(run, schema)
    return staged(found.withColumns({c: F.col(c).cast("string") for c in ("lang", "phrase")}), "phrases")


def scored(phrases: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of each candidate that no longer one of equal count holds."""
    words = F.split("phrase", " ")
    candidates = phrases.where(F.size("firsts") > 0).withColumn("_m", F.size("firsts") + 1)
    cuts = candidates.select("lang", "phrase", "a", "n", "_m", F.posexplode("firsts").alias("_k", "l"))
    rest = F.array_join(F.slice(words, F.col("_k") + 2, F.col("_m")), " ")
    rests = phrases.select("lang", F.col("phrase").alias("_rest"), F.col("a").alias("r"))
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    cuts = cuts.withColumn("_rest", rest).join(rests, ["lang", "_rest"])
    cuts = cuts.withColumns({f"_{c}": x for c, x in big.items()})
    cuts = cuts.withColumn("score", F.expr("(_a * _n * 1000BD) div (_l * _r)"))
    lowest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "_k", "l", "r")).alias("_cut"))
    lowest = lowest.select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    # a phrase one word shorter on either side has as many occurrences: so has every one in between
    longer = candidates.where("_m > 2").select("lang", "a", words.alias("_w"), "_m")
    sides = F.array(F.slice("_w", 1, F.col("_m") - 1), F.slice("_w", 2, F.col("_m") - 1))
    held = longer.select("lang", "a", F.explode(sides).alias("_w")).select("lang", F.array_join("_w", " ").alias("phrase"), "a")
    return lowest.join(held, ["lang", "phrase", "a"], "left_anti").select("lang", "phrase", "a", "l", "r", "n", "score")


def mine(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    shard_bytes: int = SHARD_BYTES,
    range_nodes: int = RANGE_NODES,
) -> DataFrame:
    """All scored phrases of ``text, lang`` rows."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    frequent = frequent_filter(rows, least, shard_bytes)
    tries = shard_tries(rows, frequent, longest, shard_bytes)
    return scored(frequent_phrases(cut_tries(tries, borders(tries, range_nodes)), least))


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top``; what can't be among them leaves in salted groups before."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(min(MOST_SALTS, shuffle_width(phrases.sparkSession))))
    near = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))
    some = phrases.withColumn("_salt", salt).withColumn("_near", near).where(F.col("_near") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    first = some.withColumn("rank", rank).where(F.col("rank") <= top)
    return first.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(mine(read_table(spark, sf_dir, "documents")))
