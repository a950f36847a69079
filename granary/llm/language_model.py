"""Language-model scores from a sharded Elias-Fano n-gram trie (operator 7).

Tokens are lower-cased (A-Z) words and one end a text. Four fifths of the documents train.

1. Every batch sends its distinct words with their training counts to hash buckets and gets back,
   for each, the corpus count and a number that is small for frequent words.
2. Every batch sends its distinct trigrams (u, v, w) with their training counts to the shard of v. A word v with
   more than a shard's tokens is split by the hash of w: the counts of (v, w) and (u, v, w) stay whole, and those
   of v and (u, v) as contexts are summed over its shards. So are the counts of counts, which give each order its
   discount. The model is the same for any number of shards.
3. A shard task builds the trie of its training trigrams (successors and predecessors of v, trigrams by the rank of w
   among the successors of v, quantised smoothed probabilities), maps it from disk, and looks every distinct trigram
   up once; each batch gets the codes of its own back and adds them up by document.

The lowest order is the add-half unigram estimate, with one unit of mass for all unknown words. Two words with one
64-bit hash (a sum of a strong mix of each byte and its place) would be taken for one; the chance for a billion
distinct words is three in a hundred.

Edge cases: a null or empty text is one end; a null ``doc_id`` trains; rows that share a ``doc_id``
are scored each for itself, with equal scores for equal texts; a very long text is one batch of its own, held in
one task; with no training tokens every token has the same probability; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import NO_ID, bucket_bits, gather, rows_of, scatter, slices, text_batches, with_answers
from .kernels import U64, Block, mix, pack, unpack
from .ngram_trie import STEP, Trie, counts_of_counts, discount, quantised, restored, runs, temporary_folder
from .staging import read_table, release, staged

BATCH = 5 << 20
#: Tokens of a shard; changes how the work is split, not the scores.
SHARD_TOKENS = 1_500_000
FOLDS, HELD_OUT = 5, 1
END = U64(0x5DEECE66D1234567)
START = 0  # the number of the place before a text; words are numbered from 1
NO_WORD = -1
SCORE_AT_ONCE = 250_000


def is_held_out(doc_id: int) -> bool:
    return doc_id != NO_ID and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


class Tokens:
    """Hashes and owners of a batch's tokens, an end after each text, and its distinct words."""

    def __init__(self, ids: np.ndarray, block: Block):
        _, _, owner, words = block.words(lower=True)
        docs = len(block.lengths)
        per = np.bincount(owner, minlength=docs)
        self.sizes = per + 1
        n = int(self.sizes.sum())
        self.owner = np.repeat(np.arange(docs), self.sizes)
        stop = np.cumsum(self.sizes) - 1
        self.hashes = np.full(n, END, U64)
        inside = np.ones(n, bool)
        inside[stop] = False
        self.hashes[inside] = words
        self.stop = stop
        self.held = np.array([is_held_out(int(i)) for i in ids], bool)
        self.keys, self.at = np.unique(self.hashes, return_inverse=True)
        self.counts = np.bincount(self.at[~self.held[self.owner]], minlength=len(self.keys)).astype(np.int64)


def _count(ids: np.ndarray, block: Block, bits: int) -> Iterator[tuple[int, bytes]]:
    found = Tokens(ids, block)
    for bucket, part in slices(found.keys, bits):
        yield bucket, pack(found.keys[part], found.counts[part])


def _number(numbers: np.ndarray, payloads: list[bytes]) -> list[bytes]:
    """Bucket step: corpus counts, and places in the bucket by descending count."""
    parts = [unpack(p) for p in payloads]
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    total = np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)
    place = np.empty(len(keys), np.int64)
    place[np.lexsort((keys, -total))] = np.arange(len(keys))
    sums = np.array([total.sum(), (total > 0).sum()], np.int64)
    return [pack(sums, total[x], place[x]) for x in np.split(at, cuts)]


def totals(counted: DataFrame) -> tuple[int, int]:
    """Training tokens and distinct training words, from what each bucket says of itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [unpack(x.as_py())[0] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([int(s[i]) for s in sums], pa.int64()) for i in (0, 1))], ["bucket", "n", "v"]
            )

    one = counted.select("bucket", "answer").mapInArrow(run, "bucket long, n long, v long").dropDuplicates(["bucket"])
    row = one.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    return row["n"] or 0, row["v"] or 0


def in_order(v: np.ndarray, u: np.ndarray, w: np.ndarray, values: int) -> np.ndarray:
    """Indices that sort by v, u and w, all below ``values``."""
    bits = max(1, int(values - 1).bit_length())
    if 3 * bits > 63:
        return np.lexsort((w, u, v))
    return np.argsort(v << 2 * bits | u << bits | w, kind="stable")


class Trigrams:
    """The distinct trigrams of a batch by shard, v, u and w; ``at``: that of each token."""

    def __init__(self, found: Tokens, counted: list[bytes], bits: int, shards: int, shard_tokens: int):
        parts = [unpack(x) for x in counted]
        self.count = np.concatenate([p[1] for p in parts])
        bucket = (found.keys >> U64(64 - bits)).astype(np.int64)
        number = (np.concatenate([p[2] for p in parts]) << bits | bucket) + 1
        by_number = np.argsort(number)
        rank = np.empty(len(number), np.int64)
        rank[by_number] = np.arange(1, len(number) + 1)
        self.numbers = np.concatenate(([START], number[by_number]))
        self.counts = np.concatenate(([0], self.count[by_number]))
        end = np.searchsorted(found.keys, END)
        # as many starts as ends, as both are one a text
        self.counts[0] = self.count[end] if end < len(self.count) and found.keys[end] == END else 0
        w = rank[found.at]
        first = found.stop - found.sizes + 1
        v, u = np.zeros_like(w), np.zeros_like(w)
        v[1:] = w[:-1]
        v[first] = 0
        u[2:] = w[:-2]
        u[first] = 0
        u[np.minimum(first + 1, found.stop)] = 0
        order = in_order(v, u, w, len(self.numbers))
        starts, at = runs(v[order], u[order], w[order])
        self.v, self.u, self.w = (x[order[starts]] for x in (v, u, w))
        self.n = np.bincount(at, weights=~found.held[found.owner[order]], minlength=len(starts)).astype(np.int64)
        share = np.maximum(1, -(-self.counts // shard_tokens))
        self.split = share > 1
        part = mix(self.numbers[self.w].astype(U64) ^ U64(0xC1A55)) % share[self.v].astype(U64)
        shard = (mix(self.numbers[self.v].astype(U64) * U64(0x9E3779B97F4A7C15) ^ part << U64(40)) % U64(shards)).astype(np.int64)
        by_shard = np.argsort(shard, kind="stable")
        self.v, self.u, self.w, self.n, self.shard = (x[by_shard] for x in (self.v, self.u, self.w, self.n, shard))
        place = np.empty(len(shard), np.int64)
        place[by_shard] = np.arange(len(shard))
        self.at = np.empty(len(order), np.int64)
        self.at[order] = place[at]

    def base(self, n: int, v: int) -> np.ndarray:
        """log10 probability of each word of the batch by itself."""
        return np.log10((self.count + 0.5) / (n + 0.5 * (v + 1)))

    def payloads(self, n: int, v: int) -> Iterator[tuple[int, bytes]]:
        codes = quantised(np.log10((self.counts + 0.5) / (n + 0.5 * (v + 1))))
        cuts = np.append(np.flatnonzero(np.diff(self.shard, prepend=-1)), len(self.shard))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            three = [x[a:b] for x in (self.v, self.u, self.w)]
            mine = np.unique(np.concatenate(three))
            x, y, z = (np.searchsorted(mine, t).astype(np.uint32) for t in three)
            yield int(self.shard[a]), pack(
                np.diff(self.numbers[mine], prepend=0), codes[mine], self.split[mine].view(np.uint8),
                np.diff(x, prepend=np.uint32(0)), y, z, self.n[a:b].astype(np.uint32),
            )


TABLE = "shard long, once2 long, twice2 long, once3 long, twice3 long, hot binary, trigrams binary"


def _merge(table: pa.Table) -> pa.Table:
    """Shard step: the distinct trigrams of all batches with their counts, and each batch's places among them."""
    table = table.sort_by("batch")
    parts = [unpack(p.as_py()) for p in table.column("payload")]
    tables = [np.cumsum(p[0]) for p in parts]
    words, at = np.unique(np.concatenate(tables), return_inverse=True)
    codes, split = np.zeros(len(words), np.uint16), np.zeros(len(words), np.uint8)
    codes[at], split[at] = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
    maps = np.split(at, np.cumsum([len(t) for t in tables])[:-1])
    sizes = np.array([len(p[3]) for p in parts], np.int64)
    v = np.concatenate([m[np.cumsum(p[3], dtype=np.int64)] for m, p in zip(maps, parts, strict=True)])
    u, w = (np.concatenate([m[p[i]] for m, p in zip(maps, parts, strict=True)]) for i in (4, 5))
    n = np.concatenate([p[6] for p in parts])
    del parts, tables, maps
    # a batch's trigrams come in the order of the whole table, so their places ascend and their steps are small
    order = in_order(v, u, w, len(words))
    starts, group = runs(v[order], u[order], w[order])
    place = np.empty(len(order), np.uint32)
    place[order] = group
    total = np.bincount(group, weights=n[order], minlength=len(starts)).astype(np.int64)
    first = order[starts]
    v, u, w = v[first], u[first], w[first]
    trained = np.flatnonzero(total)
    a, b, c, k = v[trained], u[trained], w[trained], total[trained]
    (once2, twice2), (once3, twice3) = counts_of_counts(a, c, k)
    # what this shard knows of split words and their contexts, trained here or not
    mine = np.flatnonzero(split[v])
    begin, context = runs(v[mine], u[mine])
    alone, alone_at = runs(v[mine])
    there = total[mine] > 0
    pairs = np.unique(alone_at[there] << 32 | w[mine[there]]) >> 32
    hot = (
        np.concatenate((words[v[mine[alone]]], words[v[mine[begin]]])),
        np.concatenate((np.full(len(alone), NO_WORD), words[u[mine[begin]]])),
        np.concatenate([np.bincount(x, weights=total[mine], minlength=len(y)) for x, y in ((alone_at, alone), (context, begin))]),
        np.concatenate((np.bincount(pairs, minlength=len(alone)), np.bincount(context[there], minlength=len(begin)))),
    )
    body = pack(
        np.diff(words, prepend=0), codes, np.diff(v.astype(np.uint32), prepend=np.uint32(0)), u.astype(np.uint32),
        w.astype(np.uint32), total, table.column("batch").to_numpy(), sizes, np.diff(place, prepend=np.uint32(0)), split,
    )
    row = [table.column("shard")[0].as_py(), once2, twice2, once3, twice3, pack(*(x.astype(np.int64) for x in hot)), body]
    names = ["shard", "once2", "twice2", "once3", "twice3", "hot", "trigrams"]
    kinds = [pa.int64()] * 5 + [pa.binary()] * 2
    return pa.table({name: pa.array([x], kind) for name, x, kind in zip(names, row, kinds, strict=True)})


def _hot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, hot in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            columns = unpack(hot.as_py())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(columns[0]), shard)), *map(pa.array, columns)], ["shard", "v", "u", "n", "fan"]
            )


def whole_contexts(shards: DataFrame) -> DataFrame:
    """``shard, totals``: for the split words of a shard and their contexts, counts and successors over all shards."""
    hot = shards.select("shard", "hot").mapInArrow(_hot_rows, "shard long, v long, u long, n long, fan long")
    totals = hot.groupBy("v", "u").agg(F.sum("n").alias("all_n"), F.sum("fan").alias("all_fan"))
    both = hot.select("shard", "v", "u").join(totals, ["v", "u"])
    return both.groupBy("shard").agg(F.collect_list(F.struct("v", "u", F.col("all_n").alias("n"), F.col("all_fan").alias("fan"))).alias("totals"))


def _codes(d2: float, d3: float):
    """Shard step: build the trie, map it, look the distinct trigrams up; each batch's codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, body, totals in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                numbers, base, v, u, w, n, owners, sizes, place, split = unpack(body.as_py())
                words, base = np.cumsum(numbers), restored(base)
                v, u, w = np.cumsum(v, dtype=np.int64), u.astype(np.int64), w.astype(np.int64)
                place = np.cumsum(place, dtype=np.uint32)
                known = np.flatnonzero((n > 0) | (split[v] > 0))
                whole = None
                if totals.is_valid:
                    rows = totals.values
                    whole = {k: rows.field(k).to_numpy(zero_copy_only=False) for k in ("v", "u", "n", "fan")}
                    for k in ("v", "u"):
                        none = whole[k] == NO_WORD
                        whole[k] = np.where(none, NO_WORD, np.searchsorted(words, whole[k]))
                model = Trie.of_counts(u[known], v[known], w[known], n[known], base, d2, d3, whole).arrays()
                codes = np.zeros(len(u), np.uint16)
                with temporary_folder() as folder:
                    model = Trie.mapped(model, folder)
                    for i in range(0, len(u), SCORE_AT_ONCE):
                        part = slice(i, i + SCORE_AT_ONCE)
                        codes[part] = quantised(np.minimum(model.score(u[part], v[part], w[part], base[w[part]]), 0.0))
                    del model
                answers = [pack(codes[x]) for x in np.split(place, np.cumsum(sizes)[:-1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(owners), pa.array(np.full(len(owners), shard)), pa.array(answers, pa.binary())],
                    ["batch", "bucket", "answer"],
                )

    return run


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row a document."""
    batches = text_batches(docs, BATCH)
    bits = bucket_bits(batches)
    counted = gather(
        scatter(batches.select("batch", "content"), lambda ids, block: _count(ids, block, bits)), _number, "lm-counts"
    )
    n, v = totals(counted)
    shard_tokens = SHARD_TOKENS
    shards = max(1, -(-n // shard_tokens))

    def send(ids: np.ndarray, block: Block, found: list[bytes]) -> Iterator[tuple[int, bytes]]:
        yield from Trigrams(Tokens(ids, block), found, bits, shards, shard_tokens).payloads(n, v)

    sent = scatter(with_answers(batches, counted), send).withColumnRenamed("bucket", "shard")
    merged = staged(sent.groupBy("shard").applyInArrow(_merge, TABLE), "lm-trigrams")
    seen = merged.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("once2", "twice2", "once3", "twice3")]).first()
    d2, d3 = discount(seen["once2"], seen["twice2"]), discount(seen["once3"], seen["twice3"])
    rows = merged.join(whole_contexts(merged), "shard", "left").select("shard", "trigrams", "totals")
    codes = staged(rows.mapInArrow(_codes(d2, d3), "batch long, bucket long, answer binary"), "lm-codes")
    release(merged)

    def add_up(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow:
            for _, ids, block, (known, answers) in rows_of(part):
                found = Tokens(ids, block)
                three = Trigrams(found, known, bits, shards, shard_tokens)
                points = np.concatenate([unpack(x)[0] for x in answers]).astype(np.int64)[three.at]
                docs = len(ids)
                score = np.bincount(found.owner, weights=points, minlength=docs) / -STEP
                base = np.bincount(found.owner, weights=three.base(n, v)[found.at], minlength=docs)
                known = np.bincount(found.owner, weights=three.count[found.at] > 0, minlength=docs).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64(), mask=ids == NO_ID),
                        pa.array(found.held),
                        pa.array(found.sizes.astype(np.int64)),
                        pa.array(known),
                        pa.array(np.full(docs, n, np.int64)),
                        pa.array(base),
                        pa.array(score),
                    ],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return with_answers(batches, counted, codes).mapInArrow(add_up, RESULT)


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
