"""Repeated passages by fixed-block anchors (operator 1).

Each text is cut into non-overlapping reference blocks of ``BLOCK`` words, which are indexed; every
rolling window of ``BLOCK`` words probes the index. Any passage of ``2 * BLOCK`` words holds a whole
reference block of the text where it stood first, so a repeat always leaves a hit. Hits are extended
to the ``WINDOW``-word windows around them, all of whose probes must repeat, and of the windows with the same words
all but the first (smallest ``doc_id``, then earliest start) are repeats. Windows are the same if two independent
hashes of their words agree, 96 bits in all: a false match among 10^13 windows has a chance of about one in a thousand.
Adjoining repeats form one maximal exact repeat and are removed.

Edge cases: a null or empty text has no words; a text shorter than a window keeps all; a very long text is a batch of
its own and is held in one task; a null
``doc_id`` comes before all others; rows that share a ``doc_id`` are separate, the earlier staged
one first; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import (
    NO_ID, FirstOccurrence, bits_of, bucket_bits, decide_first, flag_answer, gather, rows_of, scatter, slices,
    text_batches, with_answers,
)
from .kernels import TO_BLANK, U64, Block, mix, pack, prefix_hashes, runs_to_mask, span_hashes, unpack
from .staging import read_table

WINDOW = 20
BLOCK = 10
SECOND = U64(0xD6E8FEB86659FD93)


def rolling(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``width`` words from each position, and whether they are one document's."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, bool)
    at = np.arange(n)
    return mix(span_hashes(prefix_hashes(words), at, at + width)), owner[:n] == owner[width - 1 :]


def second_hashes(words: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Another hash (32 bits) of the ``width`` words from each of the starts, independent of the first."""
    out = np.zeros(len(starts), U64)
    for i in range(width):
        out = mix(out + words[starts + i] * SECOND)
    return (out >> U64(32)).astype(np.uint32)


class Probes:
    """The distinct probes of a batch: ascending keys, and what is known of each."""

    def __init__(self, words: np.ndarray, owner: np.ndarray, block: int):
        self.hashes, self.whole = rolling(words, owner, block)
        per = np.bincount(owner) if len(owner) else np.zeros(0, np.int64)
        place = np.arange(len(self.hashes)) - (np.cumsum(per) - per)[owner[: len(self.hashes)]]
        keys = (self.hashes & ~U64(1)) | (place % block == 0).astype(U64)
        keys = np.sort(keys[self.whole])
        bare = keys >> U64(1)
        new = np.ones(len(keys), bool)
        new[1:] = bare[1:] != bare[:-1]
        ends = np.append(np.flatnonzero(new)[1:], len(keys)) if len(keys) else np.zeros(0, np.int64)
        self.keys = bare[new] << U64(1)
        self.indexed = (keys[ends - 1] & U64(1)).astype(bool)
        self.several = np.diff(np.append(np.flatnonzero(new), len(keys))) > 1

    def payloads(self, bits: int) -> Iterator[tuple[int, bytes]]:
        for bucket, part in slices(self.keys, bits):
            short = (self.keys[part] << U64(bits)) >> U64(32)
            gaps = np.diff(short, prepend=U64(0)).astype(np.uint32)
            yield bucket, pack(gaps, self.indexed[part].view(np.uint8) | self.several[part].view(np.uint8) << 1)

    def known(self, flags: np.ndarray) -> np.ndarray:
        """A flag of each key for each position."""
        out = np.zeros(len(self.hashes), bool)
        if len(self.keys):
            at = np.searchsorted(self.keys, self.hashes & ~U64(1))
            out[self.whole] = flags[at[self.whole]]
        return out


def decide_hits(numbers: np.ndarray, payloads: list[bytes]) -> list[bytes]:
    """Bucket step: which probes occur twice or more, and which of those meet a reference block."""
    parts = [unpack(p) for p in payloads]
    sizes = np.array([len(p[0]) for p in parts])
    keys = np.concatenate([np.cumsum(p[0].astype(np.uint64)) for p in parts])
    known = np.concatenate([p[1] for p in parts])
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    firsts = np.flatnonzero(new)
    either = np.bitwise_or.reduceat(known[order], firsts)
    repeated = (np.diff(np.append(firsts, len(keys))) > 1) | (either & 2 > 0)
    group = np.cumsum(new) - 1
    back = np.empty(len(keys), np.int64)
    back[order] = group
    hit = repeated & (either & 1 > 0)
    cuts = np.cumsum(sizes)[:-1]
    return [flag_answer(a, b) for a, b in zip(np.split(repeated[back], cuts), np.split(hit[back], cuts), strict=True)]


class Windows:
    """Candidate windows of a batch, after the hits are known."""

    def __init__(self, block: Block, answers: list[bytes], window: int, width: int):
        self.starts, self.ends, self.owner, words = block.words()
        probes = Probes(words, self.owner, width)
        n = len(probes.keys)
        repeated, hit = (probes.known(bits_of(answers, c, n)) for c in (1, 2))
        inner = window - width + 1
        hashes, whole = rolling(words, self.owner, window)
        # probes s .. s+inner-1 stand in the window that starts at s
        total = np.concatenate(([0], np.cumsum(repeated)))
        hits = np.concatenate(([0], np.cumsum(hit)))
        at = np.arange(len(hashes))
        good = whole & (total[at + inner] - total[at] == inner) & (hits[at + inner] > hits[at])
        self.at = np.flatnonzero(good)
        self.first = FirstOccurrence(hashes[self.at], second_hashes(words, self.at, window))
        per = np.bincount(self.owner, minlength=len(block.lengths))
        self.counts, self.base = per, np.cumsum(per) - per


def remove_repeats(docs: DataFrame, window: int = WINDOW, width: int = BLOCK) -> DataFrame:
    """``doc_id, n_words, kept_text, spans``: kept words joined by one blank, removed runs as (first word, words)."""
    if window < 2 * width:
        raise ValueError("a window must hold two blocks")
    batches = text_batches(docs)
    bits = bucket_bits(batches)

    def probe(ids: np.ndarray, block: Block) -> Iterator[tuple[int, bytes]]:
        _, _, owner, words = block.words()
        yield from Probes(words, owner, width).payloads(bits)

    def extend(ids: np.ndarray, block: Block, hits: list[bytes]) -> Iterator[tuple[int, bytes]]:
        found = Windows(block, hits, window, width)
        owner = found.owner[found.at]
        yield from found.first.payloads(ids[owner], found.at - found.base[owner], bits)

    def keep(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow:
            for _, ids, block, (hits, lost) in rows_of(part):
                found = Windows(block, hits, window, width)
                again = found.at[found.first.repeats(bits_of(lost, 1, len(found.first.keys)))]
                yield _kept(ids, block, found, again, window)

    hits = gather(scatter(batches.select("batch", "content"), probe), decide_hits, "anchor-hits")
    lost = gather(scatter(with_answers(batches, hits), extend), decide_first, "anchor-firsts")
    return with_answers(batches, hits, lost).mapInArrow(
        keep, "doc_id long, n_words long, kept_text binary, spans array<struct<start:long,length:long>>"
    )


def _kept(ids: np.ndarray, block: Block, found: Windows, again: np.ndarray, window: int) -> pa.RecordBatch:
    n = len(found.starts)
    gone = runs_to_mask(again, again + window, n)
    # Each word with the blank after it; every text gets one more blank at its end.
    shift = np.arange(len(block.lengths))
    wide = np.full(len(block.data) + len(shift), 0x20, np.uint8)
    wide[np.arange(len(block.data)) + np.repeat(shift, block.lengths)] = TO_BLANK[block.data]
    starts, ends = found.starts + found.owner, found.ends + found.owner
    keep = ~gone
    mask = runs_to_mask(starts[keep], ends[keep] + 1, len(wide))
    text = wide[mask].tobytes()
    size = np.bincount(found.owner[keep], weights=(ends - starts)[keep] + 1, minlength=len(shift)).astype(np.int64)
    to = np.cumsum(size)
    first = gone.copy()
    first[1:] &= ~(gone[:-1] & (found.owner[1:] == found.owner[:-1]))
    runs = np.flatnonzero(first)
    lengths = np.add.reduceat(gone, runs) if len(runs) else runs
    spans: list[list] = [[] for _ in shift]
    # a run ends where the next kept word stands, or its text does
    stop = np.append(np.flatnonzero(~gone), n)
    ends_of_run = np.minimum(stop[np.searchsorted(stop, runs)], (found.base + found.counts)[found.owner[runs]])
    lengths = ends_of_run - runs
    for o, s, k in zip(found.owner[runs].tolist(), (runs - found.base[found.owner[runs]]).tolist(), lengths.tolist(), strict=True):
        spans[o].append({"start": s, "length": k})
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64(), mask=ids == NO_ID),
            pa.array(found.counts, pa.int64()),
            pa.array([text[b - s : max(b - 1, b - s)] for b, s in zip(to.tolist(), size.tolist(), strict=True)], pa.binary()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        ],
        ["doc_id", "n_words", "kept_text", "spans"],
    )


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return out.select(
        "doc_id",
        "n_words",
        removed.alias("n_removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
        F.size("spans").cast("long").alias("n_spans"),
    )
