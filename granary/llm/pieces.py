"""SentencePiece ids of a byte-pair model by vectorised merge rounds, and texts back from ids (operator 13).

A text gets a leading blank, blanks become the model's blank sign, and is cut into words: a run of blank signs opens a
word, a line end is one of its own if no piece holds it. Each distinct word is encoded once a worker. New words lie in
flat arrays: symbols (characters at first), the word of each, and for each neighbouring pair the rank of the piece that
both make (by score, equal scores alike). A round takes each word's lowest rank, merges all its pairs of that rank at
once, from the left where they overlap, and compacts the arrays; words without a pair leave them.

The library merges one pair after another, best score first and the leftmost of equals. Merging all of one rank at once
is the same unless a pair that a merge makes ranks no higher than the merged one (equal scores, such as runs of blanks):
a word where that would happen merges only its leftmost pair in that round. Words are also cut between characters that
stand next to each other in no piece. What then still is longer than ``LONG`` symbols (such as a text of letters without
a blank) is merged from a heap of pairs, as rounds over it would take time by the square of its length.

Characters that are no piece become the ids of their bytes. Decoding is the library's own, whole documents at a time.
Models other than byte-pair ones with byte fallback, no normalisation and a dummy prefix are refused.

Edge cases: a null or empty text has no ids and decodes to an empty text; a text's length is bounded by memory alone;
rows that share a ``doc_id``, and null ids, are documents of their own; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .staging import read_table
from .tokens import Store

BLANK = "▁"
LONG = 4096
MEMO_WORDS = 500_000
NONE = np.int32(0x7FFFFFFF)
SLICE_BYTES = 1 << 20
#: Texts that tell whether a model cuts and normalises as this module does.
PROBES = ["a", " a", "a  b ", "▁a▁", "ﬁ Å Å ① Ａ", "\t\n\r　x", "\U0001f642\x00", "x" * 99, " " * 99]


class PairTable:
    """``(left, right)`` to the symbol that both make, by open addressing."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        self.bits = max(8, int(np.ceil(np.log2(4 * len(pairs) + 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, -1, np.int32)
        for (left, right), made in pairs.items():
            key = left << 32 | right
            at = int(self.slot(np.array([key]))[0])
            while self.keys[at] >= 0:
                at = at + 1 & (1 << self.bits) - 1
            self.keys[at], self.made[at] = key, made

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The made symbol, -1 for none."""
        keys = left.astype(np.int64) << 32 | right
        at = self.slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.made[at], np.int32(-1))
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.made[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


class Pieces:
    """A model's pieces as symbols, and the words it has encoded."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        byte = {i for i in range(size) if model.is_byte(i)}
        if len(byte) != 256 or any(model.is_unused(i) for i in range(size)):
            raise ValueError(f"{path}: not a model with byte fallback and only used pieces")
        self.byte_ids = np.zeros(256, np.uint32)
        for i in byte:
            self.byte_ids[int(model.id_to_piece(i)[1:-1], 16)] = i
        names = {model.id_to_piece(i): i for i in range(size) if not (i in byte or model.is_control(i) or model.is_unknown(i))}
        # symbols: the pieces, and characters that only stand inside of pieces; the last one is any other character
        symbols = {name: k for k, name in enumerate(dict.fromkeys([*names, *(c for name in names for c in name)]))}
        self.other = len(symbols)
        self.ids = np.array([names.get(s, -1) for s in symbols] + [-1], np.int64)
        scores = sorted({model.get_score(i) for i in names.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        self.rank = np.array([rank[model.get_score(names[s])] if s in names else NONE for s in symbols] + [NONE], np.int32)
        self.char = np.full(0x110000, self.other, np.int32)
        for s, k in symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = k
        pairs, inside = {}, {}
        for name in names:
            for i in range(1, len(name)):
                if name[:i] in symbols and name[i:] in symbols:
                    pairs[symbols[name[:i]], symbols[name[i:]]] = symbols[name]
                inside[symbols[name[i - 1]], symbols[name[i]]] = 1
        self.pairs, self.inside = PairTable(pairs), PairTable(inside)
        self.line_end = not any("\n" in name for name in names)
        if any(BLANK in name.lstrip(BLANK) for name in names):
            raise ValueError(f"{path}: a piece has a blank after another character")
        self.words = Store()
        self.decimal = [str(i) for i in range(size)]
        for probe, ids in zip(PROBES, self.encode(PROBES), strict=True):
            if ids.tolist() != model.encode(probe):
                raise ValueError(f"{path}: its rules are others than those of this module")

    def cut(self, text: str) -> list[str]:
        """Words in turn; empty strings may be among them."""
        if "  " in text or text.startswith(" ") or BLANK in text:
            found = re.findall(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n", BLANK + text.replace(" ", BLANK))
            if self.line_end:
                return found
            return re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", BLANK + text.replace(" ", BLANK))
        text = BLANK + text.replace(" ", f" {BLANK}")
        return (text.replace("\n", " \n ") if self.line_end else text).split(" ")

    def rank_of(self, made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, self.rank[made], NONE)

    def merged(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words and where each began; ``word`` ascends."""
        place = np.arange(len(symbol))
        made = np.full(len(symbol), -1, np.int32)
        same = np.flatnonzero(word[1:] == word[:-1])
        made[same] = self.pairs.of(symbol[same], symbol[same + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank = self.rank_of(made)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(first, len(word)))
            lowest = np.minimum.reduceat(rank, first)
            over = lowest == NONE
            if over.any():
                gone = np.repeat(over, sizes)
                done.append((place[gone], symbol[gone]))
                stay = ~gone
                symbol, word, place, made, rank = symbol[stay], word[stay], place[stay], made[stay], rank[stay]
                if not len(symbol):
                    break
                first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
                sizes, lowest = sizes[~over], lowest[~over]
            least = np.repeat(lowest, sizes)
            hit = np.flatnonzero(rank == least)
            # hits that follow each other share a symbol: every second of such a run, from its left end
            begin = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
            run = np.maximum.accumulate(np.where(begin, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            hit = self.in_turn(hit, symbol, word, made, least)
            symbol[hit] = made[hit]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            new = (np.cumsum(stay) - 1)[hit]
            symbol, word, place, made = symbol[stay], word[stay], place[stay], made[stay]
            changed = np.concatenate((new, new[new > 0] - 1))
            made[changed] = -1
            changed = changed[changed + 1 < len(word)]
            changed = changed[word[changed] == word[changed + 1]]
            made[changed] = self.pairs.of(symbol[changed], symbol[changed + 1])
        if not done:
            return symbol, place
        place, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        return symbol[order], place[order]

    def in_turn(self, hit: np.ndarray, symbol: np.ndarray, word: np.ndarray, made: np.ndarray, least: np.ndarray) -> np.ndarray:
        """``hit`` without all but the leftmost where a merge of the word makes a pair that may come before the rest."""
        own = word[hit]
        again = np.zeros(len(hit), bool)
        again[1:] = own[1:] == own[:-1]
        several = again.copy()
        several[:-1] |= again[1:]
        if not several.any():
            return hit
        at = np.flatnonzero(several)
        i = hit[at]
        left, here, limit = made[hit[at]], made[i], least[i]
        wrong = np.zeros(len(at), bool)
        before = i > 0
        before[before] = word[i[before] - 1] == word[i[before]]
        touching = np.zeros(len(at), bool)  # the hit before merges just left of this one
        touching[1:] = (hit[at[1:] - 1] + 2 == i[1:]) & again[at[1:]]
        left = np.where(touching, made[hit[at - 1]], symbol[np.maximum(i - 1, 0)])
        wrong[before] = self.rank_of(self.pairs.of(left[before], here[before])) <= limit[before]
        after = i + 2 < len(word)
        after[after] = word[np.minimum(i[after] + 2, len(word) - 1)] == word[i[after]]
        right = symbol[np.minimum(i + 2, len(word) - 1)]
        wrong[after] |= self.rank_of(self.pairs.of(here[after], right[after])) <= limit[after]
        bad = np.unique(own[at[wrong]])
        return hit[~(again & np.isin(own, bad))] if len(bad) else hit

    def merged_by_heap(self, symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long word: pairs by rank and place, each looked at once."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        known: dict[tuple[int, int], int] = {}
        symbol, rank, end = list(symbols), self.rank.tolist(), len(symbols)

        def make(left: int, right: int) -> int:
            pair = left, right
            if pair not in known:
                known[pair] = int(self.pairs.of(np.array([left]), np.array([right]))[0])
            return known[pair]

        heap = [(rank[m], i, m, i + 1) for i in range(end - 1) if (m := make(symbol[i], symbol[i + 1])) >= 0]
        heapq.heapify(heap)
        alive = [True] * end
        while heap:
            _, i, m, j = heapq.heappop(heap)
            if not alive[i] or after[i] != j or make(symbol[i], symbol[j]) != m:
                continue
            symbol[i], alive[j] = m, False
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (m := make(symbol[i], symbol[k])) >= 0:
                    heapq.heappush(heap, (rank[m], i, m, k))
            if (h := before[i]) >= 0 and (m := make(symbol[h], symbol[i])) >= 0:
                heapq.heappush(heap, (rank[m], h, m, i))
        place = np.flatnonzero(alive)
        return np.array(symbol, np.int32)[place], place

    def learn(self, words: list[str]) -> None:
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        symbol = self.char[points]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        new = np.ones(len(points), bool)
        new[1:] = self.inside.of(symbol[:-1], symbol[1:]) < 0
        new[(np.cumsum(lengths) - lengths)[lengths > 0]] = True
        part = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(points)))
        long = sizes > LONG
        short = ~long[part]
        at = np.flatnonzero(short)
        final, place = self.merged(symbol[short], part[short])
        place = at[place]
        for begin, size in zip(first[long].tolist(), sizes[long].tolist(), strict=True):
            more, where = self.merged_by_heap(symbol[begin : begin + size].tolist())
            final, place = np.concatenate((final, more)), np.concatenate((place, where + begin))
        order = np.argsort(place, kind="stable")
        ids, place = self.ids[final[order]], place[order]
        if (none := np.flatnonzero(ids < 0)).size:
            raw = [chr(c).encode() for c in points[place[none]].tolist()]
            counts = np.ones(len(ids), np.int64)
            counts[none] = [len(r) for r in raw]
            ids, place = np.repeat(ids, counts), np.repeat(place, counts)
            ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)[place]
        self.words.add(words, np.bincount(owner, minlength=len(words)), ids.astype(np.uint32))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words.place) > MEMO_WORDS:
            self.words = Store()
        found = [[w for w in self.cut(t) if w] if t else [] for t in texts]
        flat = [w for own in found for w in own]
        at = self.words.places(flat)
        if (missing := np.flatnonzero(at < 0)).size:
            self.learn(list(dict.fromkeys([flat[i] for i in missing.tolist()])))
            at[missing] = self.words.places([flat[i] for i in missing.tolist()])
        ids, lengths = self.words.of(at)
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.cumsum([len(own) for own in found])]
        return np.split(ids, ends[:-1]) if texts else []

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.model.decode([x.tolist() for x in ids]) if ids else []


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the ids of their ``text`` (null: empty)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        sizes = np.cumsum(np.array(pc.binary_length(texts).fill_null(0), np.int64))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            yield batch.slice(at, to - at), pieces_of(path).encode([x or "" for x in texts[at:to].to_pylist()])
            at = to


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids in encoded(batches, path):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids`` rows; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pieces_of(path).model.decode([x or [] for x in batch.column(1).to_pylist()]) if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row, without the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids in encoded(batches, path):
            pieces = pieces_of(path)
            name = pieces.decimal.__getitem__
            sums = [hashlib.sha256(",".join(map(name, x.tolist())).encode()).hexdigest() for x in ids]
            texts = [hashlib.sha256(t.encode()).hexdigest() for t in pieces.decode(ids)]
            columns = [rows.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(sums), pa.array(texts)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
