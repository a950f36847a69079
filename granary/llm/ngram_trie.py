"""Elias-Fano sequences and the n-gram trie made of them."""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np

U64 = np.uint64
ALL_BYTES = U64(0x0101010101010101)
HIGH_BITS = U64(0x8080808080808080)
STEP = 2048.0  # codes a unit of log10 probability
#: Place of the k-th set bit of each byte.
IN_BYTE = np.array([([i for i in range(8) if b >> i & 1] + [8] * 8)[:8] for b in range(256)], np.uint8).ravel()


def quantised(log10: np.ndarray) -> np.ndarray:
    """16-bit codes of non-positive log10 probabilities, 1/2048 apart."""
    return np.minimum(np.rint(-log10 * STEP), 65535).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / -STEP


class Bits:
    """A bit vector in 64-bit words, with the ones and zeros before each word counted for selects."""

    def __init__(self, words: np.ndarray, ones: np.ndarray, zeros: np.ndarray):
        self.words, self.ones, self.zeros = words, ones, zeros

    @classmethod
    def of(cls, marks: np.ndarray) -> Bits:
        packed = np.packbits(marks, bitorder="little")
        words = np.concatenate((packed, np.zeros(-len(packed) % 8, np.uint8))).view(U64)
        ones = np.zeros(len(words), np.uint32)
        np.cumsum(np.bitwise_count(words[:-1]), out=ones[1:], dtype=np.uint32)
        return cls(words, ones, (np.arange(len(words), dtype=np.int64) * 64 - ones).astype(np.uint32))

    def select(self, k: np.ndarray, zero: bool = False) -> np.ndarray:
        """Position of the k-th set bit (or unset bit), from 0."""
        before = self.zeros if zero else self.ones
        word = np.searchsorted(before, k.astype(np.uint32), side="right") - 1
        bits = ~self.words[word] if zero else self.words[word]
        k = (k - before[word]).astype(U64)
        sums = bits - (bits >> U64(1) & U64(0x5555555555555555))
        sums = (sums & U64(0x3333333333333333)) + (sums >> U64(2) & U64(0x3333333333333333))
        sums = ((sums + (sums >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * ALL_BYTES  # ones up to and with each byte
        less = ((k * ALL_BYTES | HIGH_BITS) - sums & HIGH_BITS) >> U64(7)  # the bytes that end at or before the k-th
        shift = (less * ALL_BYTES >> U64(56)) << U64(3)
        k -= (sums << U64(8)) >> shift & U64(255)
        inside = IN_BYTE[((bits >> shift & U64(255)) << U64(3) | k).astype(np.int64)]
        return (word << 6) + shift.astype(np.int64) + inside


class EliasFano:
    """A non-decreasing sequence: low bits packed side by side, high bits as a unary bit vector."""

    def __init__(self, n: int, width: int, top: int, low: np.ndarray, high: Bits):
        self.n, self.width, self.top, self.low, self.high = n, width, top, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        last = int(values[-1]) + 1 if n else 1
        width = max(0, (last // max(n, 1)).bit_length() - 1)
        bits = np.zeros(n * width, np.uint8)
        for j in range(width):
            bits[j::width] = values >> j & 1
        low = np.packbits(bits, bitorder="little")
        low = np.concatenate((low, np.zeros(16 - len(low) % 8, np.uint8))).view(U64)
        top = int(values[-1] >> width) if n else 0
        marks = np.zeros(top + n + 1, np.uint8)
        marks[(values >> width) + np.arange(n)] = 1
        return cls(n, width, top, low, Bits.of(marks))

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.int64)
        bit = i * self.width
        word, shift = bit >> 6, (bit & 63).astype(U64)
        two = self.low[word] >> shift | (self.low[word + 1] << (U64(63) - shift)) << U64(1)
        return (two & U64((1 << self.width) - 1)).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at the places ``i``."""
        return self.high.select(i) - i << self.width | self.low_bits(i)

    def next(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place with a value of at least ``wanted``, else ``n``; and whether it is that value."""
        if not self.n:
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        part = wanted >> self.width
        beyond = part > self.top
        part = np.clip(part, 0, self.top)
        # unset bit number z stands after the values whose high part is at most z
        low = np.where(part > 0, self.high.select(np.maximum(part - 1, 0), zero=True) - (part - 1), 0)
        end = self.high.select(part, zero=True) - part
        rest = wanted & (1 << self.width) - 1
        high = end.copy()
        todo = np.flatnonzero(low < high)
        while todo.size:
            mid = low[todo] + high[todo] >> 1
            less = self.low_bits(mid) < rest[todo]
            low[todo] = np.where(less, mid + 1, low[todo])
            high[todo] = np.where(less, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        inside = np.flatnonzero((low < end) & ~beyond)
        hit = np.zeros(len(wanted), bool)
        hit[inside] = self.low_bits(low[inside]) == rest[inside]
        low[beyond] = self.n
        return low, hit

    def successor(self, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """First place in ``[low, high)`` with a value of at least ``wanted``, else ``high``."""
        return np.clip(self.next(wanted)[0], low, high)

    def arrays(self) -> dict[str, np.ndarray]:
        high = {"words": self.high.words, "ones": self.high.ones, "zeros": self.high.zeros}
        return {"size": np.array([self.n, self.width, self.top]), "low": self.low, **high}

    @classmethod
    def from_arrays(cls, x: dict[str, np.ndarray]) -> EliasFano:
        return cls(*x["size"].tolist(), x["low"], Bits(x["words"], x["ones"], x["zeros"]))


class Level:
    """Children of the nodes of the level above: monotone pointers, and children made monotone by
    adding the last value of the group before."""

    def __init__(self, pointers: EliasFano, children: EliasFano):
        self.pointers, self.children = pointers, children

    @classmethod
    def of(cls, parents: np.ndarray, values: np.ndarray, n_parents: int) -> Level:
        """``parents, values``: ascending, distinct pairs."""
        pointers = np.searchsorted(parents, np.arange(n_parents + 1))
        full = np.flatnonzero(np.diff(pointers))
        last = values[pointers[full + 1] - 1] + 1
        offset = np.zeros(n_parents, np.int64)
        offset[full] = np.cumsum(last) - last
        return cls(EliasFano.of(pointers), EliasFano.of(values + offset[parents] if len(values) else values))

    def range(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last place (exclusive) of each parent's children, and what was added to them."""
        low, high = self.pointers.at(parent), self.pointers.at(parent + 1)
        base = np.zeros(len(parent), np.int64)
        later = np.flatnonzero(low)
        if self.children.n:
            base[later] = self.children.at(low[later] - 1) + 1
        return low, high, base

    def find(self, ranges: tuple[np.ndarray, np.ndarray, np.ndarray], owner: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Place of child ``value`` of the ``owner``-th range, or -1: a successor search within that range."""
        low, high, base = ranges
        place, hit = self.children.next(base[owner] + value)
        return np.where(hit & (place >= low[owner]) & (place < high[owner]), place, -1)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each run of equal keys, and the run of each place."""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = keys[0][1:] != keys[0][:-1]
        for key in keys[1:]:
            new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def discount(once: int, twice: int) -> float:
    """Absolute discount from how many n-grams occur once and twice."""
    return float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))


class Trie:
    """Words of contexts, their successors, their predecessors, and trigrams by context-relative rank.

    ``words``: contexts v; ``pairs``: v -> w; ``contexts``: v -> u; ``triples``: (u, v) -> rank of w
    among the successors of v.
    """

    NAMES = ("words", "pairs.pointers", "pairs.children", "contexts.pointers", "contexts.children",
             "triples.pointers", "triples.children")

    def __init__(self, sequences: dict[str, EliasFano], codes: dict[str, np.ndarray]):
        self.sequences, self.codes = sequences, codes
        self.words = sequences["words"]
        self.pairs, self.contexts, self.triples = (
            Level(sequences[f"{x}.pointers"], sequences[f"{x}.children"]) for x in ("pairs", "contexts", "triples")
        )

    @classmethod
    def trained(cls, u: np.ndarray, v: np.ndarray, w: np.ndarray, base: np.ndarray) -> Trie:
        """From occurrences of trigrams; ``base[w]``: log10 probability of w by itself."""
        order = np.lexsort((w, u, v))
        u, v, w = (np.asarray(x, np.int64)[order] for x in (u, v, w))
        first, _ = runs(v, u, w)
        n = np.diff(np.append(first, len(u)))
        u, v, w = u[first], v[first], w[first]
        return cls.of_counts(u, v, w, n, base, *(discount(*x) for x in counts_of_counts(v, w, n)))

    @classmethod
    def of_counts(
        cls, u: np.ndarray, v: np.ndarray, w: np.ndarray, n: np.ndarray, base: np.ndarray, d2: float, d3: float,
        totals: dict[str, np.ndarray] | None = None,
    ) -> Trie:
        """From distinct trigrams in (v, u, w) order and their counts, by interpolated absolute discounting.

        A count of 0 only names a word and a context. ``totals`` tells, for words and contexts that stand in other
        tries as well, of their counts and numbers of successors over all tries: ``v, u`` (-1: the word itself),
        ``n, fan``.
        """
        starts, at = runs(v)
        words = v[starts]
        begin, context_at = runs(v, u)
        context_word, context = at[begin], u[begin]
        there = np.flatnonzero(n)
        pair, pair_at = np.unique(at[there] << 32 | w[there], return_inverse=True)
        pair_n = np.bincount(pair_at, weights=n[there], minlength=len(pair))
        owner, child = pair >> 32, pair & 0xFFFFFFFF
        pointer = np.searchsorted(owner, np.arange(len(words) + 1))
        word_n, word_fan = np.bincount(at, weights=n, minlength=len(words)), np.diff(pointer)
        context_n = np.bincount(context_at, weights=n, minlength=len(begin))
        context_fan = np.bincount(context_at[there], minlength=len(begin))
        if totals is not None and len(totals["v"]) and len(words):
            place = np.searchsorted(words, totals["v"])
            here = words[np.minimum(place, len(words) - 1)] == totals["v"]
            alone = here & (totals["u"] < 0)
            word_n[place[alone]], word_fan[place[alone]] = totals["n"][alone], totals["fan"][alone]
            both, keys = here & (totals["u"] >= 0), context_word << 32 | context
            wanted = place[both] << 32 | totals["u"][both]
            spot = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            known = keys[spot] == wanted
            context_n[spot[known]], context_fan[spot[known]] = totals["n"][both][known], totals["fan"][both][known]
        spare2 = np.where(word_n > 0, d2 * word_fan / np.maximum(word_n, 1), 1.0)
        p2 = (pair_n - d2) / word_n[owner] + spare2[owner] * 10.0 ** base[child]
        spare3 = np.where(context_n > 0, d3 * context_fan / np.maximum(context_n, 1), 1.0)
        context_at = context_at[there]
        p3 = (n[there] - d3) / context_n[context_at] + spare3[context_at] * p2[pair_at]
        levels = {
            "pairs": Level.of(owner, child, len(words)),
            "contexts": Level.of(context_word, context, len(words)),
            "triples": Level.of(context_at, pair_at - pointer[at[there]], len(begin)),
        }
        sequences = {"words": EliasFano.of(words)}
        for name, level in levels.items():
            sequences[f"{name}.pointers"], sequences[f"{name}.children"] = level.pointers, level.children
        codes = {"p2": np.log10(p2), "p3": np.log10(p3), "spare2": np.log10(spare2), "spare3": np.log10(spare3)}
        return cls(sequences, {k: quantised(x) for k, x in codes.items()})

    def score(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, base: np.ndarray) -> np.ndarray:
        """log10 probability of each w after u v; ``base``: that of w by itself. Sorted trigrams are found faster."""
        out = base.astype(float).copy()
        if not self.words.n or not len(out):
            return out
        first, owner = runs(v)
        word, seen_word = self.words.next(v[first])
        seen = np.flatnonzero(seen_word[owner])
        word = np.where(seen_word, word, 0)
        ranges = self.pairs.range(word)
        pair = self.pairs.find(ranges, owner[seen], w[seen])
        known = pair >= 0
        two = restored(self.codes["spare2"][word[owner[seen]]]) + out[seen]
        two[known] = restored(self.codes["p2"][pair[known]])
        begin, context_at = runs(v[seen], u[seen])
        context = self.contexts.find(self.contexts.range(word), owner[seen[begin]], u[seen[begin]])
        inside = np.flatnonzero(context[context_at] >= 0)
        found = np.maximum(context, 0)
        two_or_three = two.copy()
        two_or_three[inside] += restored(self.codes["spare3"][found[context_at[inside]]])
        both = inside[known[inside]]
        if self.contexts.children.n:
            rank = pair[both] - ranges[0][owner[seen[both]]]
            triple = self.triples.find(self.triples.range(found), context_at[both], rank)
            full = triple >= 0
            two_or_three[both[full]] = restored(self.codes["p3"][triple[full]])
        out[seen] = two_or_three
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        out = {f"{name}/{k}": x for name in self.NAMES for k, x in self.sequences[name].arrays().items()}
        return out | {f"codes/{k}": x for k, x in self.codes.items()}

    @classmethod
    def mapped(cls, arrays: dict[str, np.ndarray], folder: str) -> Trie:
        """The same levels as read-only files in ``folder``, memory-mapped."""
        found = {}
        for i, (name, x) in enumerate(arrays.items()):
            path = Path(folder, f"{i}.npy")
            np.save(path, x)
            found[name] = np.load(path, mmap_mode="r") if x.size else x
        parts = ("size", "low", "words", "ones", "zeros")
        sequences = {name: EliasFano.from_arrays({k: found[f"{name}/{k}"] for k in parts}) for name in cls.NAMES}
        return cls(sequences, {k[6:]: x for k, x in found.items() if k.startswith("codes/")})


def counts_of_counts(v: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[tuple[int, int], tuple[int, int]]:
    """How many pairs (v, w), and how many of the distinct trigrams, occur once and twice."""
    _, at = np.unique(v << 32 | w, return_inverse=True)
    pairs = np.bincount(at, weights=n) if len(at) else np.zeros(0)
    return tuple((int((x == 1).sum()), int((x == 2).sum())) for x in (pairs, n))


def temporary_folder() -> tempfile.TemporaryDirectory:
    """Scratch of one task for the files that it maps, gone when it ends; nothing else reads it."""
    return tempfile.TemporaryDirectory(prefix="trie-")
