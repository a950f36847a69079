"""Numpy helpers that work on the concatenated UTF-8 bytes of a block of texts."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15 | 1)  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
SEED = U64(0x2545F4914F6CDD1D)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TO_BLANK = np.arange(256, dtype=np.uint8)
TO_BLANK[SPACE] = 0x20

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base**0 .. base**(n-1)`` modulo 2**64, kept for the worker's life."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, U64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads the bits of a 64-bit hash."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """``S[i]``: sum of ``(values[j] + 1) * BASE**j`` for j < i; feeds :func:`span_hashes`."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum((values.astype(U64) + U64(1)) * powers(BASE, len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span, independent of where it stands."""
    return (prefix[ends] - prefix[starts]) * powers(BASE_INVERSE, len(prefix))[starts]


class Block:
    """Some texts as one byte array; ``bounds[i]:bounds[i+1]`` is text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.bounds)

    def parts(self, limit: int = 1 << 20) -> Iterator[tuple[int, int, Block]]:
        """Runs of whole texts of about ``limit`` bytes, so that working arrays stay small: first text, first byte, block."""
        at = 0
        while at < len(self.bounds) - 1:
            to = max(at + 1, int(np.searchsorted(self.bounds, self.bounds[at] + limit, side="right")) - 1)
            low, high = int(self.bounds[at]), int(self.bounds[to])
            yield at, low, Block(self.data[low:high], self.bounds[at : to + 1] - low)
            at = to

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end, text number and hash of each maximal run of non-space bytes."""
        found = []
        for text, byte, part in self.parts():
            starts, ends, owner, hashes = part._words(lower)
            found.append((starts + byte, ends + byte, owner + text, hashes))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(U64)
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _words(self, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = LOWER[self.data] if lower else self.data
        full = ~SPACE[data]
        n = len(data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(U64)
        first = np.zeros(n + 1, bool)
        first[self.bounds] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = full[:-1]
        starts = np.flatnonzero(full & (first[:n] | ~before))
        after = np.zeros(n, bool)
        after[:-1] = full[1:]
        ends = np.flatnonzero(full & (first[1:] | ~after)) + 1
        owner = np.searchsorted(self.bounds, starts, side="right") - 1
        since = np.concatenate(([0], starts))
        place = np.arange(n) - np.repeat(since, np.diff(np.append(since, n)))
        # a sum of strong mixes of each byte with its place in the word: no two words collide by their structure
        total = np.zeros(n + 1, U64)
        np.cumsum(mix((data.astype(U64) | place.astype(U64) << U64(8)) + SEED), out=total[1:])
        return starts, ends, owner, mix(total[ends] - total[starts] + (ends - starts).astype(U64))


def blocks(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[tuple[int, int, Block]]:
    """Rows of ``batch`` in runs of about ``limit`` bytes of text; a null text is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, to, Block(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def runs_to_mask(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True at the positions that some ``[start, end)`` covers."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:n]) > 0


def same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, sizes: np.ndarray, at_once: int = 1 << 20) -> np.ndarray:
    """Whether the ``sizes`` bytes at x and at y are the same, byte by byte."""
    out = np.ones(len(x), bool)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(x):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + at_once, side="right")))
        part = sizes[lo:hi]
        owner = np.repeat(np.arange(hi - lo), part)
        inside = np.arange(int(part.sum())) - np.repeat(np.cumsum(part) - part, part)
        differ = data[x[lo:hi][owner] + inside] != data[y[lo:hi][owner] + inside]
        out[lo:hi][owner[differ]] = False
        lo = hi
    return out


def exact_groups(
    order: np.ndarray, same: np.ndarray, equal: Callable[[np.ndarray, np.ndarray], np.ndarray], content: Callable[[int], bytes]
) -> tuple[np.ndarray, np.ndarray]:
    """Groups of equal things from an order in which ``same`` (key as the one before) only says that hashes are equal.

    Neighbours are compared; a run of one hash with different things in it is regrouped by content. Returns the order
    and where groups begin.
    """
    new = np.ones(len(order), bool)
    new[1:] = ~same
    at = np.flatnonzero(same)
    wrong = at[~equal(order[at], order[at + 1])]
    if wrong.size:
        order = order.copy()
        starts = np.append(np.flatnonzero(new), len(order))
        for run in np.unique(np.searchsorted(starts, wrong, side="right") - 1).tolist():
            a, b = starts[run], starts[run + 1]
            kinds: dict[bytes, list[int]] = {}
            for i in order[a:b].tolist():
                kinds.setdefault(content(i), []).append(i)
            order[a:b] = [i for group in kinds.values() for i in group]
            new[a:b] = False
            new[a + np.cumsum([0, *(len(g) for g in kinds.values())])[:-1]] = True
    return order, new


def crc32(values: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(values, dtype="<u4"))


def planes(values: np.ndarray) -> bytes:
    """Little-endian bytes by significance, so that a general compressor finds the constant ones."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return np.ascontiguousarray(raw.T).tobytes()


def from_planes(raw: bytes, dtype: str) -> np.ndarray:
    kind = np.dtype(dtype)
    table = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(table.T).view(kind).ravel()


def pack(*arrays: np.ndarray) -> bytes:
    """Several numpy arrays as one compressed value."""
    head = [np.array([len(arrays)], np.int64).tobytes()]
    body = []
    for x in arrays:
        raw = planes(x) if len(x) else b""
        head.append(np.array([len(raw)], np.int64).tobytes() + x.dtype.str.encode().ljust(8))
        body.append(raw)
    whole = b"".join(head + body)
    return len(whole).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(whole, asbytes=True)


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(packed[8:], int.from_bytes(packed[:8], "little"), asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 + 16 * n, []
    for i in range(n):
        size = int(np.frombuffer(raw, np.int64, 1, 8 + 16 * i)[0])
        kind = raw[16 + 16 * i : 24 + 16 * i].decode().strip()
        out.append(from_planes(raw[at : at + size], kind) if size else np.zeros(0, kind))
        at += size
    return out
