"""Repeated byte strings by a hash-compared suffix sort (operator 8).

Suffixes are dealt to buckets by content: of the ``GRAM``-byte strings in a ``LENGTH``-byte window the
one with the smallest hash is its anchor, so equal windows have equal anchors, wherever they stand. The windows
of one anchor form a stretch of text. A stretch whose anchor occurs nowhere else repeats nothing. All others go to the
anchor's bucket as text (equal ones of a batch once, compared byte by byte), and there their suffixes are sorted:

* prefix polynomial hashes give the hash of any substring in constant time;
* two suffixes are compared by their longest common extension, found by binary search over those
  hashes, and the byte after it: a logarithmic number of steps for any length;
* a bottom-up mergesort, all groups of suffixes at once, orders them by such comparisons;
* neighbours that compare as equal for ``LENGTH`` bytes are verified byte by byte.

Stretches that are the same as a whole need one sort for all: they are found by their hash and verified byte by byte
before it. Of the suffixes that share ``LENGTH`` bytes, all but the first in (``doc_id``, start) order repeat.

An anchor with more than ``CROWD`` different stretches (a line that a third of all documents hold, each
time between other lines) is split: its windows are dealt singly by their hash, first the hashes alone, then, of
those that stand in several batches, the bytes, which are sorted and verified as above. So ``CROWD`` changes how the
work is split and not the result.

Edge cases: a null text is empty; a text shorter than ``LENGTH`` bytes keeps all; a very long text is a batch of its
own and is held in one task (up to 256 MB; beyond, its windows may choose other anchors than their copies elsewhere); a
null ``doc_id`` comes before all others; rows that share a ``doc_id`` are separate, the earlier staged one first;
removal may cut a multi-byte character, so kept texts are binary; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exchange import (
    NO_ID, bits_of, bucket_bits, carried_columns, flag_answer, gather, rows_of, scatter, slices, text_batches,
    with_answers,
)
from .kernels import (
    BASE, BASE_INVERSE, U64, Block, exact_groups, mix, pack, powers, prefix_hashes, runs_to_mask, same_bytes,
    span_hashes, unpack,
)
from .staging import BROADCAST_IDS, read_table

LENGTH = 100
GRAM = 24
PLACE_BITS = 28
BATCH, BUCKET = 4 << 20, 4 << 20
SORT_AT_ONCE = 1 << 17
SINGLE, OPEN, CROWDED = 0, 1, 2
#: An anchor with more different stretches than this is split into single windows.
CROWD = 1024


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``values[i : i + width]`` for each i, by doubling."""
    have, out = 1, values
    while 2 * have <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        n = len(values) - width + 1
        out = np.minimum(out[:n], out[width - have : width - have + n])
    return out


class Stretches:
    """Runs of windows with the same anchor: ``low .. high`` are their first and last window starts."""

    def __init__(self, block: Block, length: int, gram: int):
        found = []
        for text, byte, part in block.parts():
            low, high, anchor, owner, key, whole = _stretches(part, length, gram)
            found.append((low + byte, high + byte, anchor + byte, owner + text, key, whole))
        none = np.zeros(0, np.int64)
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] or [none] * 4 + [none.astype(U64)] * 2
        self.low, self.high, self.anchor, self.owner, self.key, self.whole = columns


def _stretches(block: Block, length: int, gram: int) -> tuple[np.ndarray, ...]:
    data, bounds = block.data, block.bounds
    n = len(data) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(U64), none.astype(U64)
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = mix(span_hashes(prefix, at, at + gram))
    # the same number of hash bits in every batch, so that equal windows choose alike
    place_bits = U64(max(PLACE_BITS, len(grams).bit_length()))
    marked = (grams >> place_bits << place_bits) | at.astype(U64)
    least = sliding_least(marked, length - gram + 1)
    anchor = (least & ((U64(1) << place_bits) - U64(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(block.lengths)), block.lengths)
    inside = owner[:n] == owner[length - 1 :]
    cut = np.ones(n, bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:n] != owner[: n - 1])
    cut &= inside
    low = np.flatnonzero(cut)
    # the last window of a run: the next run's first less one, but never past the text's last window
    high = np.minimum(np.append(low[1:], n) - 1, bounds[owner[low] + 1] - length)
    anchor, owner = anchor[low], owner[low]
    key = mix(grams[anchor])  # the smallest hashes of windows are all small: spread them again
    shape = (anchor - low).astype(U64) << U64(32) | (high - low).astype(U64)
    whole = mix(span_hashes(prefix, low, high + length) ^ mix(shape) ^ key)
    return low, high, anchor, owner, key, whole


class Distinct:
    """The distinct stretches of a batch by (anchor, whole stretch), ascending, and the first of each."""

    def __init__(self, found: Stretches, data: np.ndarray, length: int):
        order = np.lexsort((np.arange(len(found.key)), found.whole, found.key))
        key, whole = found.key[order], found.whole[order]
        same = (key[1:] == key[:-1]) & (whole[1:] == whole[:-1])
        size = found.high - found.low + length

        def equal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            alike = (size[x] == size[y]) & (found.anchor[x] - found.low[x] == found.anchor[y] - found.low[y])
            alike[alike] = same_bytes(data, found.low[x[alike]], found.low[y[alike]], size[x[alike]])
            return alike

        def content(i: int) -> bytes:
            return int(found.anchor[i] - found.low[i]).to_bytes(8, "little") + data[found.low[i] : found.low[i] + size[i]].tobytes()

        order, new = exact_groups(order, same, equal, content)
        self.first = order[new]
        self.key, self.whole = found.key[self.first], found.whole[self.first]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1


def decide_stretches(numbers: np.ndarray, payloads: list[bytes]) -> list[bytes]:
    """Bucket step: does a batch's stretch have an anchor of its own, one to compare by text, or a crowded one."""
    parts = [unpack(p) for p in payloads]
    sizes = np.array([len(p[0]) for p in parts])
    key, whole = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.lexsort((whole, key))
    k, w = key[order], whole[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    other = new.copy()
    other[1:] |= w[1:] != w[:-1]
    group = np.cumsum(new) - 1
    kinds, entries = (np.bincount(group, weights=x) if len(k) else np.zeros(0) for x in (other, None))
    status = np.empty(len(k), np.uint8)
    status[order] = np.where(kinds > CROWD, CROWDED, np.where(entries > 1, OPEN, SINGLE))[group] if len(k) else []
    return [pack(x) for x in np.split(status, np.cumsum(sizes)[:-1])]


class Suffixes:
    """Suffixes of a text made of stretches, each suffix taken for ``length`` bytes inside its stretch.

    ``local`` is each byte's place in its stretch: hashes restart there, so few powers are needed.
    """

    def __init__(self, text: np.ndarray, local: np.ndarray, length: int):
        self.text, self.length, self.local = np.append(text, np.uint8(0)), length, local
        most = int(local.max(initial=0)) + 1
        self.inverse = powers(BASE_INVERSE, most)
        self.prefix = np.zeros(len(text) + 1, U64)
        np.cumsum((text.astype(U64) + U64(1)) * powers(BASE, most)[local], out=self.prefix[1:])
        self.steps = [1 << i for i in range(int(length).bit_length() - 1, -1, -1)]

    def hashes(self, starts: np.ndarray, size: int) -> np.ndarray:
        return (self.prefix[starts + size] - self.prefix[starts]) * self.inverse[self.local[starts]]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Longest common extension of the suffixes at x and y, by binary search over prefix hashes."""
        done = np.zeros(len(x), np.int64)
        for step in self.steps:
            fits = np.flatnonzero(done + step <= self.length)
            equal = self.hashes(x[fits] + done[fits], step) == self.hashes(y[fits] + done[fits], step)
            done[fits[equal]] += step
        return done

    def order(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the suffix at x comes before, equals or follows the one at y."""
        done = self.common(x, y)
        a, b = self.text[x + done].astype(np.int16), self.text[y + done].astype(np.int16)
        return np.where(done >= self.length, 0, np.sign(a - b))

    def sorted(self, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Indices that sort ``starts`` as suffixes within each run of equal ``group`` (ascending); stable.

        Runs are merged bottom-up. A suffix's place in the merged run is its place in its own run plus
        the suffixes before it in the sibling run, found by binary search.
        """
        n = len(starts)
        index = np.arange(n)
        first = np.searchsorted(group, group, side="left")
        size = np.searchsorted(group, group, side="right") - first
        width = 1
        while width < size.max(initial=0):
            active = np.flatnonzero(size > width)
            place = active - first[active]
            left = place // width % 2 == 0
            run = place // width * width
            sibling = np.where(left, run + width, run - width)
            low = first[active] + np.minimum(sibling, size[active])
            high = first[active] + np.minimum(sibling + width, size[active])
            begin = low.copy()
            own = starts[index[active]]
            while (todo := np.flatnonzero(low < high)).size:
                mid = (low[todo] + high[todo]) // 2
                sign = self.order(starts[index[mid]], own[todo])
                before = np.where(left[todo], sign < 0, sign <= 0)
                low[todo] = np.where(before, mid + 1, low[todo])
                high[todo] = np.where(before, high[todo], mid)
            target = first[active] + np.where(left, run, sibling) + (place - run) + (low - begin)
            merged = index.copy()
            merged[target] = index[active]
            index, width = merged, 2 * width
        return index

    def equal_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Byte-by-byte comparison of ``length`` bytes, in blocks."""
        out = np.ones(len(x), bool)
        for lo in range(0, len(x), 1 << 14):
            a, b = x[lo : lo + (1 << 14), None], y[lo : lo + (1 << 14), None]
            span = np.arange(self.length)
            out[lo : lo + (1 << 14)] = (self.text[a + span] == self.text[b + span]).all(axis=1)
        return out

    def eights(self, starts: np.ndarray) -> np.ndarray:
        """The first eight bytes as one number that sorts alike."""
        out = np.zeros(len(starts), U64)
        for i in range(min(8, self.length)):
            out = out << U64(8) | self.text[starts + i].astype(U64)
        return out


def repeats_of(
    text: np.ndarray, local: np.ndarray, starts: np.ndarray, key: np.ndarray, rank: np.ndarray, length: int
) -> np.ndarray:
    """True for each suffix that equals, for ``length`` bytes, one of its ``key`` with a smaller ``rank``."""
    repeated = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return repeated
    suffixes = Suffixes(text, local, length)
    begin = suffixes.eights(starts)
    order = np.lexsort((rank, begin, key))
    same = (key[order[1:]] == key[order[:-1]]) & (begin[order[1:]] == begin[order[:-1]])
    # suffixes alone with their key and first bytes repeat nothing
    with_twin = np.append(same, False) | np.concatenate(([False], same))
    group = np.concatenate(([0], np.cumsum(~same)))[with_twin]
    order = order[with_twin]
    del begin, same, with_twin
    at = 0
    while at < len(order):  # whole groups, about SORT_AT_ONCE suffixes at a time
        to = int(np.searchsorted(group, group[min(at + SORT_AT_ONCE, len(order)) - 1], side="right"))
        _mark_repeats(suffixes, starts, order[at:to], group[at:to], rank, repeated)
        at = to
    return repeated


def _mark_repeats(
    suffixes: Suffixes, starts: np.ndarray, order: np.ndarray, group: np.ndarray, rank: np.ndarray, repeated: np.ndarray
) -> None:
    order = order[suffixes.sorted(starts[order], group)]
    # The sort is stable and began by rank: within a run of equals the first is the earliest.
    at = np.flatnonzero(group[1:] == group[:-1])
    x, y = starts[order[at]], starts[order[at + 1]]
    equal = suffixes.common(x, y) >= suffixes.length
    at, x, y = at[equal], x[equal], y[equal]
    true = suffixes.equal_bytes(x, y)
    repeated[order[at[true] + 1]] = True
    for g in np.unique(group[at[~true]]).tolist():  # two strings with one hash: compare this group by its bytes
        members = order[np.searchsorted(group, g, side="left") : np.searchsorted(group, g, side="right")]
        seen: dict[bytes, int] = {}
        for j in sorted(members.tolist(), key=lambda j: int(rank[j])):
            string = suffixes.text[starts[j] : starts[j] + suffixes.length].tobytes()
            repeated[j] = seen.setdefault(string, j) != j


def whole_repeats(text: np.ndarray, base: np.ndarray, span: np.ndarray, key: np.ndarray, offset: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which stretches equal, as a whole and byte by byte, one of the same anchor with a smaller ``rank``."""
    whole = span_hashes(prefix_hashes(text), base, base + span)
    order = np.lexsort((rank, whole, span, offset, key))
    x, y = order[1:], order[:-1]
    same = (key[x] == key[y]) & (offset[x] == offset[y]) & (span[x] == span[y]) & (whole[x] == whole[y])
    order, new = exact_groups(
        order, same, lambda x, y: same_bytes(text, base[x], base[y], span[x]), lambda i: text[base[i] : base[i] + span[i]].tobytes()
    )
    out = np.zeros(len(order), bool)
    out[order[~new]] = True
    return out


def sort_stretches(parts: list[list[np.ndarray]], numbers: np.ndarray, length: int) -> list[np.ndarray]:
    """Suffix-sort open stretches; a flag for each of their windows, by batch."""
    sizes = np.array([len(p[0]) for p in parts])
    key, doc, low, count, offset = (np.concatenate([p[i] for p in parts]) for i in range(5))
    text = np.concatenate([p[5] for p in parts])
    count, offset = count.astype(np.int64), offset.astype(np.int64)
    # order of stretches; windows within one ascend
    order = np.lexsort((np.repeat(numbers, sizes), low, doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    span = count + length - 1
    base = np.cumsum(span) - span
    whole = whole_repeats(text, base, span, key, offset, rank)
    found = np.repeat(whole, count)
    left = np.flatnonzero(~whole)
    stretch = np.repeat(left, count[left])
    inside = np.arange(len(stretch)) - np.repeat(np.cumsum(count[left]) - count[left], count[left])
    local = np.arange(len(text)) - np.repeat(base, span)
    # windows that meet in one suffix group hold the anchor at the same place
    kind = mix(key[stretch] ^ mix(offset[stretch].astype(U64) - inside.astype(U64)))
    found[~found] = repeats_of(text, local, base[stretch] + inside, kind, rank[stretch] << np.int64(16) | inside, length)
    return np.split(found, np.cumsum([int(p[3].sum()) for p in parts])[:-1])


def sort_windows(parts: list[list[np.ndarray]], numbers: np.ndarray, length: int) -> list[np.ndarray]:
    """Suffix-sort single windows of ``length`` bytes by their hash; a flag for each, by batch."""
    sizes = np.array([len(p[0]) for p in parts])
    key, doc, start = (np.concatenate([p[i] for p in parts]) for i in range(3))
    text = np.concatenate([p[3] for p in parts])
    order = np.lexsort((np.repeat(numbers, sizes), start, doc))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    found = repeats_of(text, np.arange(len(text)) % length, np.arange(len(key)) * length, key, rank, length)
    return np.split(found, np.cumsum(sizes)[:-1])


def several(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Which of the batches' window hashes stand in several batches."""
    keys = np.concatenate([p[0] for p in parts])
    _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    return np.split(times[at] > 1, np.cumsum([len(p[0]) for p in parts])[:-1])


def stretches_or_hashes(length: int):
    """Bucket step for the two kinds of payload; a bucket holds one kind."""

    def step(numbers: np.ndarray, payloads: list[bytes]) -> list[bytes]:
        parts = [unpack(p) for p in payloads]
        found = sort_stretches(parts, numbers, length) if len(parts[0]) > 1 else several(parts)
        return [flag_answer(f) for f in found]

    return step


def windows_step(length: int):
    def step(numbers: np.ndarray, payloads: list[bytes]) -> list[bytes]:
        return [flag_answer(f) for f in sort_windows([unpack(p) for p in payloads], numbers, length)]

    return step


def window_hashes(block: Block, starts: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` bytes at each of the ascending ``starts``."""
    found = [np.zeros(0, U64)]
    for _, byte, part in block.parts():
        lo, hi = np.searchsorted(starts, [byte, byte + len(part.data)])
        at = starts[lo:hi] - byte
        found.append(mix(span_hashes(prefix_hashes(part.data), at, at + length)))
    return np.concatenate(found)


class Windows:
    """The distinct windows at the ascending ``starts``, compared byte by byte, and the first of each."""

    def __init__(self, block: Block, starts: np.ndarray, length: int):
        hashes = window_hashes(block, starts, length)
        order = np.argsort(hashes, kind="stable")
        same = hashes[order[1:]] == hashes[order[:-1]]
        order, new = exact_groups(
            order,
            same,
            lambda x, y: same_bytes(block.data, starts[x], starts[y], np.full(len(x), length)),
            lambda i: block.data[starts[i] : starts[i] + length].tobytes(),
        )
        self.starts, self.first = starts, order[new]
        self.keys = hashes[self.first]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1

    def repeats(self, lost: np.ndarray) -> np.ndarray:
        """Starts of repeated windows; ``lost`` are the distinct ones that stood elsewhere before."""
        again = np.ones(len(self.group), bool)
        again[self.first] = False
        gone = np.zeros(len(self.keys), bool)
        gone[lost] = True
        return self.starts[again | gone[self.group]]


class Marks:
    """The stretches of a batch and what the first step said of each distinct one."""

    def __init__(self, block: Block, answers: list[bytes], length: int, gram: int):
        self.found = Stretches(block, length, gram)
        self.distinct = Distinct(self.found, block.data, length)
        parts = [unpack(x)[0] for x in answers]
        self.status = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        if len(self.status) != len(self.distinct.first):
            raise ValueError("answers do not fit the batch")
        self.open = np.flatnonzero(self.status == OPEN)
        # windows of crowded anchors, ascending
        at = self.distinct.first[self.status == CROWDED]
        count = self.found.high[at] - self.found.low[at] + 1
        low = self.found.low[at] - (np.cumsum(count) - count)
        self.crowded = Windows(block, np.sort(np.arange(int(count.sum())) + np.repeat(low, count)), length)

    def open_windows(self, length: int) -> int:
        at = self.distinct.first[self.open]
        return int((self.found.high[at] - self.found.low[at] + 1).sum())

    def answers(self, given: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Flags of the windows of open stretches, and of the crowded windows' hashes (in several batches)."""
        flags = bits_of(given, 1, self.open_windows(length) + len(self.crowded.keys))
        return flags[: self.open_windows(length)], flags[self.open_windows(length) :]


def remove_repeated_bytes(
    docs: DataFrame,
    length: int = LENGTH,
    gram: int = GRAM,
    whole_characters: bool = False,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id, n_bytes, kept, spans``: remaining bytes, and the maximal removed runs as (start, length).

    With ``whole_characters``, the remaining bytes of a character that lost some go as well. ``carry`` names
    columns of ``docs`` that each row keeps.
    """
    batches = text_batches(docs, BATCH, carry)
    bits = bucket_bits(batches, BUCKET)

    def deal(ids: np.ndarray, block: Block) -> Iterator[tuple[int, bytes]]:
        kinds = Distinct(Stretches(block, length, gram), block.data, length)
        for bucket, part in slices(kinds.key, bits):
            yield bucket, pack(kinds.key[part], kinds.whole[part])

    def compare(ids: np.ndarray, block: Block, status: list[bytes]) -> Iterator[tuple[int, bytes]]:
        marks = Marks(block, status, length, gram)
        found, kinds = marks.found, marks.distinct
        for bucket, part in slices(kinds.key[marks.open], bits):
            rows = marks.open[part]
            at = kinds.first[rows]
            low, count = found.low[at], found.high[at] - found.low[at] + 1
            span = count + length - 1
            flat = np.arange(int(span.sum())) + np.repeat(low - (np.cumsum(span) - span), span)
            yield bucket, pack(
                kinds.key[rows], ids[found.owner[at]], (low - block.bounds[found.owner[at]]).astype(np.uint32),
                count.astype(np.uint16), (found.anchor[at] - low).astype(np.uint16), block.data[flat],
            )
        for bucket, part in slices(marks.crowded.keys, bits):
            yield bucket + (1 << bits), pack(marks.crowded.keys[part])

    def verify(ids: np.ndarray, block: Block, status: list[bytes], compared: list[bytes]) -> Iterator[tuple[int, bytes]]:
        marks = Marks(block, status, length, gram)
        windows = marks.crowded
        _, met = marks.answers(compared, length)
        chosen = np.flatnonzero(met)
        for bucket, part in slices(windows.keys[chosen], bits):
            at = windows.starts[windows.first[chosen[part]]]
            owner = np.searchsorted(block.bounds, at, side="right") - 1
            yield bucket, pack(
                windows.keys[chosen[part]], ids[owner], (at - block.bounds[owner]).astype(np.uint32),
                block.data[(at[:, None] + np.arange(length)).ravel()],
            )

    def keep(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in arrow:
            for _, ids, block, (status, compared, verified, *carried) in rows_of(part):
                marks = Marks(block, status, length, gram)
                out = _kept(ids, block, marks, compared, verified, length, whole_characters)
                for name, column in (carried_columns(carried[0]) if carry else {}).items():
                    out = out.append_column(name, column)
                yield out

    status = gather(scatter(batches.select("batch", "content"), deal), decide_stretches, "suffix-status")
    compared = gather(scatter(with_answers(batches, status), compare), stretches_or_hashes(length), "suffix-windows")
    # only batches with windows of crowded anchors have bytes to verify
    crowded = compared.where(F.col("bucket") >= 1 << bits).select("batch").distinct()
    sent = with_answers(batches.join(F.broadcast(crowded) if crowded.count() < BROADCAST_IDS else crowded, "batch", "left_semi"), status, compared)
    verified = gather(scatter(sent, verify), windows_step(length), "suffix-verified")
    further = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return with_answers(batches, status, compared, verified, carry=bool(carry)).mapInArrow(
        keep, f"doc_id long, n_bytes long, kept binary, spans array<struct<start:long,length:long>>{further}"
    )


def whole_characters_of(data: np.ndarray, gone: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """``gone``, with all bytes of each UTF-8 character that has lost some."""
    if not len(data):
        return gone
    lead = (data & 0xC0) != 0x80
    lead[bounds[bounds < len(data)]] = True
    character = np.cumsum(lead) - 1
    damaged = np.zeros(int(character[-1]) + 1, bool)
    damaged[character[gone]] = True
    return damaged[character]


def _kept(
    ids: np.ndarray, block: Block, marks: Marks, compared: list[bytes], verified: list[bytes], length: int, whole: bool
) -> pa.RecordBatch:
    found, kinds = marks.found, marks.distinct
    n = len(block.data)
    # all windows of a stretch that is not the first of its kind
    again = np.ones(len(found.low), bool)
    again[kinds.first] = False
    low, high = found.low[again], found.high[again]
    # single windows of open stretches
    flags, met = marks.answers(compared, length)
    at = kinds.first[marks.open]
    count = found.high[at] - found.low[at] + 1
    starts = np.arange(int(count.sum())) + np.repeat(found.low[at] - (np.cumsum(count) - count), count)
    chosen = np.flatnonzero(met)
    lost = chosen[bits_of(verified, 1, len(chosen))]
    single = np.concatenate((starts[flags], marks.crowded.repeats(lost)))
    gone = runs_to_mask(np.concatenate((low, single)), np.concatenate((high, single)) + length, n)
    if whole:
        gone = whole_characters_of(block.data, gone, block.bounds)
    owner = np.repeat(np.arange(len(block.lengths)), block.lengths)
    begin = gone.copy()
    begin[1:] &= ~(gone[:-1] & (owner[1:] == owner[:-1]))
    runs = np.flatnonzero(begin)
    stop = np.append(np.flatnonzero(~gone), n)
    ends = np.minimum(stop[np.searchsorted(stop, runs)], block.bounds[owner[runs] + 1])
    left = np.bincount(owner[~gone], minlength=len(block.lengths)) if n else np.zeros(len(block.lengths), np.int64)
    to = np.cumsum(left)
    data = block.data[~gone].tobytes()
    texts = [data[b - k : b] for b, k in zip(to.tolist(), left.tolist(), strict=True)]
    spans: list[list] = [[] for _ in block.lengths]
    for o, s, e in zip(owner[runs].tolist(), runs.tolist(), ends.tolist(), strict=True):
        spans[o].append({"start": s - int(block.bounds[o]), "length": e - s})
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64(), mask=ids == NO_ID),
            pa.array(block.lengths, pa.int64()),
            pa.array(texts, pa.binary()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
        ],
        ["doc_id", "n_bytes", "kept", "spans"],
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return out.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
