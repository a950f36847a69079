"""Token ids by a public tokenizer of the ``tokenizers`` library, with each distinct word encoded once a worker.

Both tokenizers cut a text at single blanks between other characters before anything else, so the
ids of a text are the ids of its words in turn. A text in which that is not certain (blanks in a
row, a blank beside other white space) goes to the tokenizer whole.

A word of Latin letters, digits and ASCII signs is cut further, as the tokenizer's own pattern would cut it, and each
distinct piece goes once to the tokenizer's model; all other words go to the tokenizer itself.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_WORDS = 600_000
PIECES_AT_ONCE = 20_000
#: Characters that some Unicode versions count as white space.
ODD = "\x1c\x1d\x1e\x1f\x85\u180e\u200b\ufeff"
#: Letters that no normalisation changes but for their case.
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
PLAIN = re.compile(f"[!-~{LATIN}]+(?:\n[!-~{LATIN}]+)*")
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: How the two tokenizers cut such words (a blank belongs to the piece after it in the first); NUL parts words here.
BETWEEN = "\0"
WITH_BLANK = re.compile(f"{BETWEEN}|\n|{ENDINGS}| ?[{LATIN}]+| ?[0-9]+| ?[^\\s{BETWEEN}{LATIN}0-9]+")
WITHOUT_BLANK = re.compile(f"{BETWEEN}|{ENDINGS}|[{LATIN}]+|[0-9]|[^\\s{BETWEEN}{LATIN}0-9]+")


def unsure(word: str) -> bool:
    """Whether the text around such a part may not be cut at its blanks."""
    return not word or word[0].isspace() or word[-1].isspace() or word[0] in ODD or word[-1] in ODD or "<|" in word


class Store:
    """Runs of ids under strings, remembered in the order they came."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.starts, self.ids, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def add(self, names: list[str], lengths: np.ndarray, ids: np.ndarray) -> None:
        here = len(self.starts) - 1
        self.place.update(zip(names, range(here, here + len(names)), strict=True))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(lengths)))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def places(self, names: list[str]) -> np.ndarray:
        """Where each string stands, -1 for a new one."""
        return np.fromiter(map(self.place.get, names, repeat(-1)), np.int64, len(names))

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the strings at these places, and each one's number of ids."""
        first, lengths = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        flat = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + lengths, lengths)
        return self.ids[flat], lengths


class Words:
    """Ids of words, remembered."""

    def __init__(self, path: str, blank_belongs: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.blank_belongs = blank_belongs
        self.by_piece = Tokenizer(self.tokenizer.model)
        self.by_piece.pre_tokenizer = pre_tokenizers.Sequence(
            [
                pre_tokenizers.CharDelimiterSplit(BETWEEN),
                pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False),
            ]
        )
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(names.values()) + 1
        self.begins, self.ends = np.zeros(size, bool), np.zeros(size, bool)
        self.begins[[i for name, i in names.items() if name.startswith("\u0120")]] = True  # byte-level sign of a blank
        self.ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.words, self.firsts, self.pieces = Store(), Store(), Store()
        self.pieces.place[BETWEEN] = -2
        self.unsure = {id(self.words): np.zeros(0, bool), id(self.firsts): np.zeros(0, bool)}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_pieces(self, new: list[str]) -> None:
        """Pieces of one joined text, told apart by the tokens that begin or end a piece."""
        if self.blank_belongs:
            groups = [([p for p in new if p[0] == " "], BETWEEN), ([p for p in new if p[0] != " "], f"{BETWEEN} {BETWEEN}")]
        else:
            groups = [(new, BETWEEN)]
        for group, between in groups:
            for i in range(0, len(group), PIECES_AT_ONCE):
                part = group[i : i + PIECES_AT_ONCE]
                text = between.join(part)
                ids = np.array(self.by_piece.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                if not self.blank_belongs:
                    lengths = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
                elif between == BETWEEN:
                    lengths = np.diff(np.append(np.flatnonzero(self.begins[ids]), len(ids)))
                else:
                    lengths = np.diff(np.concatenate(([-1], np.flatnonzero(self.begins[ids]), [len(ids)]))) - 1
                    ids = ids[~self.begins[ids]]
                if len(lengths) != len(part) or int(lengths.sum()) != len(ids):
                    raise ValueError("a piece was cut")
                self.pieces.add(part, lengths, ids)

    def plain(self, words: list[str], lead: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words in turn, and each one's number of ids."""
        text = lead + (BETWEEN + lead).join(words) + BETWEEN
        flat = WITH_BLANK.findall(text) if self.blank_belongs else WITHOUT_BLANK.findall(text.lower())
        at = self.pieces.places(flat)
        if (missing := np.flatnonzero(at == -1)).size:
            self.learn_pieces(list(dict.fromkeys([flat[i] for i in missing.tolist()])))
            at = self.pieces.places(flat)
        stop = at == -2
        ids, lengths = self.pieces.of(at[~stop])
        sums = np.zeros(len(flat) + 1, np.int64)
        sums[1:][~stop] = lengths
        return ids, np.diff(np.cumsum(sums)[1:][stop], prepend=0)

    def learn(self, store: Store, words: list[str], lead: str) -> None:
        whole = PLAIN.fullmatch
        plain = [whole(w) is not None and "<|" not in w for w in words]
        easy = list(compress(words, plain))
        if easy:
            ids, lengths = self.plain(easy, lead)
            store.add(easy, lengths, ids)
            self.unsure[id(store)] = np.concatenate((self.unsure[id(store)], np.zeros(len(easy), bool)))
        rest = [w for w, p in zip(words, plain, strict=True) if not p]
        if not rest:
            return
        doubt = np.fromiter(map(unsure, rest), bool, len(rest))
        lengths = np.zeros(len(rest), np.int64)
        sure = [w for w, d in zip(rest, doubt.tolist(), strict=True) if not d]
        if lead:  # one text: a word starts at each token with a blank
            text = lead + lead.join(sure) if sure else ""
            new = np.array(self.encode([text])[0], np.uint32)
            at = np.append(np.flatnonzero(self.begins[new]), len(new))
            if len(at) != len(sure) + 1:
                raise ValueError("a word holds a blank")
            lengths[~doubt] = np.diff(at)
        else:
            found = self.encode(sure)
            lengths[~doubt] = np.fromiter(map(len, found), np.int64, len(found))
            new = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        store.add(rest, lengths, new)
        self.unsure[id(store)] = np.concatenate((self.unsure[id(store)], doubt))

    def of(self, store: Store, words: list[str], counts: np.ndarray, lead: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in turn; for each run of ``counts`` words, how many ids, and whether one is unsure."""
        at = store.places(words)
        if (missing := np.flatnonzero(at < 0)).size:
            self.learn(store, list(dict.fromkeys([words[i] for i in missing.tolist()])), lead)
            at[missing] = store.places([words[i] for i in missing.tolist()])
        ids, lengths = store.of(at)
        cuts = np.concatenate(([0], np.cumsum(counts)))
        ends = np.concatenate(([0], np.cumsum(lengths)))
        doubts = np.concatenate(([0], np.cumsum(self.unsure[id(store)][at])))
        return ids, np.diff(ends[cuts]), np.diff(doubts[cuts]) > 0


@lru_cache(maxsize=4)
def words_of(path: str, blank_belongs: bool) -> Words:
    return Words(path, blank_belongs)


def encode_texts(texts: list[str], path: str, blank_belongs: bool) -> list[np.ndarray]:
    """Ids of each text; ``blank_belongs`` if a word's token carries the blank before it."""
    memo = words_of(path, blank_belongs)
    if len(memo.words.place) > MEMO_WORDS:
        memo.forget()
    words: list[str] = []
    counts, firsts = [], []
    for text in texts:
        parts = text.split(" ")
        if blank_belongs:
            firsts.append(parts[0])
            del parts[0]
        words.extend(parts)
        counts.append(len(parts))
    flat, sizes, doubts = memo.of(memo.words, words, np.array(counts, np.int64), " " if blank_belongs else "")
    ends = np.cumsum(sizes)
    out = [flat[b - n : b] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    if blank_belongs:
        head, lengths, odd = memo.of(memo.firsts, firsts, np.ones(len(firsts), np.int64), "")
        doubts = doubts | odd
        heads = np.split(head, np.cumsum(lengths)[:-1]) if len(firsts) else []
        out = [np.concatenate(x) for x in zip(heads, out, strict=True)]
    for i, ids in zip(np.flatnonzero(doubts).tolist(), memo.encode(list(compress(texts, doubts.tolist()))), strict=True):
        out[i] = np.array(ids, np.uint32)
    return out


def encoded(
    batches: Iterator[pa.RecordBatch],
    path: str,
    blank_belongs: bool,
    end_id: int | None,
    limit: int = 1 << 20,
) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of the batches with the ids of their ``text`` (null: empty), ``end_id`` appended."""
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        sizes = np.cumsum(np.array(pc.binary_length(texts).fill_null(0), np.int64))
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
            found = encode_texts([x or "" for x in texts[at:to].to_pylist()], path, blank_belongs)
            yield batch.slice(at, to - at), [np.concatenate((x, tail)) for x in found]
            at = to
