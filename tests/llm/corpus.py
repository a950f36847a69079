"""Small corpora with planted repeats, and plain Python versions of the operators' contracts."""

from __future__ import annotations

import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept string, batch string, bucket int"


def words_of(text: str | None, lower: bool = False) -> list[str]:
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORD.findall(text)


def first_of(ids):
    """Order of documents: a null id comes first."""
    return lambda row: (row[0] is not None, row[0] or 0)


def corpus(seed: int = 7, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Unique ids, shuffled; copies, near copies, shared passages, long, empty, blank and null texts."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefghijklmnop") for _ in range(draw.randint(1, 7))) for _ in range(400)]
    vocabulary += ["ß", "日本", "🙂x", "É", "Über", "A", "Zed.", "|", "#tag", "a b"]

    def prose(k: int) -> str:
        out = []
        for i in range(k):
            out.append(draw.choice(vocabulary))
            out.append(draw.choice([" ", " ", " ", " ", "  ", "\n", "\t", ".\n", "\u000b"]))
        return "".join(out)

    passages = [prose(k) for k in (12, 19, 20, 21, 35, 80)]
    texts: list[str | None] = [None, "", "   \n\t", "one", "one two", "a" * 250, "ab" * 300, " ".join(["same"] * 90)]
    texts.append(prose(9000))  # very long
    while len(texts) < n:
        kind = draw.random()
        if kind < 0.15 and len(texts) > 12:
            texts.append(draw.choice(texts))
        elif kind < 0.35 and len(texts) > 12:
            own = (draw.choice(texts) or "").split(" ")
            for _ in range(draw.randint(1, 4)):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            texts.append(" ".join(own))
        elif kind < 0.7:
            texts.append(prose(draw.randint(5, 60)) + draw.choice(passages) + prose(draw.randint(0, 40)))
        else:
            texts.append(prose(draw.randint(1, 120)))
    ids: list[int | None] = list(range(-3, len(texts) - 4)) + [None]
    draw.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def frame(spark, rows, parts: int = 5):
    """With further columns, some of which bear names that the operators use."""
    full = [(i, t, "en", f"s{(i or 0) % 3}" if i is not None else None, len(t or ""), 1, "x", "y", 2) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def repeated_windows(rows, items_of, width: int) -> dict:
    """For each id, which items a window covers that also starts earlier."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=first_of(rows)):
        items = items_of(text)
        gone = [False] * len(items)
        for i in range(len(items) - width + 1):
            w = tuple(items[i : i + width]) if isinstance(items, list) else items[i : i + width]
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        out[doc] = gone
    return out


def runs(gone: list[bool]) -> int:
    return sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))


def shingles(text: str | None, width: int) -> frozenset:
    w = words_of(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def components(rows, width: int, share: int = 85) -> dict:
    """Smallest id reachable over links of at least ``share`` percent."""
    ids = [d for d, _ in rows if d is not None]
    sets = {d: shingles(t, width) for d, t in rows if d is not None}
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= share * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in ids}


def base_measures(text: str | None) -> dict:
    text = text or ""
    w = words_of(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    often = Counter(grams)
    gone = [False] * len(w)
    for i, g in enumerate(grams):
        if often[g] > 1:
            gone[i : i + 8] = [True] * 8
    return {
        "n_words": len(w),
        "word_chars": sum(map(len, w)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": sum(gone),
        "base_failed": len(w) < 20 or 100 * sum(gone) > 30 * len(w),
    }
