"""Outline chunks against a stack, a tree and a plain merge in Python."""

from __future__ import annotations

import random
import re

import pytest

from granary.operators import outline as O

LEAD = [
    ["第一部分 ", "第二章 ", "第3节 ", "第十条 ", "（一）"],
    ["第1章 ", "第2节 ", "3、", "1.2 ", "1.2.3", "1.2.3.4"],
    ["第一章 ", "第二节 ", "三、", "（四）", "(5)"],
    ["PART ONE ", "Chapter IV ", "Section 3", "Article 9 "],
    ["# a", "## b", "### c", "#### d", "##### e", "###### f"],
]


def texts(seed, n=40):
    draw, out = random.Random(seed), {}
    for i in range(n):
        family, lines = draw.randrange(6), []
        for _ in range(draw.randint(1, 25)):
            word = "".join(draw.choices("abcdef ", k=draw.randint(1, 60))).strip() or "x"
            lead = draw.choice(LEAD[family]) if family < 5 and draw.random() < 0.4 else ""
            lines.append((draw.choice(["", " ", "  "]) + lead + word, draw.choice(["", "", "", "title"])))
        lines += [("7", ""), ("x", ""), ("12 ", "title")]
        out[i] = lines
    return out


def first_match(line, family):
    return next((j for j, p in enumerate(O.FAMILIES[family]) if re.match(p, line)), None)


def family_of(lines):
    best, most = -1, 0
    for f in range(len(O.FAMILIES)):
        hits = sum(first_match(t.strip(), f) is not None and not re.match(O.NO_BULLET, t.strip()) for t, _ in lines)
        if hits > most:
            best, most = f, hits
    return best


def is_title(text, layout):
    text = text.split("@")[0]
    if "title" not in layout and "head" not in layout:
        return False
    long = len(text.split()) > 12 or (" " not in text and len(text) >= 32)
    return not (long or re.search(O.SENTENCE, text)) or bool(re.match(O.ARTICLE, text))


def level(text, layout, family, careful=False):
    size = len(O.FAMILIES[family]) if family >= 0 else 0
    found = first_match(text.strip(), family) if family >= 0 else None
    if found is not None and not (careful and re.match(O.NO_BULLET, text)):
        return found
    return size if family >= 0 and is_title(text, layout) else size + 1


def kept(lines):
    return [(i, t, y) for i, (t, y) in enumerate(lines) if len(t.strip()) > 1 and not re.fullmatch("[0-9]*", t.strip())]


def plain_sections(lines):
    family = family_of(lines)
    levels = [level(t, y, family, True) for t, y in lines]
    size = len(O.FAMILIES[family]) if family >= 0 else 0
    some = [x for x in levels if x <= size and family >= 0]
    most = min(set(some), key=lambda x: (-some.count(x), x)) if some else size + 1
    out = []
    for i, (t, _) in enumerate(lines):
        if not i or (levels[i] <= most and levels[i] != levels[i - 1]):
            out.append([])
        out[-1].append(t)
    return ["\n".join(x) for x in out]


def plain_tree(lines, depth):
    family = family_of(lines)
    if family < 0:
        return [t for t, _ in lines]
    size = len(O.FAMILIES[family])
    rows = [(level(t, y, family), t.strip()) for _, t, y in kept(lines)]
    levels = sorted({x for x, _ in rows})
    if not levels:
        return []
    target = levels[min(depth, len(levels)) - 1]
    if target == size + 1:
        target = levels[-2] if len(levels) > 1 else levels[0]
    root = {"level": -1, "texts": [], "kids": []}
    stack = [root]
    for x, t in rows:
        if x > target:
            stack[-1]["texts"].append(t)
            continue
        while len(stack) > 1 and x <= stack[-1]["level"]:
            stack.pop()
        node = {"level": x, "texts": [t], "kids": []}
        stack[-1]["kids"].append(node)
        stack.append(node)
    out = ["\n".join(root["texts"])] if root["texts"] else []

    def walk(node, above):
        path = above + node["texts"]
        if not node["kids"]:
            out.append("\n".join(path))
        for kid in node["kids"]:
            walk(kid, path)

    for kid in root["kids"]:
        walk(kid, [])
    return out


def plain_hierarchy(lines, depth):
    family = family_of(lines)
    if family < 0:
        return []
    size = len(O.FAMILIES[family])
    rows = kept(lines)
    groups = [[] for _ in range(size + 2)]
    for i, (_, t, y) in enumerate(rows):
        groups[size + 1 - level(t, y, family)].append(i)
    seen, chunks = set(), []
    for g in range(min(depth, size + 2)):
        for j in groups[g]:
            if j in seen:
                continue
            path = [j]
            if g != size:
                for upper in groups[g + 1 :]:
                    before = [i for i in upper if i < j]
                    if before:
                        if before[-1] > path[-1]:
                            path.pop()
                        path.append(before[-1])
            seen.update(path)
            chunks.append(path[::-1])
    out, n = [[]], 0
    for path in chunks:
        lines_of = [rows[i][1] for i in path]
        if len(path) == 1 and n + len(lines_of[0]) < O.SINGLES:
            out[-1] += lines_of
            n += len(lines_of[0])
        else:
            out.append(lines_of)
            n = len(lines_of[0]) if len(path) == 1 else O.SINGLES
    return ["\n".join(x) for x in out if x]


@pytest.fixture(scope="module")
def every():
    return {**texts(1), **{100 + k: v for k, v in texts(2).items()}}


@pytest.fixture(scope="module")
def lines(spark, every):
    rows = [(k, i, t, y, "z") for k, own in every.items() for i, (t, y) in enumerate(own)]
    return spark.createDataFrame(rows, "key long, pos int, text string, layout string, extra string").repartition(5).cache()


def found(df, order):
    out = {}
    for r in df.orderBy("key", order).collect():
        out.setdefault(r["key"], []).append(r["content"])
    return out


def test_sections(lines, every):
    assert found(O.section_groups(lines), "section") == {k: plain_sections(v) for k, v in every.items()}


@pytest.mark.parametrize("depth", [1, 2, 4, 9])
def test_tree(lines, every, depth):
    assert found(O.tree_chunks(lines, depth), "pos") == {k: x for k, v in every.items() if (x := plain_tree(v, depth))}


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_hierarchy(lines, every, depth):
    assert found(O.hierarchical_groups(lines, depth), "number") == {k: x for k, v in every.items() if (x := plain_hierarchy(v, depth))}


def test_no_lines(lines):
    none = lines.where("false")
    assert [f(none).count() for f in (O.section_groups, O.tree_chunks, O.hierarchical_groups)] == [0, 0, 0]


def test_lines_of(spark):
    docs = spark.createDataFrame([(1, "a\r\n\nb"), (2, None), (3, "")], "id long, t string")
    assert [(r["key"], r["pos"], r["text"]) for r in O.lines_of(docs, "id", "t").orderBy("pos").collect()] == [(1, 0, "a"), (1, 2, "b")]


def test_a_line_is_trimmed_once_for_all_patterns(spark):
    """Inside conditions Spark makes an expression anew wherever it is written."""
    lines = spark.createDataFrame([(1, 0, "PART ONE a", "")], "key long, pos int, text string, layout string")
    plan = O.levelled(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 3
