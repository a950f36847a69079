"""Connectors and formats on files and literals."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from granary.functions import extension as Ext
from granary.sources import connectors as S
from granary.sources import formats as P


def test_files_with_known_fingerprints(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.txt").write_bytes(b"one")
    (tmp_path / "in" / "deep" / "b.bin").write_bytes(b"\x00two")
    (tmp_path / "in" / ".hidden").write_bytes(b"no")
    first = {r["id"]: r for r in S.files(spark, str(tmp_path / "in")).collect()}
    assert {k: bytes(r["content"]) for k, r in first.items()} == {"a.txt": b"one", "deep/b.bin": b"\x00two"}
    (tmp_path / "in" / "a.txt").write_bytes(b"three")
    again = {r["id"]: r for r in S.files(spark, str(tmp_path / "in"), {k: r["fingerprint"] for k, r in first.items()}).collect()}
    assert bytes(again["a.txt"]["content"]) == b"three" and again["deep/b.bin"]["content"] is None
    assert {r["id"] for r in S.binary_files(spark, str(tmp_path / "in"), "*.txt").collect()} == {"a.txt"}
    (tmp_path / "none").mkdir()
    assert S.files(spark, str(tmp_path / "none")).collect() == []


def test_snapshot_quarantine(spark, tmp_path):
    (tmp_path / "rows.json").write_text('{"a": 1, "b": "x"}\n{"a": 2\n{"a": "no", "b": "y"}\n')
    good, bad = S.load_snapshot(spark, str(tmp_path / "rows.json"), "a long, b string")
    assert [tuple(r) for r in good.collect()] == [(1, "x")]
    assert bad.count() == 2


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "T<", "a\nb")], "k int, t string, b string")
    for kind, want in (("txt", "T<\n\na\nb"), ("md", "# T<\n\na\nb"), ("html", "<title>T&lt;</title>")):
        S.write_reports(df, "k", "t", "b", kind, str(tmp_path / kind))
        text = "".join(p.read_text() for p in (tmp_path / kind).rglob("part-*"))
        assert want in text
    with pytest.raises(ValueError):
        S.write_reports(df, "k", "t", "b", "pdf", str(tmp_path / "x"))


def test_decoding(spark):
    raws = [b"\xef\xbb\xbfa\xc3\xa9", "aé".encode("utf-16-le"), b"\xff\xfe" + "aé".encode("utf-16-le"), b"\xfe\xff" + "aé".encode("utf-16-be"), b"a\xc3", b""]
    rows = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, r binary")
    got = {r["i"]: r["t"] for r in rows.select("i", P.decoded(F.col("r")).alias("t")).collect()}
    assert (got[0], got[2], got[3], got[4], got[5]) == ("aé", "aé", "aé", None, "")
    with pytest.raises(PySparkException):
        rows.select(P.checked(P.decoded(F.col("r")), F.col("i"))).collect()


@pytest.mark.parametrize(
    ("text", "lines"),
    [('{"a":1}\n{"a":2}', True), ('{"a":1}', False), ('{\n"a":1\n}', False), ("x\ny", False), ('{"a":1}\n' * 8 + "x\ny", True), ('{"a":1}\n' * 7 + "x\ny\nz", False), ("", False)],
)
def test_json_lines(spark, text, lines):
    assert spark.range(1).select(P.is_json_lines(F.lit(text)).alias("v")).first()["v"] is lines


def test_flatten(spark):
    raw = '{"a": {"b": [{"c": 1}, {"c": [1, 2]}], "e": []}, "t": true, "n": null, "o": {}}'
    rows = P.flattened(spark.createDataFrame([(1, raw), (2, "5"), (3, "no json {")], "k int, r string"), "k", "r").collect()
    got = {(r["k"], r["path"]): r["value"] for r in rows}
    assert got == {(1, "a.b[0].c"): "1", (1, "a.b[1].c"): "[1, 2]", (1, "a.e"): "[]", (1, "t"): "true", (1, "n"): "null", (2, ""): "5"}


def test_html_blocks_and_markdown(spark):
    html = "<h1>T &amp; x</h1><script>no</script><p>One <b>two</b></p><ul><li>a</li><li></li></ul><table><tr><td>c</td></tr></table></body>"
    md = "# H\ntext one\ntext two\n- a\n- b\n\n```\nx\n\n# y\n```\n> q\n1. n"
    row = spark.range(1).select(P.html_blocks(F.lit(html)).alias("h"), P.markdown_elements(F.lit(md)).alias("m")).first()
    assert [tuple(b) for b in row["h"]] == [("h1", "# T & x"), ("p", "One two"), ("li", "a"), ("td", "c")]
    assert [tuple(e) for e in row["m"]] == [
        ("header", "# H"), ("text", "text one\ntext two"), ("list", "- a\n- b"), ("code", "```\nx\n\n# y\n```"), ("quote", "> q"), ("list", "1. n"),
    ]


def test_extension_points(spark):
    rows = spark.createDataFrame([("a",), ("bb",)], "t string")
    with pytest.raises(PySparkException):
        rows.select(Ext.embedder(lambda texts: [[1.0]] * (len(texts) + 1))(F.col("t"))).collect()
    parse = Ext.parser(lambda raw, kind: {"ok": raw.decode()}[kind])
    got = rows.select(parse(F.encode("t", "UTF-8"), F.when(F.col("t") == "a", "ok").otherwise("no")).alias("v")).collect()
    assert [r["v"] for r in got] == ["a", None]


def test_staged_tables_can_be_released(spark):
    from granary.sources.staging import SHUFFLE_CLEANUP, release, staged

    before = spark.conf.get(SHUFFLE_CLEANUP)
    table = staged(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "few")
    assert table.count() == 7 and spark.conf.get(SHUFFLE_CLEANUP) == before
    assert Path(table._staged_at.removeprefix("file:")).exists()
    release(table)
    assert not Path(table._staged_at.removeprefix("file:")).exists()


def test_flattening_has_no_limit(spark):
    deep = '{"k": ' * 12 + '[{"z": 1}]' + "}" * 12
    nested = "[" + '{"a": [{"b": [{"c": [{"d": ' * 3 + "7" + "}]}]}]}" * 3 + "]"
    rows = {(r["k"], r["path"]): r["value"] for r in P.flattened(spark.createDataFrame([(1, deep), (2, nested), (3, None)], "k int, r string"), "k", "r").collect()}
    assert rows[1, ".".join(["k"] * 12) + "[0].z"] == "1"
    assert rows[2, "[0]" + ".a[0].b[0].c[0].d" * 3] == "7"
    assert len(rows) == 2


def merged(pieces):
    out = {}

    def into(a, b):
        for k, v in b.items():
            if isinstance(v, dict) and isinstance(a.get(k), dict):
                into(a[k], v)
            else:
                a[k] = v

    for p in pieces:
        into(out, json.loads(P.json_text(p)))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_json_pieces_hold_the_whole(seed):
    draw = random.Random(seed)

    def value(depth):
        kind = draw.random()
        if depth and kind < 0.5:
            return {f"k{i}": value(depth - 1) for i in range(draw.randint(1, 5))}
        if depth and kind < 0.7:
            return [value(depth - 1) for _ in range(draw.randint(1, 4))]
        return draw.choice([1, 2.5, None, True, "text", "long " * 30])

    whole = P.lists_as_maps({f"top{i}": value(12) for i in range(4)})
    pieces = P.json_pieces(whole, 300, 100)
    assert merged(pieces) == whole
    assert all(len(P.json_text(p)) >= 100 for p in pieces[:-1])
    assert all(len(P.json_text(p)) < 800 for p in pieces)


def test_json_chunks(spark):
    rows = [(1, '{"a": [1, 2], "b": {"c": "' + "x" * 60 + '"}}'), (2, "no json"), (3, None), (4, "5"), (5, "{}"), (6, "null")]
    found = [tuple(r) for r in P.json_chunks(spark.createDataFrame(rows, "k int, r string"), "k", "r", 50).collect()]
    assert found == [(1, 0, '{"a":{"0":1,"1":2},"b":{"c":"' + "x" * 60 + '"}}'), (4, 0, '{"":5}')]


ODD_JSON = [
    '{"a": 1, "a": 2}', '{"a": 1.50, "b": 1e3}', '{"a": 12345678901234567890123}', '[[1, 2], [3]]', '[{"a": 1}, null]', '[1, "x", {"b": 2}]', "NaN", "[]", "{}",
    '{"": {"": 1}}', '"\\ud800"', '"\\u00e9"', "\ufeff5", "5 6", "01", "-0", ' {"a" : [true, null, "x, y"] } ', '{"a": [{}, {"b": []}]}', "true", '"a\nb"', '{"a": "\x01"}', "[NaN]",
    "[" * 600 + "]" * 600, '{"k": ' * 40 + "1" + "}" * 40, "", " ", '{"a.b": {"c[0]": 1}}', "[1, 1.0]", '[true, "x"]', "[null]",
]


def test_texts_read_plainly_are_as_by_sparks_parser(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate([*ODD_JSON, *(f'{{"id": {i}, "x": [{{"y": "{i}"}}]}}' for i in range(50)), None])), "k int, r string")
    read = P.read_plainly(df, "k", "r")
    assert read.where("k >= " + str(len(ODD_JSON))).where("_rest IS NOT NULL").count() == 0  # no step a level for these
    assert 10 < read.where("_rest IS NOT NULL").count() < 20
    here = sorted(map(tuple, P.flattened(df, "k", "r").collect()))
    assert {(k, p, v) for k, p, v in here if k >= len(ODD_JSON)} == {(len(ODD_JSON) + i, p, str(i)) for i in range(50) for p in ("id", "x[0].y")}
    monkeypatch.setattr(P, "read_plainly", lambda df, key, text: df.where(f"{text} IS NOT NULL").selectExpr(key, "'' AS path", "'' AS value", f"CAST({text} AS BINARY) AS _rest"))
    assert sorted(map(tuple, P.flattened(df, "k", "r").collect())) == here
