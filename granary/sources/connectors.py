"""Connectors as Python data sources: a listing is cheap, each changed file is read by a task of its own.

``granary_files`` lists a folder below ``path``; rows are ``id, size, fingerprint, content``. The option ``known`` names
fingerprints (``id=fingerprint`` lines) whose files are listed but not read: their content is null.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "id string, size long, fingerprint string, content binary"


class FilePart(InputPartition):
    def __init__(self, files: list[tuple[str, int, str]]):
        self.files = files


class FilesReader(DataSourceReader):
    """Files dealt to partitions of about 64 MB."""

    def __init__(self, options: dict):
        self.root = Path(options["path"])
        self.known = dict(line.split("=", 1) for line in options.get("known", "").splitlines() if "=" in line)
        self.part_bytes = int(options.get("partBytes", 64 << 20))

    def listing(self) -> list[tuple[str, int, str]]:
        found = []
        for file in sorted(p for p in self.root.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))):
            stat = file.stat()
            token = hashlib.sha256(f"{stat.st_size}:{stat.st_mtime_ns}".encode()).hexdigest()[:16]
            found.append((str(file.relative_to(self.root)), stat.st_size, token))
        return found

    def partitions(self) -> list[FilePart]:
        parts, held, size = [], [], 0
        for file in self.listing():
            if held and size + file[1] > self.part_bytes:
                parts.append(FilePart(held))
                held, size = [], 0
            held.append(file)
            size += file[1]
        return [*parts, FilePart(held)] if held else parts or [FilePart([])]

    def read(self, partition: FilePart):
        for name, size, token in partition.files:
            same = self.known.get(name) == token
            yield name, size, token, None if same else (self.root / name).read_bytes()


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "granary_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:
        return FilesReader(self.options)


def files(spark: SparkSession, path: str, known: dict[str, str] | None = None) -> DataFrame:
    """The files below ``path``; those with a known fingerprint have no content."""
    spark.dataSource.register(FilesSource)
    listed = "\n".join(f"{k}={v}" for k, v in (known or {}).items())
    return spark.read.format("granary_files").option("path", path).option("known", listed).load()


def binary_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``id, size, content`` by Spark's own reader, which takes any file system."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select(F.regexp_extract("path", "([^/]+)$", 1).alias("id"), F.col("length").alias("size"), "content")


def jdbc(spark: SparkSession, url: str, sql: str, most: int, **options: str) -> DataFrame:
    """At most ``most`` rows of a statement that an external database runs."""
    reader = spark.read.format("jdbc").option("url", url).option("query", sql).options(**options)
    return reader.load().limit(most)


def save_snapshot(df: DataFrame, path: str) -> None:
    """An index as JSON lines."""
    df.write.mode("overwrite").json(path)


def load_snapshot(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the schema, and the raw text of those that do not."""
    raw = spark.read.text(path)
    rows = raw.select("value", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = rows.where("r IS NOT NULL AND r._corrupt IS NULL").select("r.*").drop("_corrupt")
    return good, rows.where("r IS NULL OR r._corrupt IS NOT NULL").select("value")


def write_reports(df: DataFrame, key: str, title: str, body: str, kind: str, path: str) -> None:
    """One document a row as txt, md or html text, in files by Spark's writer."""
    from granary.functions import text as T

    head, text = F.col(title), F.col(body)
    if kind == "md":
        out = F.concat(F.lit("# "), head, F.lit("\n\n"), text)
    elif kind == "html":
        inside = F.replace(T.html_escape(text), F.lit("\n"), F.lit("<br>"))
        out = F.concat(F.lit("<!DOCTYPE html><html><head><title>"), T.html_escape(head), F.lit("</title></head><body><p>"), inside, F.lit("</p></body></html>"))
    elif kind == "txt":
        out = F.concat(head, F.lit("\n\n"), text)
    else:
        raise ValueError(f"no writer for {kind}")
    df.select(out.alias("value"), F.col(key).cast("string").alias("id")).write.mode("overwrite").option("lineSep", "\u001e").partitionBy("id").text(path)
