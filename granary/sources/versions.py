"""Tables that change together, as versions with one commit record.

A version's tables are written to folders of their own, then one small file names the folder of every table; creating
that file is the commit. Readers take the newest record, so they see all tables of one version or of the one before,
never a mixture. A write that fails leaves no record, and its folders are removed; two writers of one version cannot both
commit, as the record is only created where none is. Tables that a version leaves alone keep their old folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from granary.sources.staging import file_system, remove, short_lived_shuffles


class Conflict(Exception):
    """Another writer has committed this version."""


class VersionedTables:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[int]:
        files, place = file_system(self.spark, f"{self.root}/commits")
        if not files.exists(place):
            return []
        names = [s.getPath().getName() for s in files.listStatus(place)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def current(self) -> int:
        """Number of the newest version, 0 for none."""
        return (self.versions() or [0])[-1]

    def record(self, version: int | None = None) -> dict:
        version = self.current() if version is None else version
        if version == 0:
            return {"tables": {}, "notes": {}}
        return json.loads(self.spark.read.text(f"{self.root}/commits/{version}.json", wholetext=True).first()[0])

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        entry = self.record(version)["tables"].get(table)
        return self.spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{self.root}/{entry['folder']}") if entry else None

    def _commit(self, version: int, record: dict) -> None:
        """The record is written aside and renamed: it is there whole or not at all, and never replaces another."""
        from py4j.java_gateway import Py4JJavaError

        files, place = file_system(self.spark, f"{self.root}/commits/{version}.json")
        aside = file_system(self.spark, f"{self.root}/commits/.{version}-{uuid.uuid4().hex}")[1]
        out = files.create(aside, True)
        out.write(bytearray(json.dumps(record).encode()))
        out.close()
        try:
            done = not files.exists(place) and files.rename(aside, place)
        except Py4JJavaError:
            done = False
        if not done:
            files.delete(aside, False)
            raise Conflict(f"version {version} of {self.root} exists")

    def write(self, tables: dict[str, DataFrame], notes: dict | None = None, check: Callable[[VersionedTables, dict], None] | None = None) -> int:
        """Write the tables as the next version; others stay. ``check`` sees the written ones and may refuse them.

        Whatever fails, the new folders go and the current version stays what it was.
        """
        version = self.current() + 1
        record = {"tables": dict(self.record()["tables"]), "notes": notes or {}}
        written: list[str] = []
        try:
            for name, df in tables.items():
                folder = f"tables/{name}-{version}-{uuid.uuid4().hex[:8]}"
                written.append(folder)
                with short_lived_shuffles(self.spark):
                    df.write.parquet(f"{self.root}/{folder}")
                record["tables"][name] = {"folder": folder, "schema": df.schema.jsonValue()}
            if check:
                check(self, {n: self.spark.read.parquet(f"{self.root}/{record['tables'][n]['folder']}") for n in tables})
            self._commit(version, record)
        except BaseException:
            for folder in written:
                remove(self.spark, f"{self.root}/{folder}")
            raise
        return version

    def roll_back(self, version: int) -> int:
        """A new version with the tables of an old one; no table is copied."""
        old = self.record(version)
        number = self.current() + 1
        self._commit(number, {"tables": old["tables"], "notes": {"rolled_back_to": version}})
        return number

    def expire(self, keep: int = 2) -> None:
        """Forget all but the newest ``keep`` versions, and remove folders that none of these names."""
        versions = self.versions()
        held = {t["folder"] for v in versions[-keep:] for t in self.record(v)["tables"].values()}
        gone = {t["folder"] for v in versions[:-keep] for t in self.record(v)["tables"].values()} - held
        for version in versions[:-keep]:
            remove(self.spark, f"{self.root}/commits/{version}.json")
        for folder in gone:
            remove(self.spark, f"{self.root}/{folder}")
