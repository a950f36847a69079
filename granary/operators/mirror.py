"""A mirror of chunks with what is built from them: only what a change touches is built again.

``chunks`` (``chunk_id, hash, ...``) are the source of ``mentions`` (``entity, chunk_id, ...``), of which ``entities`` are
built, of which ``pages`` (by ``links``: ``page, entity``) are built. A sync compares chunk hashes, follows new, changed
and deleted chunks to their entities and pages, builds those again, and commits all tables as one version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.sources.staging import release, staged
from granary.sources.versions import VersionedTables

Build = Callable[[DataFrame], DataFrame]


def delta(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """``chunk_id, change`` (added, updated, deleted) by hash."""
    if old is None:
        return new.select("chunk_id", F.lit("added").alias("change"))
    a, b = old.select("chunk_id", F.col("hash").alias("_old")), new.select("chunk_id", F.col("hash").alias("_new"))
    a, b = a.withColumn("_was", F.lit(True)), b.withColumn("_is", F.lit(True))
    both = a.join(b, "chunk_id", "full_outer")
    change = F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted")
    change = change.when(~F.col("_old").eqNullSafe(F.col("_new")), "updated")
    return both.select("chunk_id", change.alias("change")).where("change IS NOT NULL")


def patched(old: DataFrame | None, touched: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows of untouched keys, and the new rows."""
    return new if old is None else old.join(touched, key, "left_anti").unionByName(new.select(*old.columns))


@dataclass
class Mirror:
    """``extract``: mentions of chunks; ``build_entities``: entities of their mentions; ``build_pages``: pages of (page, entity rows)."""

    tables: VersionedTables
    extract: Build
    build_entities: Build
    build_pages: Build

    def sync(self, chunks: DataFrame, links: DataFrame, check=None) -> dict[str, int]:
        """Bring the mirror to the state of ``chunks`` and ``links``; counts of what was touched. Nothing to do: no version."""
        old = {n: self.tables.read(n) for n in ("chunks", "mentions", "links", "entities", "pages")}
        changed = staged(delta(old["chunks"], chunks), "mirror-delta")
        counts = {r["change"]: r["n"] for r in changed.groupBy("change").agg(F.count("*").alias("n")).collect()}
        keys = changed.select("chunk_id")
        fresh = staged(self.extract(chunks.join(changed.where("change <> 'deleted'").select("chunk_id"), "chunk_id", "left_semi")), "mirror-mentions")
        touched = fresh.select("entity")
        if old["mentions"] is not None:
            touched = touched.union(old["mentions"].join(keys, "chunk_id", "left_semi").select("entity"))
        touched = staged(touched.distinct(), "mirror-entities")
        mentions = staged(patched(old["mentions"], keys, fresh, "chunk_id"), "mirror-all-mentions")
        rebuilt = self.build_entities(mentions.join(touched, "entity", "left_semi"))
        entities = staged(patched(old["entities"], touched, rebuilt, "entity"), "mirror-all-entities")
        pages = links.join(touched, "entity", "left_semi").select("page")
        if old["links"] is not None:  # pages that gained or lost a link, or had one to a touched entity
            moved = links.exceptAll(old["links"]).union(old["links"].exceptAll(links))
            pages = pages.union(moved.select("page")).union(old["links"].join(touched, "entity", "left_semi").select("page"))
        pages = staged(pages.distinct(), "mirror-pages")
        counts |= {"entities": touched.count(), "pages": pages.count()}
        if any(counts.values()):
            built = self.build_pages(links.join(pages, "page", "left_semi").join(entities, "entity"))
            result = {
                "chunks": patched(old["chunks"], keys, chunks.join(keys, "chunk_id", "left_semi"), "chunk_id"),
                "mentions": mentions,
                "links": links,
                "entities": entities,
                "pages": patched(old["pages"], pages, built, "page"),
            }
            self.tables.write(result, {k: int(v) for k, v in counts.items()}, check)
        release(changed, fresh, touched, mentions, entities, pages)
        return counts
