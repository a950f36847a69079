"""Row-level changes of keyed tables: upsert, conditional update and delete, snapshots and drift."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``incoming`` replace those with the same keys; the rest stay."""
    return current.join(incoming.select(keys).distinct(), keys, "left_anti").unionByName(incoming)


def conditional_update(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def conditional_delete(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true (null keeps a row)."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """``key, state``: new, deleted, changed or unchanged, by one full outer join."""
    old = before.select(key, F.col(value).alias("_old"), F.lit(True).alias("_was"))
    new = after.select(key, F.col(value).alias("_new"), F.lit(True).alias("_is"))
    state = (
        F.when(F.col("_was").isNull(), "new")
        .when(F.col("_is").isNull(), "deleted")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("changed")
    )
    return old.join(new, key, "full_outer").select(key, state.alias("state"))


def drift(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Owners whose row counts differ between two stores."""
    a = left.groupBy(keys).agg(F.count("*").alias("left_count"))
    b = right.groupBy(keys).agg(F.count("*").alias("right_count"))
    both = a.join(b, keys, "full_outer").fillna(0, ["left_count", "right_count"])
    return both.where("left_count <> right_count")


def any_of(field: Column, wanted) -> Column:
    """Equality, or membership for a list."""
    return field.isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else field == F.lit(wanted)


def matches(condition: dict, arrays: frozenset[str] = frozenset()) -> Column:
    """All keys hold; a list means any of its values, on an array column any overlap; nothing wanted is true.

    ``available_int`` means 0 or not 0 with a missing value as available; ``must_not.exists`` names
    columns that have to be null; other falsy values are no condition.
    """
    parts = []
    for key, wanted in condition.items():
        if key == "available_int":
            off = F.coalesce(F.col(key).isin("0", "false"), F.lit(False))
            parts.append(off if str(wanted) == "0" else ~off)
        elif key == "must_not.exists":
            parts += [F.col(c).isNull() for c in ([wanted] if isinstance(wanted, str) else wanted)]
        elif wanted is None or wanted in ("", []):
            continue
        elif key in arrays:
            values = wanted if isinstance(wanted, (list, tuple)) else [wanted]
            parts.append(F.arrays_overlap(F.col(key), F.array(*[F.lit(v) for v in values])))
        else:
            parts.append(any_of(F.col(key), wanted))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def corrupt_split(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``is_valid``: whether the JSON text parses; a null is not valid."""
    return df.withColumn("is_valid", F.try_parse_json(F.col(raw)).isNotNull())


def row_documents(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One text a row: ``column: value`` lines, a null value empty."""
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return df.select(F.col(key).alias("doc_key"), F.concat_ws("\n", *lines).alias("content"))


def guarded_sql(spark, statement: str, rows: DataFrame, kb_ids: list[str]) -> DataFrame:
    """Run a statement over ``{chunks}``, the rows of the given knowledge bases only; no ids, no rows."""
    return spark.sql(statement, chunks=rows.where(F.col("kb_id").isin(*kb_ids) if kb_ids else F.lit(False)))
