"""Metadata of documents as a long table ``doc_id, key, value``, and the two predicate evaluators over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIASES = {"is": "=", "not is": "≠", ">=": "≥", "<=": "≤", "!=": "≠", "==": "="}
DATE = r"^\d{4}-\d{2}-\d{2}$"


def canonical(op: str) -> str:
    return ALIASES.get(op.strip().lower(), op.strip().lower())


def compared(value: Column, op: str, wanted: str) -> Column:
    """Ordering: as dates where the query is one (others never match), as numbers where both are, else as text."""
    if len(wanted) == 10 and wanted[4] == wanted[7] == "-" and wanted.replace("-", "").isdigit():
        left, right = F.when(value.rlike(DATE), value), F.lit(wanted)
    else:
        try:
            number = F.lit(float(wanted))
            mine = value.try_cast("double")
            text = _order(F.lower(value), op, F.lit(wanted.lower()))
            return F.when(mine.isNotNull(), _order(mine, op, number)).otherwise(text)
        except ValueError:
            left, right = F.lower(value), F.lit(wanted.lower())
    return _order(left, op, right)


def _order(left: Column, op: str, right: Column) -> Column:
    found = {"=": left == right, "≠": left != right, ">": left > right, "<": left < right, "≥": left >= right, "≤": left <= right}
    return found[op]


def value_matches(value: Column, op: str, wanted) -> Column:
    """The inverted-index evaluator on one value, case-insensitive."""
    op = canonical(op)
    low = F.lower(value)
    items = [str(w).strip().lower() for w in (wanted if isinstance(wanted, (list, tuple)) else str(wanted).split(","))]
    text = str(wanted).lower()
    simple = {
        "contains": lambda: low.contains(text),
        "not contains": lambda: ~low.contains(text),
        "in": lambda: low.isin(items),
        "not in": lambda: ~low.isin(items),
        "start with": lambda: low.startswith(text),
        "end with": lambda: low.endswith(text),
        "empty": lambda: low == "",
        "not empty": lambda: low != "",
    }
    return simple[op]() if op in simple else F.coalesce(compared(value, op, str(wanted)), F.lit(False))


def doc_ids(meta: DataFrame, key: str, op: str, wanted) -> DataFrame:
    """Documents that have the key and match; negations, too, see only those that have it."""
    return meta.where((F.col("key") == key) & value_matches(F.col("value"), op, wanted)).select("doc_id").distinct()


def filter_ids(meta: DataFrame, conditions: list[tuple], logic: str = "and") -> DataFrame:
    """Ids by all conditions (``and``) or any (any other logic)."""
    sets = [doc_ids(meta, *c) for c in conditions]
    if logic == "and":
        return reduce(lambda a, b: a.intersect(b), sets)
    return reduce(lambda a, b: a.union(b), sets).distinct()


def _each(op: str, wanted):
    return lambda value: F.coalesce(value_matches(value, op, wanted), F.lit(False))


def record_ids(meta: DataFrame, conditions: list[tuple], logic: str = "and") -> DataFrame:
    """The record evaluator: one row a document, compared with its key's first value; ``in`` needs all of its values.

    Values are in the order of a column ``ord`` where the table has one, else by value.
    """
    order = "ord" if "ord" in meta.columns else "value"
    values = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col("value").alias("v")))), lambda x: x["v"])
    lists = meta.groupBy("doc_id", "key").agg(values.alias("_v"))
    first = lists.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "_v"))).alias("m"))
    parts = []
    for key, op, wanted in conditions:
        held, op = F.try_element_at("m", F.lit(key)), canonical(op)
        if op in ("in", "not in"):
            found = F.forall(held, _each(op, wanted))
        else:
            found = value_matches(held[0], op, wanted)
        parts.append(F.coalesce(found, F.lit(False)))
    both = reduce((lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b), parts)
    return first.where(both).select("doc_id")


def manual(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """A manual filter without a match lets nothing through."""
    return docs.join(ids, "doc_id", "left_semi")


def summary(meta: DataFrame) -> DataFrame:
    """``key, value, n, value_rank``: counts of values, the most frequent first, ties by value."""
    from pyspark.sql import Window

    counts = meta.groupBy("key", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("key").orderBy(F.desc("n"), "value")
    return counts.withColumn("value_rank", F.row_number().over(order))


def value_type(value: Column) -> Column:
    return F.when(value.rlike(r"^-?\d+(\.\d+)?$"), "number").when(value.rlike(DATE), "time").otherwise("string")


def inverted(meta: DataFrame) -> DataFrame:
    """``key, value, n, doc_ids``: at most the documents of one value in a row; use ``doc_ids()`` to stay long."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return meta.groupBy("key", "value").agg(F.count("*").alias("n"), ids.alias("doc_ids"))
