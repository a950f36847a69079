"""List, map and string operations, branches and bounded loops as expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions import text as T

MOST_ROUNDS = 1024


def _whole(items: Column, n: int) -> Column:
    return F.raise_error(F.concat(F.lit(f"no item {n} in a list of "), F.size(items).cast("string")))


def nth(items: Column, n: int) -> Column:
    """The n-th item from the start (from 1) or the end (from -1); a place outside is an error."""
    if n == 0:
        raise ValueError("items are counted from 1 or -1")
    return F.when(F.size(items) >= abs(n), F.element_at(items, n)).otherwise(_whole(items, n))


def head(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def tail(items: Column, n: int) -> Column:
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), F.lit(n))


def where(items: Column, field: str, op: str, wanted) -> Column:
    """Items whose field compares so; ``contains`` and ``start with`` are for text."""
    value = F.lit(wanted)
    tests: dict[str, Callable[[Column], Column]] = {
        "=": lambda x: x == value, "≠": lambda x: x != value, ">": lambda x: x > value, "<": lambda x: x < value, "≥": lambda x: x >= value,
        "≤": lambda x: x <= value, "contains": lambda x: F.contains(x, value), "start with": lambda x: F.startswith(x, value),
    }
    return F.filter(items, lambda x: F.coalesce(tests[op](x[field]), F.lit(False)))


def ordered(items: Column, fields: list[tuple[str, bool]]) -> Column:
    """Sorted by fields in turn, each ascending or (true) descending; stable; nulls last."""

    def compare(a: Column, b: Column) -> Column:
        out = F.lit(0)
        for field, down in reversed(fields):
            x, y = a[field], b[field]
            less, more = F.lit(1 if down else -1), F.lit(-1 if down else 1)
            out = (
                F.when(x.isNull() & y.isNull(), out).when(x.isNull(), F.lit(1)).when(y.isNull(), F.lit(-1)).when(x < y, less).when(x > y, more).otherwise(out)
            )
        return out

    return F.array_sort(items, compare)


def select_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, v: k.isin(*keys))


def remove_keys(m: Column, keys: list[str]) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys))


def rename_keys(m: Column, names: dict[str, str]) -> Column:
    def of(k: Column, v: Column) -> Column:
        out = k
        for old, new in names.items():
            out = F.when(k == old, F.lit(new)).otherwise(out)
        return out

    return F.transform_keys(m, of)


def remove_empty(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v.cast("string") != ""))


def combine(first: Column, second: Column) -> Column:
    """Both maps in one; the second wins."""
    own = F.map_filter(first, lambda k, v: ~F.map_contains_key(second, k))
    return F.map_concat(own, second)


def append_or_update(m: Column, values: dict[str, Column]) -> Column:
    return combine(m, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]))


def split_all(text: Column, delimiters: list[str]) -> Column:
    """Parts between any of the delimiters, empty ones kept."""
    return F.split(text, "|".join(T.quoted(d) for d in sorted(delimiters, key=len, reverse=True)))


def merge_all(parts: Column, delimiters: list[str]) -> Column:
    """Joined by the first delimiter."""
    return F.array_join(parts, delimiters[0])


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def switch(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for condition, name in reversed(cases):
        out = F.when(condition, name).otherwise(out)
    return out


def repeat_until(start: Column, step: Callable[[Column], Column], done: Callable[[Column], Column], most: int) -> Column:
    """``step`` over and over until ``done`` or ``most`` times, at most 1,024."""
    rounds = F.sequence(F.lit(1), F.lit(max(1, min(most, MOST_ROUNDS))))
    return F.aggregate(rounds, start, lambda x, _: F.when(done(x), x).otherwise(step(x)))
