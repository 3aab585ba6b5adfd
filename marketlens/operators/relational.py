"""Filters, joins, aggregates and orders from which the plans are made."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def every(*conditions: Column | None) -> Column:
    """All conditions that are given; true without any."""
    return reduce(and_, [c for c in conditions if c is not None], F.lit(True))


def some(*conditions: Column) -> Column:
    return reduce(or_, conditions, F.lit(False))


def given(value: Any, condition: Callable[[Any], Column]) -> Column | None:
    """The condition on a parameter, or nothing where the parameter is None, empty or 0."""
    return condition(value) if value else None


def like_any(query: str, *columns: str) -> Column:
    """Any column holds the query, by case; % and _ in it are wildcards."""
    return some(*[F.col(c).like(f"%{query}%") for c in columns])


def star(base: DataFrame, key: str, *branches: DataFrame) -> DataFrame:
    """base with each branch, which has one row per key; a missing count or sum is left null.

    Each one-to-many side is aggregated by key before it is joined, so sides never multiply each other.
    """
    return reduce(lambda df, side: df.join(side, key, "left"), branches, base)


def asc(c: str) -> Column:
    """Ascending with nulls last, as the service's database sorts."""
    return F.col(c).asc_nulls_last()


def desc(c: str) -> Column:
    """Descending with nulls first, as the service's database sorts."""
    return F.col(c).desc_nulls_first()


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows; the order has to end in a unique key."""
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def totals(df: DataFrame, size: int) -> DataFrame:
    """One row: total and number of pages."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("total"), F.ceil(n / size).cast("long").alias("pages"))


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, as it ranks within each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def first_wins(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """One row for each key, the first in order; order has to be unique.

    It is an aggregation with a struct, not a window, so rows are combined before the shuffle
    and a key with very many rows is no burden.
    """
    rest = [c for c in df.columns if c not in order]
    row = F.struct(*order, *rest)
    least = df.groupBy(key.alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_row"))
    return least.select(*[F.col("_row")[c].alias(c) for c in df.columns])


def nested(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    """Rows of each key as a sorted array of structs; for keys whose rows fit a row."""
    items = F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))
    return df.groupBy(*keys).agg(items.alias(name))


def contains_any(query: str, *columns: str) -> Column:
    """Any column holds the query, whatever its case; no character of it is a wildcard."""
    return some(*[F.coalesce(F.lower(c).contains(query.lower()), F.lit(False)) for c in columns])


def valid_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]], words: dict[str, Sequence[str]]) -> DataFrame:
    """df with valid, and why it isn't: the first column out of its range or list, null included."""
    checks = [(c, F.col(c).between(lo, hi)) for c, (lo, hi) in ranges.items()] + [(c, F.col(c).isin(*w)) for c, w in words.items()]
    why = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), c) for c, ok in checks])
    return df.withColumn("why", why).withColumn("valid", F.col("why").isNull())


def upcoming(df: DataFrame, at: str, as_of: Column) -> DataFrame:
    """df with upcoming: at or after as_of."""
    return df.withColumn("upcoming", F.col(at) >= as_of)


def grouped_by_fallback(df: DataFrame, key: str, free: str) -> DataFrame:
    """Counts by key, where it is missing or 0 by the free text, and where that is empty as 'unknown'."""
    known = F.coalesce(F.nullif(F.col(key), F.lit(0)).cast("string"), F.nullif(F.col(free), F.lit("")), F.lit("unknown"))
    return df.groupBy(known.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def collated(df: DataFrame, keys: Sequence[str], name: str, *ties: str) -> DataFrame:
    """df with its place, from 1, in the order of keys as people sort: accents and case count only between equal letters, blanks and nulls come first.

    Equal keys go by `ties`, which should be unique. Rows are sorted by range, not in one task.
    """
    order = [F.collate(F.coalesce(F.col(k), F.lit("")), "UNICODE").asc() for k in keys] + [asc(t) for t in ties]
    return numbered(df, order, name)
