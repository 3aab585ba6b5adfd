"""Pages by the last row's key instead of an offset."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


class Key(NamedTuple):
    """A sort key: a column, its direction, and whether nulls come first."""

    column: str
    descending: bool = False
    nulls_first: bool = False

    def order(self) -> Column:
        c = F.col(self.column)
        return (c.desc_nulls_first() if self.nulls_first else c.desc_nulls_last()) if self.descending else (c.asc_nulls_first() if self.nulls_first else c.asc_nulls_last())

    def beyond(self, value: Any, equal: bool = False) -> Column:
        """Rows whose key comes after a value, or with it too; never null, as scans need plain conditions."""
        c = F.col(self.column)
        if value is None:
            return F.lit(True) if self.nulls_first and equal else c.isNotNull() if self.nulls_first else c.isNull() if equal else F.lit(False)
        after = (c <= value if equal else c < value) if self.descending else (c >= value if equal else c > value)
        return after if self.nulls_first else after | c.isNull()

    def same(self, value: Any) -> Column:
        return F.col(self.column).isNull() if value is None else F.col(self.column) == value


def after(keys: Sequence[Key], last: Row | None) -> Column:
    """Rows after `last` in the order of keys; all without a last row.

    The first key's bound stands alone before the rest, so that it reaches the scan.
    """
    if last is None:
        return F.lit(True)
    out: Column | None = None
    for key in reversed(keys):
        value = last[key.column]
        out = key.beyond(value) if out is None else key.beyond(value) | key.same(value) & out
    assert out is not None
    return keys[0].beyond(last[keys[0].column], equal=True) & out


def seek(df: DataFrame, keys: Sequence[Key], size: int, last: Row | None = None) -> DataFrame:
    """The page of `size` rows that follows the row `last`, or the first; keys end in a unique one. No page sorts or counts the rows before it."""
    return df.filter(after(keys, last)).orderBy(*[k.order() for k in keys]).limit(size)


def pages(df: DataFrame, keys: Sequence[Key], size: int, n: int) -> DataFrame:
    """The first n pages with their number, each found by the last row of the one before; a page's rows are few enough to be shown."""
    last, out = None, None
    for k in range(1, n + 1):
        page = seek(df, keys, size, last)
        rows = page.collect()  # `size` rows, which are shown
        now = df.sparkSession.createDataFrame(rows, df.schema).withColumn("page", F.lit(k))
        out = now if out is None else out.unionByName(now)
        if len(rows) < size:
            break
        last = rows[-1]
    assert out is not None
    return out
