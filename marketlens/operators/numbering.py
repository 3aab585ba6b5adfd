"""Dense numbers for any number of rows, without a window over all of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept

#: monotonically_increasing_id() holds the partition above so many bits and the place in it below.
_PLACE_BITS = 33


def numbered(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """df with a column of dense numbers in the given order, null orders as its columns say.

    Rows are sorted by range and kept, so a lost task gives the same rows the same numbers; each partition's running offset comes from the counts of those before
    it, a table of one row a partition. Rows that are equal in all of `order` may be numbered either way, so the order should end in a unique key. An empty
    table gives an empty one.
    """
    ranged = kept(df.repartitionByRange(*order).sortWithinPartitions(*order))
    part = F.shiftright(F.monotonically_increasing_id(), _PLACE_BITS)
    placed = ranged.withColumns({"_part": part, "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))})
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = placed.join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_offset") + F.col("_place") + F.lit(start)).drop("_part", "_place", "_offset")
