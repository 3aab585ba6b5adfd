"""What a client keeps for its user, as one keyed table: lists with the latest first, sets of toggled items, and single values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How many items a list keeps.
LIST = 8


def client_state(changes: DataFrame, lists: tuple[str, ...] = (), sets: tuple[str, ...] = (), values: tuple[str, ...] = (), most: int = LIST) -> DataFrame:
    """(user_id, key, item, at, seq) -> user_id, key, place, item after all changes in the order of (at, seq), which is unique for a user.

    lists: an item moves to the front, and the first `most` stay. sets: a change turns an item's membership over; places go by the last change, the oldest first. values: the last
    change counts; a null item clears it. Changes are combined by user, key and item before the shuffle; a null item is none in lists and sets.
    """
    at = F.struct("at", "seq")
    kept = changes.filter(F.col("key").isin(*lists, *sets) & F.col("item").isNotNull())
    items = kept.groupBy("user_id", "key", "item").agg(F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    listed = items.filter(F.col("key").isin(*lists)).withColumn("place", F.row_number().over(Window.partitionBy("user_id", "key").orderBy(F.desc("last")))).filter(F.col("place") <= most)
    held = items.filter(F.col("key").isin(*sets) & (F.col("n") % 2 == 1)).withColumn("place", F.row_number().over(Window.partitionBy("user_id", "key").orderBy("last")))
    single = changes.filter(F.col("key").isin(*values)).groupBy("user_id", "key").agg(F.max_by("item", at).alias("item")).filter("item IS NOT NULL").withColumn("place", F.lit(1))
    return reduce(DataFrame.unionByName, [df.select("user_id", "key", "place", "item") for df in (listed, held, single)])
