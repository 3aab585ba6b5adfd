"""Unread notes by user: a count that a stream keeps up to date, and the same over tables."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.relational import some
from ..plans.people import preferences
from ..roles import TYPES, role, with_roles

COUNTS = "user_id long, unread long, as_of timestamp"
#: A user's notes: their ids, times, and 1 for delivered, 2 for read, 3 for both.
STATE = "ids array<long>, times array<long>, flags array<int>"
DELIVERED, READ = 1, 2


def deliveries(notes: DataFrame, follows: DataFrame) -> DataFrame:
    """user_id, note_id, at: each note to those who follow its shop, want its type and, for posts and events, didn't write it."""
    switched = some(*[(F.col("type") == t) & F.col(f"on_{t}") for t in TYPES])
    own = F.col("type").isin("community", "event") & F.col("created_by").eqNullSafe(F.col("user_id"))
    return notes.join(preferences(follows), "shop_id").filter(switched & ~own).select("user_id", "note_id", F.col("created_at").cast("timestamp").alias("at"))


def unread_by_user(notes: DataFrame, follows: DataFrame, reads: DataFrame) -> DataFrame:
    """user_id, unread of every user with any note: notes delivered and not read, each once.

    Notes are counted by shop and type before they meet the follows, and what a user wrote or has read is counted by user and shop, so no note is multiplied by
    its followers. Only notes whose id is null or stands for different notes are delivered one by one, as each counts once for a user.
    """
    kind = F.struct("shop_id", "type", "created_by")
    ids = notes.groupBy("note_id").agg(F.min(kind).alias("low"), F.max(kind).alias("high"))
    clear = F.col("note_id").isNotNull() & F.col("low").eqNullSafe(F.col("high"))
    single = ids.filter(clear).select("note_id", "low.*")
    of_type = lambda name: [F.count_if(F.col("type") == t).alias(f"{name}_{t}") for t in TYPES]
    at = ["user_id", "shop_id"]
    edges = preferences(follows).groupBy(*at).agg(*[F.coalesce(F.max(f"on_{t}"), F.lit(False)).alias(f"on_{t}") for t in TYPES])
    posted = F.col("type").isin("community", "event")
    own = single.filter(posted).groupBy("shop_id", F.col("created_by").alias("_by")).agg(*of_type("own")).withColumnRenamed("shop_id", "_shop")
    seen = reads.select("user_id", "note_id").distinct().join(single, "note_id").filter(~(posted & F.col("created_by").eqNullSafe(F.col("user_id"))))
    counted = (
        edges.join(single.groupBy("shop_id").agg(*of_type("all")), "shop_id")
        .join(own, (F.col("shop_id") == F.col("_shop")) & F.col("user_id").eqNullSafe(F.col("_by")), "left")
        .join(seen.groupBy(*at).agg(*of_type("read")), at, "left")
    )
    total = lambda name: sum((F.when(F.col(f"on_{t}"), F.coalesce(f"{name}_{t}", F.lit(0))).otherwise(0) for t in TYPES), F.lit(0).cast("long"))
    of_singles = counted.select("user_id", (total("all") - total("own")).alias("sent"), total("read").alias("read"))
    again = ids.filter(~clear).select(F.col("note_id").alias("_id"))
    sent = deliveries(notes.join(again, F.col("note_id").eqNullSafe(F.col("_id")), "left_semi"), follows).select("user_id", "note_id").distinct()
    read = reads.select("user_id", "note_id", F.lit(1).alias("read")).distinct()
    of_others = sent.join(read, ["user_id", "note_id"], "left").select("user_id", F.lit(1).cast("long").alias("sent"), F.coalesce("read", F.lit(0)).cast("long").alias("read"))
    both = of_singles.unionByName(of_others).groupBy("user_id").agg(F.sum("sent").alias("sent"), F.sum("read").alias("read"))
    return both.filter("sent > 0").select("user_id", F.coalesce(F.col("sent") - F.col("read"), F.lit(0).cast("long")).alias("unread"))


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, keep_ms: int) -> Iterator[pd.DataFrame]:
    """A user's notes after new ones and reads, in whichever order these come and however often; those older than keep_ms before the watermark are forgotten."""
    ids, times, flags = state.get if state.exists else ([], [], [])
    notes: dict[int, list[int]] = {i: [t, f] for i, t, f in zip(ids, times, flags, strict=True)}
    before = sum(f == DELIVERED for _, f in notes.values()) if state.exists else None
    latest = 0
    for frame in frames:
        for note, at, flag in zip(frame["note_id"], frame["at_ms"], frame["flag"], strict=True):
            now = notes.setdefault(int(note), [int(at), 0])
            now[0], now[1] = max(now[0], int(at)), now[1] | int(flag)
            latest = max(latest, int(at))
    mark = state.getCurrentWatermarkMs()
    notes = {i: x for i, x in notes.items() if x[0] > mark - keep_ms}
    unread = sum(f == DELIVERED for _, f in notes.values())
    if notes:
        state.update((list(notes), [t for t, _ in notes.values()], [f for _, f in notes.values()]))
        state.setTimeoutTimestamp(max(min(t for t, _ in notes.values()) + keep_ms, mark + 1))
    elif state.exists:
        state.remove()
    if unread != before:
        yield pd.DataFrame({"user_id": [key[0]], "unread": [unread], "as_of": [pd.Timestamp(latest or mark, unit="ms")]})


def unread_counts(notes: DataFrame, follows: DataFrame, reads: DataFrame, keep_days: int = 30, late: str = "1 hour") -> DataFrame:
    """Streams of notes (as in the table) and reads (user_id, note_id, at), a table of follows -> user_id, unread, as_of whenever a user's count changes.

    The state of a user is what came in the last keep_days before the watermark, so it is bounded; older notes are forgotten, and a count goes down
    by them when their time is up. Output mode is update.
    """
    sent = deliveries(notes, follows).withColumn("flag", F.lit(DELIVERED))
    read = reads.select("user_id", "note_id", F.col("at").cast("timestamp").alias("at"), F.lit(READ).alias("flag"))
    events = sent.unionByName(read).withWatermark("at", late).withColumn("at_ms", F.unix_millis("at"))
    keep_ms = keep_days * 86_400_000
    update: Any = lambda key, frames, state: _update(key, frames, state, keep_ms)
    return events.groupBy("user_id").applyInPandasWithState(update, COUNTS, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unread_by_user(role(spark, sf_dir, "note"), role(spark, sf_dir, "follow"), role(spark, sf_dir, "note_read"))


QUERIES = {"unread_by_user": _whole}
SQL = {
    "unread_by_user": with_roles(
        "WITH sent AS (SELECT DISTINCT f.user_id, n.note_id FROM note n JOIN follow f USING (shop_id) WHERE ("
        + " OR ".join(f"(type = '{t}' AND (f.user_id + f.shop_id) % {i + 2} <> 0)" for i, t in enumerate(TYPES))
        + ") AND NOT (type IN ('community', 'event') AND created_by IS NOT DISTINCT FROM f.user_id)), r AS (SELECT DISTINCT user_id, note_id FROM note_read)"
        " SELECT sent.user_id, count(*) FILTER (WHERE r.note_id IS NULL) AS unread FROM sent LEFT JOIN r ON r.user_id = sent.user_id AND r.note_id = sent.note_id GROUP BY 1", "note", "follow", "note_read"
    )
}
