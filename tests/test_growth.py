"""Work that grows with the input alone: shapes on which the number of pairs is far beyond that of the rows."""

import random

from pyspark.sql import functions as F

from marketlens.operators import places
from marketlens.roles import TYPES, role
from marketlens.streaming import unread


def test_unread_notes_are_not_multiplied_by_followers(spark, monkeypatch):
    sizes, deliver = [], unread.deliveries
    monkeypatch.setattr(unread, "deliveries", lambda n, f: sizes.append(n.count()) or deliver(n, f))
    notes = [(i, 3, TYPES[i % 5], i % 40) for i in range(400)]
    follows, reads = [(u, 3) for u in range(40)], [(i, i % 7) for i in range(400)]
    frames = [spark.createDataFrame(r, k) for r, k in ((notes, "note_id long, shop_id long, type string, created_by long"), (follows, "user_id long, shop_id long"), (reads, "note_id long, user_id long"))]
    got = {r[0]: r[1] for r in unread.unread_by_user(frames[0].withColumn("created_at", F.current_timestamp()), *frames[1:]).collect()}
    for u in range(40):
        sent = [n for n, s, t, by in notes if (u + s) % (TYPES.index(t) + 2) and not (t in ("community", "event") and by == u)]
        assert got.get(u, 0) == sum((n, u) not in reads for n in sent)
    assert sizes == [0]  # only notes with unclear ids go to each follower


def test_unread_notes_with_repeated_and_null_ids_count_once(spark):
    rng = random.Random(2)
    pick = lambda n: rng.choice([None, *range(n)])
    notes = [(pick(25), pick(4), rng.choice([*TYPES, None]), pick(6)) for _ in range(60)]
    follows, reads = [(pick(6), pick(4)) for _ in range(20)], [(pick(25), pick(6)) for _ in range(60)]
    sent = set()
    for n, s, t, by in notes:
        for u, shop in follows:
            if s is not None and s == shop and t and u is not None and (u + s) % (TYPES.index(t) + 2) and not (t in ("community", "event") and by == u):
                sent.add((u, n))
    want = {u: sum(v == u and (n is None or (n, u) not in reads) for v, n in sent) for u, _ in sent}
    frames = [spark.createDataFrame(r, k) for r, k in ((notes, "note_id long, shop_id long, type string, created_by long"), (follows, "user_id long, shop_id long"), (reads, "note_id long, user_id long"))]
    got = unread.unread_by_user(frames[0].withColumn("created_at", F.current_timestamp()), *frames[1:]).collect()
    assert {r[0]: r[1] for r in got} == want and len(got) == len(want)


def _at_one_point(spark, n, key):
    return spark.range(n).select(F.col("id").alias(key), F.lit(40.0).alias("lat"), F.lit(-90.0).alias("lng"))


def test_tasks_of_a_radius_follow_its_pairs(spark):
    pairs = places.within_radius(_at_one_point(spark, 3000, "place_id"), _at_one_point(spark, 3000, "shop_id"), 5.0)
    assert pairs.rdd.getNumPartitions() >= 9 and pairs.count() == 9_000_000


def test_nearest_looks_up_points_and_not_their_copies(spark, monkeypatch):
    sizes, within = [], places.within_radius
    monkeypatch.setattr(places, "within_radius", lambda p, s, r: sizes.append((p.count(), s.count())) or within(p, s, r))
    got = places.nearest(_at_one_point(spark, 500, "place_id"), _at_one_point(spark, 500, "shop_id"), 3)
    assert sorted(map(tuple, got.collect())) == [(p, k + 1, k, 0.0) for p in range(500) for k in range(3)]
    assert sizes == [(1, 3)]


def test_follows_keep_their_partitions_whatever_their_bytes(spark, data):
    assert role(spark, data, "follow").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
