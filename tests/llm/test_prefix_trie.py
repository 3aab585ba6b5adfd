"""The prefix trie against a dictionary of all prefixes."""

import random

import pytest
from pyspark.sql import functions as F

from marketlens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations():
    """Short ones with null turns, roles and texts, repeated rows, copies, long ones that part after whole segments, and ids below 0."""
    rng = random.Random(3)
    rows = []
    for c in [*range(90), -5, -20, -41]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, t if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), rng.choice([None, "a", "b c", "d e f\tg", ""])))
    for c, length in {100: 200, 101: 200, 102: 64, 103: 64, 104: 128, 105: 130, 106: 70, 120: 66, 140: 86, 141: 87}.items():
        rows += [(c, t, "user", f"x y {t if t < 100 + c % 4 * 20 else c}") for t in range(length)]
    for c in range(300, 400):
        rows += [(c, 1, "user", "same"), (c, 2, "assistant", "same again"), (c, 3, "u", "v")]
    return rows + [(7, 1, "user", "repeated")] * 9 + [(None, 1, "user", "lost"), (800, 1, "user", "long " * 100_000)]


@pytest.fixture(scope="module")
def rows():
    return conversations()


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("size", [1, 4, prefix_trie.SEGMENT])
def test_brute_force(spark, rows, size):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"id": F.lit(1), "seg": F.lit(2), "Key": F.lit("-"), "digest": F.lit("-")})
    same(prefix_trie.op11(df, size), prefix_trie.brute_force(rows))


def test_over_many_partitions(spark, rows):
    """Copies, first turns and members' lists reach over partitions, which are stitched."""
    off = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        same(prefix_trie.op11(spark.createDataFrame(rows, SCHEMA).repartition(7)), prefix_trie.brute_force(rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_trie_of_conversations_as_they_are(spark, rows):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    same(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).select(*columns), prefix_trie.brute_force(rows, shared=False))


def test_one_conversation_with_most_rows(spark):
    rows = [(3, t // 2, "user", f"t {t % 50}") for t in range(3000)] + [(c, 0, "user", "t 0") for c in range(4, 60)]
    same(prefix_trie.op11(spark.createDataFrame(rows, SCHEMA).repartition(6)), prefix_trie.brute_force(rows))


def test_empty_and_turnless(spark):
    assert prefix_trie.op11(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(c, 1, "user", "x") for c in range(21, 40)]  # some lose their only turn and have no other to begin with
    same(prefix_trie.op11(spark.createDataFrame(rows, SCHEMA)), prefix_trie.brute_force(rows))
