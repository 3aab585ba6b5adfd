"""Byte-level BPE against the tiktoken library, and its two tiers by themselves."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marketlens.llm import byte_bpe

TEXTS = [
    None, "", " ", " \t\n", "one", "don't we'll I'M it's'\n 's", "Über naïve café  x  y　\tz", "a  b\n\n\tc <|endoftext|> d", "x\x1c y\x85 z  w ", "  　\n\n x", "\x00\x01 12345 ... !!", "é" * 300,
    "日本語テキスト" * 40, "🙂🙃 👩‍👩‍👧 é", "ab " * 40_000 + "end", "x" * 60_000, "same line here\n" * 30, "same line here\n" * 30,
]
SCHEMA = "doc_id long, text string, ids string, decoded string, IDS_sha256 string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i % 7 else None, t, "-", "-", "-") for i, t in enumerate(TEXTS)], SCHEMA).repartition(3)


def plain(rows):
    return sorted(byte_bpe.brute_force(rows), key=str)


def test_same_as_the_library(docs):
    got = sorted(map(tuple, byte_bpe.op13(docs).collect()), key=str)
    assert got == plain([(i if i % 7 else None, t) for i, t in enumerate(TEXTS)])


def test_blocks_and_memory_change_nothing(docs, monkeypatch, spark):
    words = ["".join(random.Random(k).choices("abcdéß ,\n", k=9)) for k in range(3000)]
    texts = [" ".join(words[i : i + 40]) for i in range(0, 3000, 7)]
    vocabulary = byte_bpe.Vocabulary(None, None)
    import pyarrow as pa

    whole = byte_bpe.encode_block(pa.array(texts), vocabulary).to_pylist()
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 50)
    small = [byte_bpe.encode_block(pa.array(texts[i : i + 3]), vocabulary).to_pylist() for i in range(0, len(texts), 3)]
    assert [x for part in small for x in part] == whole


def test_encode_then_decode(docs):
    both = byte_bpe.decode(byte_bpe.encode(docs).withColumn("decoded", F.lit(1)))
    assert both.columns == ["doc_id", "ids", "decoded"]
    assert sorted(bytes(r.decoded).decode() for r in both.collect()) == sorted(t or "" for t in TEXTS)


def test_empty_table(spark):
    assert byte_bpe.op13(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_unknown_ids_are_an_error(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([999_999],)], "ids array<int>")).collect()


def test_null_ids_are_empty(spark):
    assert [bytes(r.decoded) for r in byte_bpe.decode(spark.createDataFrame([(None,)], "ids array<int>")).collect()] == [b""]


def test_perfect_hash_is_minimal():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    numbers = byte_bpe.PerfectHash(keys).numbers(keys)
    assert sorted(numbers.tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError, match="one hash"):
        byte_bpe.PerfectHash(np.array([5, 5], np.uint64))


def plain_merge(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=40) | st.text("abctheing rs", min_size=1, max_size=40).map(str.encode))
def test_heap_merges_like_the_plain_loop(piece):
    ranks = byte_bpe.load(None, None).ranks
    assert byte_bpe.merge(piece, ranks) == plain_merge(piece, ranks)
