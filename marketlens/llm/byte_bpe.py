"""Byte-level BPE by ranks: whole pre-tokens through a minimal perfect hash, the others by merging linked bytes from a heap.

A task takes its texts in blocks, parts a block at places that no pre-token crosses, and splits and encodes each
distinct part of it once. Nothing is shuffled, and memory follows the block or the longest text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import _buffers, cuts
from .textops import hash_spans, mix64, slices

#: A block holds about so many bytes of text, or one document.
BLOCK_BYTES = 4 << 20
#: A worker remembers at most twice so many merged pre-tokens, of at most so many bytes each, from one block to the next.
REMEMBERED, LONGEST = 150_000, 64
U = np.uint64


class PerfectHash:
    """Distinct 64-bit hashes to the numbers from 0 to n - 1, one each.

    On each level the keys that have a place to themselves are numbered; the others go on to the next, smaller level. A
    key that isn't in the set gets any number, or -1, so a caller compares the key that has the number.
    """

    def __init__(self, keys: np.ndarray) -> None:
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two keys have one hash")
        self.levels: list[np.ndarray] = []
        done, rest = 0, keys
        while len(rest):
            at = self._place(rest, len(self.levels), 2 * len(rest) + 1)
            alone = np.bincount(at, minlength=2 * len(rest) + 1) == 1
            self.levels.append(np.where(alone, np.cumsum(alone) - 1 + done, -1).astype(np.int32))
            done += int(alone.sum())
            rest = rest[~alone[at]]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix64(keys + U(0x9E3779B97F4A7C15 * (level + 1) & (1 << 64) - 1)) % U(size)).astype(np.int64)

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        open_ = np.arange(len(keys))
        for k, table in enumerate(self.levels):
            out[open_] = table[self._place(keys[open_], k, len(table))]
            open_ = open_[out[open_] < 0]
        return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the neighbours whose joined bytes have the least rank are joined, the leftmost first, until none have one.

    The parts are a linked list and the pairs lie in a heap; a pair of which an end has gone or grown is passed over.
    """
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if end[i] < 0 or j >= n or end[j] != stop:
            continue
        end[i], after[i], end[j] = stop, after[j], -1
        k, h = after[i], before[i]
        if k < n:
            before[k] = i
            if (r := ranks.get(piece[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """Bytes and rank of each token of a rank file (base64 and number a line); by default a public one for many languages."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Vocabulary:
    """Both tiers over one rank file."""

    def __init__(self, path: str | None, pattern: str | None) -> None:
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern or split_pattern())
        pieces = list(self.ranks)
        self.hash = PerfectHash(_hashes(pa.array(pieces, pa.large_binary())))
        order = np.argsort(self.hash.numbers(_hashes(pa.array(pieces, pa.large_binary()))))
        self.pieces = pa.array([pieces[i] for i in order], pa.large_binary())
        self.ids = np.array([self.ranks[pieces[i]] for i in order], np.int32)
        self.fresh: dict[bytes, list[int]] = {}
        self.stale: dict[bytes, list[int]] = {}

    def lookup(self, words: pa.Array) -> np.ndarray:
        """Id of each word that is a token as a whole, otherwise -1."""
        if not len(words):
            return np.zeros(0, np.int32)
        at = self.hash.numbers(_hashes(words))
        same = pc.equal(words, self.pieces.take(pa.array(np.maximum(at, 0))))
        return np.where(np.asarray(same) & (at >= 0), self.ids[np.maximum(at, 0)], -1)

    def merged(self, word: bytes) -> list[int]:
        """Ids of a pre-token that is no token; what was asked for lately is remembered."""
        if (ids := self.fresh.get(word)) is not None:
            return ids
        ids = self.stale.get(word) or merge(word, self.ranks)
        if len(word) <= LONGEST:
            if len(self.fresh) >= REMEMBERED:
                self.stale, self.fresh = self.fresh, {}
            self.fresh[word] = ids
        return ids

    def encode(self, words: pa.Array) -> pa.LargeListArray:
        """Ids of each distinct pre-token."""
        ids = self.lookup(words)
        missed = np.flatnonzero(ids < 0)
        lists = [self.merged(w) for w in words.take(pa.array(missed)).to_pylist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[missed] = [len(x) for x in lists]
        offsets = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        flat = np.repeat(ids, sizes)
        flat[np.repeat(ids < 0, sizes)] = np.fromiter(chain.from_iterable(lists), np.int32)
        return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(flat))


@cache
def load(path: str | None, pattern: str | None) -> Vocabulary:
    return Vocabulary(path, pattern)


def _hashes(words: pa.Array) -> np.ndarray:
    at, data = _buffers(words)
    return hash_spans(bytes(data), at[:-1], at[1:])


def _regrouped(lists: pa.LargeListArray, counts: np.ndarray) -> pa.LargeListArray:
    """Lists joined, so many at a time as counts say."""
    at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
    return pa.LargeListArray.from_arrays(pa.array(at[np.r_[0, np.cumsum(counts)]].astype(np.int64)), lists.flatten())


def encode_block(texts: pa.Array, vocabulary: Vocabulary) -> pa.LargeListArray:
    """Ids of each text of a block; bytes that aren't UTF-8 count as U+FFFD."""
    offsets, data = _buffers(texts)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    marked = np.zeros(len(raw) + 1, bool)
    marked[offsets] = marked[cuts(raw)] = True
    marks = np.flatnonzero(marked)
    if len(marks) < 2:
        return pa.LargeListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int64)), pa.array([], pa.int32()))
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(marks) - 1, [None, pa.py_buffer(marks.tobytes()), pa.py_buffer(raw)]).dictionary_encode()
    found, counts = [], []
    for part in parts.dictionary.to_pylist():
        words = vocabulary.pattern.findall(part.decode("utf-8", "replace"))
        counts.append(len(words))
        found += words
    words = pa.array(found, pa.large_string()).cast(pa.large_binary()).dictionary_encode()
    of_words = vocabulary.encode(words.dictionary)
    of_parts = _regrouped(of_words.take(words.indices), np.array(counts, np.int64))
    return _regrouped(of_parts.take(parts.indices), np.diff(np.searchsorted(marks, offsets)))


def encode_batches(batches: Iterable[pa.RecordBatch], path: str | None, pattern: str | None) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> (doc_id, ids)."""
    vocabulary = load(path, pattern)
    for block in slices(batches, "text", BLOCK_BYTES):
        ids = encode_block(block.column(1), vocabulary)
        yield pa.RecordBatch.from_arrays([block.column(0), ids.cast(pa.list_(pa.int32()))], ["doc_id", "ids"])


def decode_batches(batches: Iterable[pa.RecordBatch], path: str | None, ids: str) -> Iterator[pa.RecordBatch]:
    """The batches with a column `decoded`: the bytes of the ids, one after another."""
    vocabulary = load(path, None)
    pieces = vocabulary.pieces.take(pa.array(np.argsort(vocabulary.ids)))
    known = np.sort(vocabulary.ids)
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(ids)).fill_null([])
        flat = np.asarray(lists.flatten())
        at = np.searchsorted(known, flat)
        if len(flat) and ((at >= len(known)) | (known[np.minimum(at, len(known) - 1)] != flat)).any():
            raise ValueError("an id is not in the vocabulary")
        ends, data = _buffers(pieces.take(pa.array(at)))
        stops = ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()].tolist()
        decoded = [bytes(data[a:b]) for a, b in zip(stops[:-1], stops[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row: what the tiktoken library's encode_ordinary gives for the whole text.

    path: a rank file that is present on every executor. Null and empty texts have no ids, a very long text is a block of its own, repeated
    rows and null ids keep a row each, other columns are left out, and an empty table gives an empty one.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: encode_batches(it, path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """encoded with a column `decoded` (binary) in place of any of that name; null ids give empty bytes, unknown ids an error."""
    rest = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c.lower() != "decoded"])
    return rest.mapInArrow(lambda it: decode_batches(it, path, ids), T.StructType([*rest.schema.fields]).add("decoded", "binary"))


def round_trip(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """decode(encode(docs)) with both ends in one Python worker."""
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    both = lambda it: decode_batches(encode_batches(it, path, pattern), path, "ids")
    return rows.mapInArrow(both, "doc_id long, ids array<int>, decoded binary")


def op13(docs: DataFrame, path: str | None = None) -> DataFrame:
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def brute_force(rows: list[tuple[int, str | None]], path: str | None = None) -> list[tuple[int, int, str, str]]:
    """What op13 returns, by the tiktoken library."""
    import hashlib

    import tiktoken

    own = tiktoken.Encoding("own", pat_str=split_pattern(), mergeable_ranks=read_ranks(path), special_tokens={})
    out = []
    for doc, text in rows:
        ids = own.encode_ordinary(text or "")
        out.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode_bytes(ids)).hexdigest()))
    return out
