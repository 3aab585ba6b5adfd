"""Words and hashes of whole texts for work inside tasks, a slice of an Arrow batch at a time."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
#: Texts are taken in slices of about so many bytes, so memory follows the longest text and not the batch.
SLICE_BYTES = 4 << 20
#: Hashes are summed over so many bytes or words at once.
_BLOCK = 1 << 17
#: Longer words are hashed one by one.
_LONG_WORD = 256
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


@cache
def _powers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    base = ((2 * seed + 1) * 0x9E3779B97F4A7C15 & ~7 & (1 << 64) - 1) | 5
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        p = np.full(_BLOCK + 64, U(x))
        p[0] = U(1)
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


@dataclass
class Words:
    """The words of some texts: where they lie in data, how many each text has, and a 64-bit hash of each."""

    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    hashes: np.ndarray

    def per_text(self) -> Iterator[tuple[int, int]]:
        stops = np.cumsum(self.counts).tolist()
        return zip([0, *stops[:-1]], stops, strict=True)


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = ~_IS_GAP[np.frombuffer(data, np.uint8)]
    edges = np.flatnonzero(np.diff(word))
    return edges[::2], edges[1::2]


def hash_spans(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word: a polynomial in its bytes, from differences of running sums, then mixed."""
    raw = np.frombuffer(data, np.uint8)
    power, inverse = _powers(0)
    out = np.zeros(len(starts), np.uint64)
    size = (ends - starts).astype(np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _BLOCK, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo <= _BLOCK:
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((raw[lo:hi].astype(np.uint64) + U(1)) * power[: hi - lo], out=sums[1:])
            s = starts[i:j] - lo
            out[i:j] = (sums[ends[i:j] - lo] - sums[s]) * inverse[s]
        i = j
    for k in np.flatnonzero(size > _LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return mix64(out + size * U(0xD6E8FEB86659FD93))


def read_words(texts: list[str | None], lower: bool = False) -> Words:
    """Words of whole texts; null has none. lower: A-Z are lower-cased, nothing else."""
    raw = [(t or "").encode() for t in texts]
    data = b"\n".join(raw)
    if lower:
        data = data.lower()  # bytes.lower() changes A-Z alone
    starts, ends = spans(data)
    stops = np.cumsum([len(x) + 1 for x in raw])
    counts = np.diff(np.r_[0, np.searchsorted(starts, stops)])
    return Words(data, starts, ends, counts, hash_spans(data, starts, ends))


def word_ids(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each word's place in a list of the distinct words, and that list; equal places mean equal words."""
    raw = np.frombuffer(data, np.uint8)
    dense = raw[~_IS_GAP[raw]]
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(dense.tobytes())])
    coded = words.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int32), coded.dictionary


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() parts at exactly space and 0x09-0x0D."""
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def gram_hashes(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """A hash of each run of `size` (up to 64) consecutive word hashes; seeds give independent ones."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(seed)
    out = np.empty(n, np.uint64)
    for i in range(0, n, _BLOCK):
        part = hashes[i : i + _BLOCK + size - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], out=sums[1:])
        m = len(part) - size + 1
        out[i : i + m] = (sums[size : size + m] - sums[:m]) * inverse[:m]
    return mix64(out)


def release() -> None:
    """Gives memory that is no longer used back to the system: a worker that has done its task stays on, idle, beside later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches again, in slices of about `size` bytes of text; a longer text has a slice of its own."""
    for batch in batches:
        if not len(batch):
            continue
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop
        del batch, column, offsets
    release()
