"""BPE encoding through a table of distinct words, and decoding through an id-to-piece join.

Tasks split their texts at places that no token crosses. A block of documents sends each of
its distinct words to the word's partition, where every distinct word of the corpus is encoded
once; the ids come back to the block and are joined to its word positions. A block sends a word
once however often it holds it, so neither a common word nor a long text makes a large group.
The positions are worked out a second time instead of travelling with the words.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .textops import hash_spans, release, slices

#: A block holds about so many bytes of text, or one document.
BLOCK_BYTES = 6 << 20
WORDS = pa.schema([("dest", pa.int32()), ("block", pa.int64()), ("lengths", pa.binary()), ("data", pa.binary())])
POSITIONS = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("index", pa.binary())])
WORDS_DDL, POSITIONS_DDL = "dest int, block long, lengths binary, data binary", "block long, docs binary, index binary"
#: White space beyond ASCII that a token may hold together with ASCII white space, as UTF-8.
_SPACES = [c.encode() for c in "\u0085\u00a0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"]


def load_tokenizer(path: str | None):
    """The tokenizer of a file in the tokenizers library's format; by default a public byte-level one."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _squeeze(array: np.ndarray) -> bytes:
    """Compressed planes of bytes: those of the high bytes are nearly all zero."""
    planes = np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T
    return zstandard.compress(planes.tobytes(), 1)


def _expand(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _buffers(strings: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of a string array."""
    strings = strings.cast(pa.large_binary())
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return offsets, memoryview(strings.buffers()[2] or b"")


def cuts(raw: np.ndarray) -> np.ndarray:
    """Where a text can be cut, in no order: before ASCII white space that follows no white space of any kind.

    Tokens take white space to their front, or are nothing else, so none reaches over such a place.
    """
    ascii_space = ((raw >= 0x09) & (raw <= 0x0D)) | (raw == 0x20)
    at = np.flatnonzero(ascii_space)
    at = at[at > 0]
    before = raw[at - 1]
    plain = ~(ascii_space[at - 1] | ((before >= 0x1C) & (before <= 0x1F)))
    beyond = at[plain & (before >= 0x80)]  # few: the only places that other white space can come before
    at = at[plain & (before < 0x80)]
    for space in _SPACES:
        n = len(space)
        hit = beyond >= n
        for k, byte in enumerate(space):
            hit &= raw[np.maximum(beyond - n + k, 0)] == byte
        beyond = beyond[~hit]
    return np.concatenate([at, beyond])


@dataclass
class Block:
    """Documents of a batch: their ids, and their pieces as places in a list of distinct words by bucket and bytes."""

    name: int
    docs: np.ndarray
    index: np.ndarray
    words: pa.Array
    bucket: np.ndarray


def blocks(batches: Iterable[pa.RecordBatch], n_buckets: int) -> Iterator[Block]:
    """(doc_id, text) -> blocks, the same ones in every run over the same batches."""
    for batch in slices(batches, "text", BLOCK_BYTES):
        offsets, data = _buffers(batch.column(1))
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        ids = batch.column(0)
        marked = np.zeros(len(raw) + 1, bool)
        marked[offsets] = marked[cuts(raw)] = True
        marks = np.flatnonzero(marked)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(marks) - 1, [None, pa.py_buffer(marks.astype(np.int64).tobytes()), pa.py_buffer(raw)]) if len(raw) else pa.array([], pa.large_binary())
        counts = np.diff(np.searchsorted(marks, offsets))
        docs = np.stack([np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()), counts]).astype(np.int64)
        coded = pieces.dictionary_encode()
        at, held = _buffers(coded.dictionary)
        order = np.asarray(pc.array_sort_indices(coded.dictionary)).astype(np.int64)  # neighbours share their heads and compress well
        bucket = (hash_spans(bytes(held), at[:-1], at[1:]) % np.uint64(n_buckets)).astype(np.int64)
        order = order[np.argsort(bucket[order], kind="stable")]
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        name = xxhash.xxh3_64(docs.tobytes())
        name.update(raw)
        yield Block(int(np.uint64(name.intdigest()).astype(np.int64)), docs, place[np.asarray(coded.indices)], coded.dictionary.take(pa.array(order)), bucket[order])


def _words_of(block: Block) -> pa.RecordBatch:
    offsets, data = _buffers(block.words)
    heads = np.r_[np.flatnonzero(np.diff(block.bucket, prepend=-1)), len(block.bucket)].tolist()
    rows = []
    for a, b in zip(heads[:-1], heads[1:], strict=True):
        lengths = np.diff(offsets[a : b + 1]).astype(np.uint32)
        rows.append((int(block.bucket[a]), block.name, _squeeze(lengths), zstandard.compress(bytes(data[offsets[a] : offsets[b]]), 3)))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [()] * len(WORDS), WORDS, strict=True)], schema=WORDS)


def _positions_of(block: Block) -> pa.RecordBatch:
    row = ([block.name], [zstandard.compress(block.docs.tobytes(), 3)], [_squeeze(block.index)])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, POSITIONS, strict=True)], schema=POSITIONS)


def send_words(batches: Iterable[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """A row of distinct words for each of a block's buckets."""
    yield from map(_words_of, blocks(batches, n_buckets))
    release()


def send_positions(batches: Iterable[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: its documents, and the place of each piece among its distinct words."""
    yield from map(_positions_of, blocks(batches, n_buckets))
    release()


def encode_words(batches: Iterable[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    """Rows of words become rows of ids; each distinct word comes to one partition and is encoded there once. Partitions follow the input, so a table of words is no larger than a part of it."""
    tokenizer = load_tokenizer(path)
    table: dict[bytes, bytes] = {}
    for batch in batches:
        for i in range(len(batch)):
            dest, block, lengths, data = (c[i].as_py() for c in batch.columns)
            ends = np.cumsum(_expand(lengths, np.uint32)).tolist()
            data = zstandard.decompress(data)
            words = [data[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
            new = list(dict.fromkeys(w for w in words if w not in table))
            for w, found in zip(new, tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
                table[w] = np.array(found.ids, np.uint32).tobytes()
            ids = [table[w] for w in words]
            sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
            row = ([dest], [block], [_squeeze(sizes)], [_squeeze(np.frombuffer(b"".join(ids), np.uint32))])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, WORDS, strict=True)], schema=WORDS)
    table.clear()
    release()


def join_positions(positions: pa.Table, words: pa.Table) -> pa.Table:
    """A block's positions and the ids of its words -> (doc_id, ids); ids are little-endian unsigned 32-bit integers.

    Blocks of equal rows have one name; their words are the same, and each has its own positions.
    """
    rows = {d: (a, b) for d, a, b in zip(*(words.column(c).to_pylist() for c in ("dest", "lengths", "data")), strict=True)}
    parts = [rows[d] for d in sorted(rows)]
    lengths = np.concatenate([_expand(a, np.uint32) for a, _ in parts]) if parts else np.zeros(0, np.uint32)
    ids = np.concatenate([_expand(b, np.uint32) for _, b in parts]) if parts else np.zeros(0, np.uint32)
    table = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(lengths, dtype=np.int64)], pa.array(ids))
    doc, out = [], []
    for packed, index in zip(positions.column("docs").to_pylist(), positions.column("index").to_pylist(), strict=True):
        docs, known, counts = np.frombuffer(zstandard.decompress(packed), np.int64).reshape(3, -1)
        at = _expand(index, np.uint32)
        if len(at) and int(at.max()) >= len(lengths):
            raise RuntimeError("a block has not got the ids of all its words: its input came in another order in a second attempt; leave `stable` unset")
        data = memoryview(np.asarray(table.take(pa.array(at)).flatten())).cast("B")
        ends = (np.r_[0, np.cumsum(lengths[at], dtype=np.int64)][np.cumsum(counts)] * 4).tolist()
        doc.append(pa.array(docs, mask=known == 0))
        out += [bytes(data[s:e]) for s, e in zip([0, *ends[:-1]], ends, strict=True)]
    return pa.table({"doc_id": pa.chunked_array(doc, pa.int64()), "ids": pa.array(out, pa.binary())})


def _joined(docs: DataFrame, path: str | None, key: str, text: str, stable: bool, finish, schema: str) -> DataFrame:
    """finish over the table (doc_id, ids) of each block.

    Blocks are made twice and have to be the same both times, also after an executor is lost. Files are read
    alike each time; rows of another origin may come in another order, so they are written to the shared folder first.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if not stable:
        rows = cut(rows)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    words = rows.mapInArrow(lambda it: send_words(it, parts), WORDS_DDL)
    coded = words.repartitionById(parts, "dest").mapInArrow(lambda it: encode_words(it, path), WORDS_DDL)
    positions = rows.mapInArrow(lambda it: send_positions(it, parts), POSITIONS_DDL)
    pair = positions.groupBy("block").cogroup(coded.groupBy("block"))

    def done(p: pa.Table, w: pa.Table) -> pa.Table:
        out = finish(join_positions(p, w))
        release()  # what the block took beside its rows
        return out

    return pair.applyInArrow(done, schema)


def encode(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", stable: bool = False) -> DataFrame:
    """doc_id and ids (binary: little-endian unsigned 32-bit integers) for every row of docs.

    stable: docs is read straight from files, with nothing but projections and filters since.

    The ids are those that the tokenizers library gives for the whole text without special tokens
    of its own adding, truncation or padding. path: a byte-level BPE file, present on every executor.
    Null and empty texts have no ids; a very long text is a block of its own. Repeated rows and null ids keep a row each; other columns
    are left out, and an empty table gives an empty one.
    """
    return _joined(docs, path, key, text, stable, lambda t: t, "doc_id long, ids binary")


def vocabulary(path: str | None = None) -> pa.Array:
    """Piece of each id as bytes: the table that decoding joins with, as large as the vocabulary."""
    import json

    tokenizer = load_tokenizer(path)
    # byte-level BPE writes printable bytes as themselves and the others from U+0100 on
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte_of = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}
    plain = {x["content"] for x in json.loads(tokenizer.to_str())["added_tokens"]}
    pieces: list[bytes] = [b""] * tokenizer.get_vocab_size()
    for piece, i in tokenizer.get_vocab().items():
        pieces[i] = piece.encode() if piece in plain else bytes(byte_of[c] for c in piece)
    return pa.array(pieces, pa.binary())


def decode_batches(batches: Iterable[pa.RecordBatch], pieces: pa.Array, ids: str) -> Iterator[pa.RecordBatch]:
    """The batches with a column `decoded`: each id is joined with its piece."""
    for whole in batches:
        place = whole.schema.get_field_index(ids)
        for i in range(0, len(whole), 500):
            batch = whole.slice(i, 500)
            rows = [x or b"" for x in batch.column(place).to_pylist()]
            found = pieces.take(pa.array(np.frombuffer(b"".join(rows), np.uint32)))
            offsets, data = _buffers(found)
            ends = offsets[np.cumsum([len(x) // 4 for x in rows])].tolist()
            texts = [str(data[a:b], "utf-8", "replace") for a, b in zip([int(offsets[0]), *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def decode(encoded: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """encoded with a column `decoded`: the text of ids, special tokens included. Null ids give an empty text."""
    rest = encoded.select(*[F.col(f"`{c}`") for c in encoded.columns if c != "decoded"])
    pieces = vocabulary(path)
    return rest.mapInArrow(lambda it: decode_batches(it, pieces, ids), T.StructType([*rest.schema.fields]).add("decoded", "string"))


def round_trip(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", stable: bool = False) -> DataFrame:
    """decode(encode(docs)) with both ends in one Python worker, which halves the workers that a task holds."""
    pieces = vocabulary(path)
    finish = lambda t: pa.Table.from_batches(decode_batches(t.to_batches(), pieces, "ids"), t.schema.append(pa.field("decoded", pa.string())))
    return _joined(docs, path, key, text, stable, finish, "doc_id long, ids binary, decoded string")


def op4(docs: DataFrame, path: str | None = None, stable: bool = False) -> DataFrame:
    return round_trip(docs, path, stable=stable).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def brute_force(rows: list[tuple[int, str | None]], path: str | None = None) -> list[tuple[int, int, str, str]]:
    """What op4 returns, from the library's own encode and decode of whole texts."""
    import hashlib

    tokenizer = load_tokenizer(path)
    out = []
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False).encode()
        out.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    return out
