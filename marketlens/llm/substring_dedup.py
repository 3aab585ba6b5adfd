"""Substring dedup by super-k-mer partitioning.

A window is k consecutive words. Consecutive windows that share a minimiser (the least
hash among their m-word grams, frequent grams behind all others) travel as one packed string to the minimiser's bucket,
where sorting brings equal windows together and tells which document has each first.
Windows are sorted by a hash, and those with equal hashes are compared word by word, so no
word is removed because two hashes met.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .textops import gram_hashes, hash_spans, mix64, read_words, release, slices, spans, split_words, word_ids

#: A null doc_id stands behind all others.
LAST = (1 << 63) - 1
PACK = "dest int, kind int, docs binary, starts binary, sizes binary, packed binary"
SETTLED, WINDOWS = 0, 1
#: So many words of packs' own lists wait before they become part of the bucket's one list.
MOST_PENDING = 1 << 19
#: A gram that makes up a fourth of a bucket's share of all grams is frequent; there are at most four times as many as buckets. In a slice those are counted that have such a
#: share there, or one in 20,000.
SHARE, LEAST_SHARE = 4, 20_000


def _later(hashes: np.ndarray, doc: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Which windows are found in a document with a smaller id; ids[at : at + k] are a window's words."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) < 2:
        return out
    order = np.argsort(hashes, kind="stable")
    ties = hashes[order[1:]] == hashes[order[:-1]]
    if not ties.any():
        return out
    near = np.zeros(len(order), bool)
    near[1:] |= ties
    near[:-1] |= ties
    order = order[near]
    order = order[np.lexsort((doc[order], hashes[order]))]
    h, d, place = hashes[order], doc[order], at[order]
    new = np.r_[True, h[1:] != h[:-1]]
    same = np.ones(len(order) - 1, bool)
    for j in range(k):
        word = ids[place + j]
        same &= word[1:] == word[:-1]
    met = ~new[1:] & ~same  # different windows with one hash
    if met.any():
        run = np.cumsum(new)
        for r in np.unique(run[1:][met]).tolist():
            inside = np.flatnonzero(run == r)
            words = ids[place[inside][:, None] + np.arange(k)]
            inside = inside[np.lexsort((d[inside], *words.T[::-1]))]
            where = np.sort(inside)
            order[where], d[where], place[where] = order[inside], d[inside], place[inside]
            words = ids[place[where][:, None] + np.arange(k)]
            new[where[1:]] |= (words[1:] != words[:-1]).any(axis=1)
    least = d[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out[order[d > least]] = True
    return out


_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = ["dest", "kind", "docs", "starts", "sizes", "packed"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct runs of window starts: document, first start, number of starts."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)
    heads = np.flatnonzero(new)
    last = at[np.r_[heads[1:] - 1, len(at) - 1]] if len(at) else at
    return doc[heads], at[heads].astype(np.int32), (last - at[heads] + 1).astype(np.int32)


def _settled(doc: np.ndarray, at: np.ndarray, parts: int) -> Iterator[tuple]:
    """Windows to remove, a row of runs for each of the documents' partitions."""
    doc, start, size = _runs(doc, at)
    dest = (mix64(doc.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(dest, kind="stable")
    dest = dest[order]
    cuts = np.r_[np.flatnonzero(np.r_[True, dest[1:] != dest[:-1]]), len(dest)].tolist() if len(dest) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        some = order[a:b]
        yield (int(dest[a]), SETTLED, doc[some].tobytes(), start[some].tobytes(), size[some].tobytes(), None)


def tally(batches: Iterable[pa.RecordBatch], m: int, parts: int) -> Iterator[pa.RecordBatch]:
    """(gram, n) of each slice's frequent grams, and the number of all under null."""
    for batch in slices(batches):
        grams, counts = np.unique(gram_hashes(read_words(batch.column(0).to_pylist()).hashes, m, 3), return_counts=True)
        total = int(counts.sum())
        some = counts >= max(2, total / min(SHARE * parts, LEAST_SHARE))
        found = [*grams[some].astype(np.int64).tolist(), None]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array([*counts[some].tolist(), total], pa.int64())], ["gram", "n"])


def frequent_grams(texts: DataFrame, m: int, parts: int) -> np.ndarray:
    """Grams that would make a bucket uneven, sorted, over all texts; at most SHARE times as many as buckets."""
    counts = cut(texts.mapInArrow(lambda it: tally(it, m, parts), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = counts.filter("gram IS NULL").first()
    hot = counts.filter(F.col("gram").isNotNull() & (F.col("n") * SHARE * parts >= (total.n if total else 0))).select("gram")
    return np.sort(np.array([r.gram for r in hot.collect()], np.int64).astype(np.uint64))


def ranked(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The order in which grams become minimisers: by hash, frequent ones behind all others. It is the same wherever a gram stands."""
    if not len(hot):
        return grams >> np.uint64(1)
    at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
    return grams >> np.uint64(1) | (hot[at] == grams).astype(np.uint64) << np.uint64(63)


def pack(batches: Iterable[pa.RecordBatch], k: int, m: int, parts: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Super-k-mers of each slice, a row for each bucket, and the windows settled within the slice.

    Of equal windows in a slice only that of the smallest document travels, so a passage that
    very many documents share comes to its bucket once a slice.
    """
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches):
        ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)
        words = read_words(batch.column(1).to_pylist())
        if len(words.hashes) < k:
            continue
        doc_at = np.repeat(ids, words.counts)
        base = np.repeat(np.cumsum(words.counts) - words.counts, words.counts)
        n = len(doc_at) - k + 1
        end = np.repeat(np.cumsum(words.counts), words.counts)
        at = np.flatnonzero(np.arange(n) + k <= end[:n])  # windows don't reach into the next document
        if not len(at):
            continue
        later = _later(gram_hashes(words.hashes, k, 1)[at], doc_at[at], word_ids(words.data, words.starts, words.ends)[0], at, k)
        gone = at[later]
        rows = list(_settled(doc_at[gone], gone - base[gone], parts))
        at = at[~later]
        if len(at):
            grams = ranked(gram_hashes(words.hashes, m, 3), hot)
            least = np.lib.stride_tricks.sliding_window_view(grams, k - m + 1)[at].min(axis=1)
            new = np.ones(len(at), bool)
            new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
            heads = np.flatnonzero(new)
            size = np.diff(np.r_[heads, len(at)]) + k - 1
            head = at[heads]
            bucket = (mix64(least[heads]) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, head, size = bucket[order], head[order], size[order]
            data = words.data
            strings = [data[a:b] for a, b in zip(words.starts[head].tolist(), words.ends[head + size - 1].tolist(), strict=True)]
            docs, offsets, size = doc_at[head], (head - base[head]).astype(np.int32), size.astype(np.int32)
            cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)].tolist()
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                packed = squeeze.compress(b" ".join(strings[a:b]))
                rows.append((int(bucket[a]), WINDOWS, docs[a:b].tobytes(), offsets[a:b].tobytes(), size[a:b].tobytes(), packed))
        yield _batch(rows)


class Interned:
    """The distinct words of a bucket; packs bring their own lists, which become one a few at a time."""

    def __init__(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.pending: list[pa.Array] = []
        self.pending_words = 0

    def add(self, distinct: pa.Array) -> None:
        self.pending.append(distinct)
        self.pending_words += len(distinct)

    def settle(self, ids: list[np.ndarray], first: int) -> int:
        """Turns the ids of the packs from `first` on, places in their own lists, into places in the one list; the next pack's place."""
        coded = pa.concat_arrays([self.known, *self.pending]).dictionary_encode()  # known words keep their places, as they come first
        places, at = np.asarray(coded.indices), len(self.known)
        for i, own in enumerate(self.pending, first):
            ids[i] = places[at : at + len(own)][ids[i]].astype(np.int32)
            at += len(own)
        self.known, self.pending, self.pending_words = coded.dictionary, [], 0
        return len(ids)


def settle(batches: Iterable[pa.RecordBatch], k: int, parts: int) -> Iterator[pa.RecordBatch]:
    """In a bucket: unpack the windows, sort them and send off those that a smaller document has too."""
    unsqueeze = zstandard.ZstdDecompressor()
    hashes, docs, starts, at, ids = ([] for _ in range(5))  # a part for each pack
    words, pending = Interned(), 0
    place = 0
    for batch in batches:
        rows = []
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if row[1] == SETTLED:
                rows.append(row)
                continue
            doc, start, size = np.frombuffer(row[2], np.int64), np.frombuffer(row[3], np.int32), np.frombuffer(row[4], np.int32).astype(np.int64)
            data = unsqueeze.decompress(row[5])
            begin, end = spans(data)
            own, distinct = word_ids(data, begin, end)
            count = size - (k - 1)
            inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            head = np.repeat(np.cumsum(size) - size, count) + inside
            hashes.append(gram_hashes(hash_spans(data, begin, end), k, 1)[head])
            docs.append(np.repeat(doc, count))
            starts.append((np.repeat(start, count) + inside).astype(np.int32))
            at.append(head + place)
            ids.append(own)
            words.add(distinct)
            place += len(own)
            if words.pending_words > MOST_PENDING:
                pending = words.settle(ids, pending)
        if rows:
            yield _batch(rows)
    if hashes:
        words.settle(ids, pending)
        del words
        whole = []
        for parts_of in (hashes, docs, ids, at, starts):
            whole.append(np.concatenate(parts_of))
            parts_of.clear()
        later = _later(*whole[:4], k)
        rows = list(_settled(whole[1][later], whole[4][later].astype(np.int64), parts))
        if rows:
            yield _batch(rows)
    release()


def merge_marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of each document of a partition, in one row."""
    docs, starts, sizes = [], [], []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            docs.append(np.frombuffer(row[2], np.int64))
            starts.append(np.frombuffer(row[3], np.int32))
            sizes.append(np.frombuffer(row[4], np.int32))
    if not docs:
        return
    doc, start, size = np.concatenate(docs), np.concatenate(starts), np.concatenate(sizes)
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    pairs = np.stack([start[order], size[order]], axis=1)
    cuts = np.r_[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]), len(doc)].tolist()
    for i in range(0, len(cuts) - 1, 5000):
        some = cuts[i : i + 5001]
        runs = [pairs[a:b].tobytes() for a, b in zip(some[:-1], some[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(doc[some[:-1]], pa.int64()), pa.array(runs, pa.binary())], ["doc_id", "runs"])


def apply_marks(batches: Iterable[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, runs) -> doc_id, n_words, n_removed, kept: the words that no marked window covers."""
    for batch in slices(batches):
        rows: dict[str, list] = {"n_words": [], "n_removed": [], "kept": []}
        for text, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = split_words(text)
            removed = 0
            if runs:
                start, size = np.frombuffer(runs, np.int32).reshape(-1, 2).T.astype(np.int64)
                edges = np.zeros(len(words) + 1, np.int64)
                np.add.at(edges, np.minimum(start, len(words)), 1)
                np.add.at(edges, np.minimum(start + size - 1 + k, len(words)), -1)
                keep = np.cumsum(edges[:-1]) == 0
                removed = int(len(words) - keep.sum())
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            rows["n_words"].append(len(words) + removed)
            rows["n_removed"].append(removed)
            rows["kept"].append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows["n_words"], pa.int64()), pa.array(rows["n_removed"], pa.int64()), pa.array(rows["kept"], pa.string())], ["doc_id", *rows])


def dedup_substrings(docs: DataFrame, k: int = 13, m: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the text that is kept, for every row of docs.

    A word goes if a window over it also starts in a document with a smaller id; windows are
    judged on the input. Words are kept unchanged and joined by one space. A null or empty text
    has no words, and a very long one is taken whole. Rows that repeat an id count as one document: none makes another go. A null
    id stands behind all others. Other columns are left out; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())  # a bucket stays as large as the input's partitions
    hot = frequent_grams(rows.select("text"), m, parts)
    packs = rows.mapInArrow(lambda it: pack(it, k, m, parts, hot), PACK)
    settled = packs.repartitionById(parts, "dest").mapInArrow(lambda it: settle(it, k, parts), PACK)
    marks = settled.repartitionById(parts, "dest").mapInArrow(merge_marks, "doc_id long, runs binary")
    side = marks.withColumnRenamed("doc_id", "_doc").hint("shuffle_hash")
    joined = rows.join(side, F.coalesce("doc_id", F.lit(LAST)) == F.col("_doc"), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(lambda it: apply_marks(it, k), "doc_id long, n_words long, n_removed long, kept string")


def op10(docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13
), g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM x
), f AS (
  SELECT g, min(doc_id) AS first FROM g GROUP BY g
), m AS (
  SELECT DISTINCT doc_id, i + k AS i FROM g JOIN f USING (g), range(13) r(k) WHERE first < doc_id
), p AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), k AS (
  SELECT p.doc_id, count(m.i) AS removed, string_agg(word, ' ' ORDER BY p.i) FILTER (WHERE m.i IS NULL) AS kept FROM p LEFT JOIN m ON m.doc_id = p.doc_id AND m.i = p.i GROUP BY p.doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


def brute_force(rows: list[tuple[int, str | None]], k: int = 13) -> list[tuple[int, int, int, str]]:
    """What op10 returns, for small inputs; the tests' measure."""
    first: dict[tuple, int] = {}
    split = [(doc, split_words(text)) for doc, text in rows]
    for doc, words in split:
        for i in range(len(words) - k + 1):
            w = tuple(words[i : i + k])
            first[w] = min(doc, first.get(w, doc))
    out = []
    for doc, words in split:
        gone = {j for i in range(len(words) - k + 1) if first[tuple(words[i : i + k])] < doc for j in range(i, i + k)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return out
