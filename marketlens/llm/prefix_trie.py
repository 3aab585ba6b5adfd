"""Prefix trie of conversations: sorted turn arrays, longest common prefixes, and a stack sweep stitched across partitions.

A turn is its digest of 128 bits, so a conversation is a binary key of 16 bytes a turn. Keys are cut into segments of
SEGMENT turns, each beside a digest of all turns before it (its context), so no row and no sort key grows with a
conversation. All segments are sorted by range as (segment, context, key, conversation). In that order a
trie node is an interval; a task keeps the nodes of the current key on a stack and closes those that the next key
doesn't share. Nodes that reach over a partition's edge stay open: their sums, which are all additive, are added up by node.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32_sql, cut, join_groups, word_count

#: Turns of a segment.
SEGMENT = 64
#: Bytes of a turn's digest.
TURN = 16
#: Turns at the start of a conversation that others may take over.
MOST_SHARED = 3
#: The member list of a node that reaches over partitions travels in pieces of about so many bytes.
PIECE_BYTES = 1 << 20
#: So many nodes go into a batch.
BATCH_ROWS = 4096
NUMBERED = "conv_id long, pos long, n long, digest binary, words int"
SWEPT = "kind int, id binary, parent binary, conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved long, head long, open boolean, ends string, at long, no long, piece binary"
ORDER = ("seg", "hi", "lo", "key", "conv_id")
NODE, PIECE, DEEPER = 0, 1, 2


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, pos from 1, n, digest, words: n equal turns from place pos on.

    Turns are ordered by turn, null first, and ties by role and text (their first 16 and 64 characters, then the digest); null role or
    text becomes empty. Rows without conv_id belong to no conversation and are left out. Rows are sorted by range, so a conversation
    of any length is dealt over many tasks; the driver gets one row of numbers a partition.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.left(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), F.lit(2 * TURN)))
    rows = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.left(role, F.lit(16)).alias("r"), F.left(text, F.lit(64)).alias("t"), digest.alias("digest"), word_count(text).cast("int").alias("words")
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("r"), F.col("t"), F.col("digest")]
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    ranged = cut(counted.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "n", "digest", "words"))
    sizes = ranged.groupBy(F.spark_partition_id().alias("pid"), "conv_id").agg(F.sum("n").alias("n"))
    edges = sizes.groupBy("pid").agg(F.min("conv_id").alias("first"), F.max("conv_id").alias("last"), F.max_by("n", "conv_id").alias("n")).orderBy("pid")
    offsets: dict[int, int] = {}
    conv, seen = None, 0
    for e in edges.toLocalIterator():
        offsets[e.pid] = seen if e.first == conv else 0
        seen = e.n + (offsets[e.pid] if e.first == e.last else 0)
        conv = e.last
    return cut(ranged.mapInArrow(lambda it: _number(it, offsets), NUMBERED))


def _number(batches: Iterable[pa.RecordBatch], offsets: dict[int, int]) -> Iterator[pa.RecordBatch]:
    conv, seen = None, offsets.get(TaskContext.get().partitionId(), 0)
    for batch in batches:
        if not len(batch):
            continue
        c, n = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if conv is not None and c[0] != conv:
            seen = 0
        before = np.cumsum(n) - n
        heads = np.r_[0, np.flatnonzero(np.diff(c)) + 1]
        base = np.repeat(before[heads], np.diff(np.r_[heads, len(c)]))
        pos = before - base + 1
        pos[: heads[1] if len(heads) > 1 else len(c)] += seen
        conv, seen = c[-1], int(pos[-1] + n[-1] - 1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos), *batch.columns[1:]], ["conv_id", "pos", "n", "digest", "words"])


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns as they are: (conv_id, pos, digest, words), and (conv_id, total)."""
    return _each(turns), turns.groupBy("conv_id").agg(F.sum("n").alias("total"))


def with_shared_heads(turns: DataFrame, group: int = 20) -> tuple[DataFrame, DataFrame]:
    """Each conversation c begins with the first h turns of c - c % group, then goes on after its own first h; h is crc32(c) % 4.

    Nothing is taken over from an absent conversation. At most 3 turns go to fewer than 2 * group conversations each, so no key is hot.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)
    sizes = turns.groupBy("conv_id").agg(F.sum("n").alias("size")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % group)
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    taken = F.least("h", F.coalesce("base_size", F.lit(0)))
    convs = cut(sizes.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("total")))
    heads = _each(turns.filter(F.col("pos") <= MOST_SHARED)).filter(F.col("pos") <= MOST_SHARED).withColumnRenamed("conv_id", "base")
    shared = convs.filter("taken > 0").join(heads, "base").filter("pos <= taken").select("conv_id", "pos", "digest", "words")
    own = _each(turns).filter(F.col("pos") > F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1))
    short = cut(convs.filter("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("gap")))
    own = join_groups(own, short, "conv_id", "pos", "left").select("conv_id", (F.col("pos") - F.coalesce("gap", F.lit(0))).alias("pos"), "digest", "words")
    return own.unionByName(shared), convs.select("conv_id", "total")


def _each(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", F.explode(F.sequence("pos", F.col("pos") + F.col("n") - 1)).alias("pos"), "digest", "words")


def segments(turns: DataFrame, totals: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Sorted segments: seg, context (hi, lo), key, conv_id, words of each turn, words of the turn before, and the segment before.

    The last segment of a conversation has fewer than `size` turns, maybe none. The context is the XOR of position-bound digests of all
    segments before, 128 bits.
    """
    parts = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / size).alias("seg")).agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "words"))).alias("turns"))
    key = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    full = parts.select("conv_id", "seg", key.alias("key"), F.col("turns.words").alias("words"))
    ends = totals.filter(F.col("total") % size == 0).select("conv_id", F.floor(F.col("total") / size).alias("seg"), F.lit(b"").alias("key"), F.array().cast("array<int>").alias("words"))
    both = full.unionByName(ends)
    digest = F.sha2(F.concat(F.col("seg").cast("string").cast("binary"), F.lit(b":"), F.col("key")), 256)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    w = Window.partitionBy("conv_id").orderBy("seg")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    context = {"hi": half(1), "lo": half(17)}
    placed = both.withColumns({c: F.coalesce(F.bit_xor(d).over(past), F.lit(0)) for c, d in context.items()})
    placed = placed.withColumn("head", F.coalesce(F.get(F.lag("words").over(w), F.lit(size - 1)), F.lit(0)))
    placed = placed.withColumns({"p_hi": F.lag("hi").over(w), "p_lo": F.lag("lo").over(w), "p_key": F.lag("key").over(w)})
    columns = [*ORDER, "words", "head", "p_hi", "p_lo", "p_key"]
    return cut(placed.select(*columns).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER))


def node_id(seg: int, hi: int, lo: int, prefix: bytes) -> bytes:
    return hashlib.blake2b(struct.pack(">qqq", seg, hi, lo) + prefix, digest_size=16).digest()


def common(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    return next(i for i in range(n // TURN) if a[TURN * i : TURN * (i + 1)] != b[TURN * i : TURN * (i + 1)])


def edges_shared(sorted_segments: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition that has rows: the turns that its first key shares with the last one before, and its last key with the next; -1 in another context.

    The driver gets one partition's two keys of a bounded size at a time and keeps two numbers a partition.
    """
    row = F.struct(*ORDER[:4])
    edges = sorted_segments.groupBy(F.spark_partition_id().alias("pid")).agg(F.min(row).alias("first"), F.max(row).alias("last")).orderBy("pid")
    out: dict[int, tuple[int, int]] = {}
    before, last = None, None
    for e in edges.toLocalIterator():
        shared = -1 if last is None or tuple(last[:3]) != tuple(e.first[:3]) else common(bytes(last[3]), bytes(e.first[3]))
        if before is not None:
            out[before] = (out[before][0], shared)
        out[e.pid] = (shared, -1)
        before, last = e.pid, e.last
    return out


class _Node:
    __slots__ = ("id", "open", "n_convs", "least", "children", "leaves", "saved", "ends")

    def __init__(self, name: bytes, open_: bool) -> None:
        self.id, self.open = name, open_
        self.n_convs = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends = bytearray()


class Sweep:
    """The nodes of the current key, from the root of its context on, and rows that are ready to go."""

    def __init__(self, left: int, right: int, at: int, size: int) -> None:
        self.left, self.right, self.at, self.size = left, right, at, size
        self.stack: list[_Node] = []
        self.rows: list[tuple] = []
        self.last: tuple | None = None

    def close(self, depth: int, right: int = -1) -> None:
        """Closes nodes deeper than depth; those up to `right` go on in the next partition."""
        seg, _, _, _, _, _, head, above = self.last
        while len(self.stack) - 1 > depth:
            node, d = self.stack.pop(), len(self.stack)
            if self.stack:
                up = self.stack[-1]
                up.n_convs += node.n_convs
                up.leaves += node.leaves
                up.saved += node.saved
                up.least = node.least if up.least is None else min(up.least, node.least)
            if d == self.size:  # the root of the next segment's context is this node
                continue
            going_on = node.open or d <= right
            parent = self.stack[-1].id if self.stack else above
            ends = None if going_on else hashlib.sha256(node.ends).hexdigest()
            self.rows.append((NODE, node.id, parent, node.least, self.size * seg + d, node.n_convs, node.children, node.leaves, node.saved, head if d == 0 else 0, going_on, ends, None, None, None))
            if going_on:
                for i in range(0, len(node.ends), PIECE_BYTES):
                    self.rows.append((PIECE, node.id, *[None] * 10, self.at, i // PIECE_BYTES, bytes(node.ends[i : i + PIECE_BYTES])))

    def finish_key(self, shared: int) -> None:
        """The last key is known to share so many turns with what follows it."""
        seg, _, _, key, conv, lcp_words, _, _ = self.last
        n = len(key) // TURN
        leaf = n < self.size and shared < n
        if leaf:
            self.stack[-1].leaves += 1
        if seg:
            self.rows.append((DEEPER, None, None, conv, None, None, None, int(leaf), lcp_words, None, None, None, seg, None, None))

    def add(self, seg: int, hi: int, lo: int, key: bytes, conv: int, words: list[int], head: int, above: bytes | None) -> None:
        n = len(key) // TURN
        if self.last is None:
            shared = self.left
            self.stack += [_Node(node_id(seg, hi, lo, key[: TURN * d]), True) for d in range(shared + 1)]
        else:
            shared = common(self.last[3], key) if self.last[:3] == (seg, hi, lo) else -1
            self.finish_key(shared)
            self.close(shared)
        for d in range(shared + 1, n + 1):
            if d:
                self.stack[-1].children += 1
            self.stack.append(_Node(node_id(seg, hi, lo, key[: TURN * d]), False))
        for d in range(1, shared + 1):
            self.stack[d].saved += words[d - 1]
        node = self.stack[-1]
        node.n_convs += 1
        node.least = conv if node.least is None else min(node.least, conv)
        if n < self.size:
            node.ends += b",%d" % conv if node.ends else b"%d" % conv
        self.last = (seg, hi, lo, key, conv, sum(words[: max(0, shared)]), head, above)

    def end(self) -> None:
        if self.last is not None:
            self.finish_key(self.right)
            self.close(-1, self.right)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.bool_(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SWEPT.split(", ")])


def sweep(batches: Iterable[pa.RecordBatch], shared: dict[int, tuple[int, int]], size: int) -> Iterator[pa.RecordBatch]:
    """Sorted segments of a partition -> its nodes, closed or open, pieces of open nodes' members, and what later segments share."""
    pid = TaskContext.get().partitionId()
    state = Sweep(*shared.get(pid, (-1, -1)), pid, size)
    for batch in batches:
        for seg, hi, lo, key, conv, words, head, p_hi, p_lo, p_key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            above = node_id(seg - 1, p_hi, p_lo, p_key[: TURN * (size - 1)]) if seg else None
            state.add(seg, hi, lo, key, conv, words, head, above)
            if len(state.rows) >= BATCH_ROWS:
                yield _batch(state.rows)
                state.rows = []
    state.end()
    if state.rows:
        yield _batch(state.rows)


def hash_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, piece) sorted by id and place -> (id, ends): SHA-256 of the pieces joined by commas, one piece in memory at a time."""
    now, state = None, None
    fresh = None
    for batch in batches:
        out = []
        for i in range(len(batch)):
            name, at, no, piece = (c[i].as_py() for c in batch.columns)
            if name != now:
                if now is not None:
                    out.append((now, state.hexdigest()))
                now, state, fresh = name, hashlib.sha256(), True
            state.update(piece if fresh or no else b"," + piece)
            fresh = False
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out])], ["id", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], ["id", "ends"])


def _path_ids(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(seg, hi, lo, key, saved, n_leaves) -> (id, saved, n_leaves) of each node on the key's path, without the last."""
    for batch in batches:
        rows = [(node_id(s, hi, lo, key[: TURN * d]), saved, leaves) for s, hi, lo, key, saved, leaves in zip(*(c.to_pylist() for c in batch.columns), strict=True) for d in range(size)]
        ids, saved, leaves = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(saved, pa.int64()), pa.array(leaves, pa.int64())], ["id", "more_saved", "more_leaves"])


def nodes(sorted_segments: DataFrame, size: int = SEGMENT) -> DataFrame:
    """id, parent, conv_id, depth, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie."""
    shared = edges_shared(sorted_segments)
    swept = cut(sorted_segments.mapInArrow(lambda it: sweep(it, shared, size), SWEPT))
    kept = ["id", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved", "head", "ends"]
    done = swept.filter(f"kind = {NODE} AND NOT open").select(*kept)
    pieces = swept.filter(f"kind = {PIECE}").select("id", "at", "no", "piece").repartition("id").sortWithinPartitions("id", "at", "no")
    hashed = pieces.mapInArrow(hash_pieces, "id binary, ends string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    merged = swept.filter(f"kind = {NODE} AND open").groupBy("id").agg(F.first("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("head").alias("head"))
    merged = merged.join(hashed, "id", "left").withColumn("ends", F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())))
    every = done.unionByName(merged.select(*kept))
    if not sorted_segments.filter("seg > 0").isEmpty():  # what long conversations add to the nodes above their later segments
        w = Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        below = swept.filter(f"kind = {DEEPER}").select("conv_id", (F.col("at") - 1).alias("seg"), F.sum("saved").over(w).alias("saved"), F.sum("n_leaves").over(w).alias("n_leaves"))
        path = sorted_segments.select("seg", "hi", "lo", "key", "conv_id").join(below.filter("saved > 0 OR n_leaves > 0"), ["conv_id", "seg"])
        more = path.select("seg", "hi", "lo", "key", "saved", "n_leaves").mapInArrow(lambda it: _path_ids(it, size), "id binary, more_saved long, more_leaves long")
        more = more.groupBy("id").agg(F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))
        every = every.join(more, "id", "left").withColumns({"saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)), "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))})
    saved = F.col("saved") + (F.col("n_convs") - 1) * F.col("head")
    return every.select("id", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def with_parents(trie: DataFrame) -> DataFrame:
    """trie with parent_conv_id; a parent of very many children is dealt out by adaptive execution's skew join."""
    parents = trie.filter("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return trie.join(parents, "parent", "left")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of (conv_id, turn, role, text): a node for each distinct sequence of first turns, with its parent.

    conv_id is a node's smallest member; its depth-th turn is the node's. An empty table has no node, not even the root; other columns are not read.
    """
    return with_parents(cut(nodes(segments(*whole(numbered(conversations))))))


def op11(conversations: DataFrame, size: int = SEGMENT) -> DataFrame:
    trie = with_parents(cut(nodes(segments(*with_shared_heads(numbered(conversations)), size), size)))
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_force(rows: list[tuple], shared: bool = True) -> list[tuple]:
    """What op11 returns, from (conv_id, turn, role, text), by a dictionary of all prefixes."""
    import zlib

    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    convs = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if shared else 0
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        convs[c] = own.get(base, [])[:h] + ts[h:]
    members: dict[tuple, list[int]] = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children: dict[tuple, list[tuple]] = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(p[-1][1].encode().split()) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM t),
rebuilt AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
  UNION ALL SELECT conv_id, pos + 3, role, text FROM t JOIN c USING (conv_id) WHERE pos > h),
lists AS (
  SELECT conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS turns
  FROM c LEFT JOIN rebuilt USING (conv_id) GROUP BY conv_id),
prefix AS (SELECT conv_id, d, turns[1:d] AS p, d = len(turns) AS at_end FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM lists)),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE at_end) AS ends FROM prefix GROUP BY p, d),
child AS (SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
own AS (
  SELECT node.*, coalesce(n, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(node.p[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS saved
  FROM node LEFT JOIN child USING (p)),
sub AS (
  SELECT p[1:k] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved FROM (SELECT p, n_children, saved, unnest(range(d + 1)) AS k FROM own) GROUP BY 1)
SELECT own.conv_id, CAST(own.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, CAST(sub.n_leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN sub USING (p) LEFT JOIN node AS up ON own.d > 0 AND up.p = own.p[1:own.d - 1]
"""
