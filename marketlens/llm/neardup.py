"""MinHash near-dedup with fast similarity sketches.

A sketch has t coordinates. In round i < t every shingle is thrown into a hashed bin, and
the least value of the first round that reaches a bin stays; from round t on, round t + j
throws every shingle into bin j, so each coordinate is sure to fill. Two sketches agree in a
coordinate with probability equal to the Jaccard similarity. Bands of coordinates give
candidates; links are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_groups
from .components import connected_components
from .textops import U, gram_hashes, mix64, read_words, slices, split_words

SHINGLE = 5
BANDS, ROWS = 32, 8
#: A pivot's partners, and the sides of a block of sketches that are compared inside one task.
PARTNERS, BLOCK = 64, 1024
#: A block's side is smaller where its documents are long: about so many shingles.
BLOCK_SHINGLES = 1_000_000
#: Texts are sketched in slices of about so many bytes.
SLICE = 1 << 20
#: Pairs whose sketches agree in so many standard errors less than the limit are not verified.
ERRORS = 4
_LOW = U((1 << 48) - 1)


def least_estimate(percent: int, places: int) -> float:
    """The share of equal places below which a pair is not verified: ERRORS binomial standard errors under percent."""
    limit = percent / 100
    return max(0.0, limit - ERRORS * (limit * (1 - limit) / places) ** 0.5)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; with fewer words the whole sequence is one."""
    words = read_words(texts, lower=True)
    grams = gram_hashes(words.hashes, size, 100 + size)
    for a, b in words.per_text():
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        else:
            yield gram_hashes(words.hashes[a:b], b - a, 100 + b - a) if b > a else np.zeros(0, np.uint64)


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes; the value holds its round in the top bits."""
    out = np.full(t, U((1 << 64) - 1))
    done = 0
    while done < t:
        n_rounds = min(t - done, max(1, int(1.3 * t * np.log(t) / len(items)) - done if done == 0 else 4))
        rounds = np.arange(done, done + n_rounds, dtype=np.uint64)[:, None]
        h = mix64(items[None, :] + (rounds + U(1)) * U(0x9E3779B97F4A7C15))
        bins = (h >> U(52)).astype(np.int64) % t
        np.minimum.at(out, bins.ravel(), ((rounds << U(48)) | (h & _LOW)).ravel())
        done += n_rounds
        empty = np.flatnonzero(out == U((1 << 64) - 1))
        if not len(empty):
            return out
    rounds = (empty + t).astype(np.uint64)
    for at in range(0, len(items), 65_536):
        h = mix64(items[at : at + 65_536, None] + (rounds[None, :] + U(1)) * U(0x9E3779B97F4A7C15))
        out[empty] = np.minimum(out[empty], (rounds << U(48)) | (h & _LOW).min(axis=0))
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.arange(1, bands + 1, dtype=np.uint64) * U(0xD1342543DE82EF95)
    for r in range(rows):
        keys = mix64(keys ^ values[r::rows][:bands]) + U(r)
    return keys.astype(np.int64)


def sketch_rows(batches: Iterable[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> doc_id, size of the set, 128 bits of the set, band keys, and a byte of each coordinate."""
    for batch in slices(batches, size=SLICE):
        n, one, two, keys, short = [], [], [], [], []
        for items in shingle_sets(batch.column(1).to_pylist()):
            n.append(len(items))
            one.append(int(mix64(items ^ U(0xA5A5)).sum(dtype=np.uint64).astype(np.int64)))
            two.append(int(mix64(items ^ U(0x5A5A5A)).sum(dtype=np.uint64).astype(np.int64)))
            values = sketch(items, bands * rows) if len(items) else None
            keys.append(None if values is None else band_keys(values, bands, rows))
            short.append(None if values is None else (mix64(values) >> U(56)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(short, pa.binary())], ["doc_id", "n_shingles", "set1", "set2", "bands", "sketch"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _with_text(needs: DataFrame, docs: DataFrame) -> DataFrame:
    """needs has a column doc; each row gets its document's text."""
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    return texts.join(needs.hint("shuffle_hash"), "doc")


def verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(a, pivot) -> the pairs (a, b) that are linked, decided on full sets.

    A pivot with many partners is sent to several places, with about PARTNERS of them each.
    """
    pairs = cut(pairs.distinct())
    crowded = cut(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / F.lit(PARTNERS)).alias("_places")).filter("_places > 1"))
    place = F.coalesce(F.pmod(F.xxhash64("a"), "_places"), F.lit(0).cast("long"))
    dealt = cut(join_groups(pairs, crowded, "pivot", "a", "left").select("a", "pivot", place.alias("place")))
    members = dealt.select(F.col("a").alias("doc"), "pivot", "place")
    pivots = dealt.select(F.col("pivot").alias("doc"), "pivot", "place").distinct()
    sent = _with_text(members.union(pivots), docs).select("doc", "pivot", "place", "text")

    def compare(table: pa.Table) -> pa.Table:
        pivot = table.column("pivot")[0].as_py()
        ids = table.column("doc").to_pylist()
        sets = list(shingle_sets(table.column("text").to_pylist()))
        base = sets[ids.index(pivot)]
        found = [i for i, items in zip(ids, sets, strict=True) if i != pivot and linked(base, items, percent)]
        return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([pivot] * len(found), pa.int64())})

    return sent.groupBy("pivot", "place").applyInArrow(compare, "a long, b long")


def in_blocks(members: DataFrame, *columns: str) -> DataFrame:
    """(bucket, doc, component, its, n_shingles, columns) -> sides 0 and 1 of blocks (bucket, i, j).

    its is the component of the bucket's pivot. Only documents outside it (side 0) are held against
    the whole bucket (side 1); an over-full bucket is dealt to many tasks as pairs of blocks.
    """
    few = F.col("component") != F.col("its")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES))
    size = F.col("n_shingles")
    counts = members.groupBy("bucket").agg(
        blocks(F.count_if(few), F.sum(F.when(few, size))).alias("rows"), blocks(F.count(F.lit(1)), F.sum(size)).alias("cols")
    )
    dealt = members.join(counts, "bucket")
    at = lambda n: F.pmod(F.xxhash64("doc"), n)
    span = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    keep = ["bucket", "doc", "component", "n_shingles", *columns]
    left = dealt.filter(few).select(*keep, at(F.col("rows")).alias("i"), span(F.col("cols")).alias("j"), F.lit(0).alias("side"))
    right = dealt.select(*keep, span(F.col("rows")).alias("i"), at(F.col("cols")).alias("j"), F.lit(1).alias("side"))
    return left.union(right)


def agreeing(table: pa.Table, percent: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a block's rows (of side 0 and side 1) in different components whose sketches agree enough, and in how much."""
    side = np.asarray(table.column("side"))
    component, size = np.asarray(table.column("component")), np.asarray(table.column("n_shingles"))
    bits = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(side), -1)
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    t = bits.shape[1]
    enough = (least * 255 / 256 + 1 / 256) * t  # bytes of different coordinates agree by chance
    across = np.ascontiguousarray(bits[y].T)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16))]
    for k in range(0, len(x), 64):
        rows = x[k : k + 64]
        agree = np.zeros((len(rows), len(y)), np.uint16)
        for c in range(t):
            agree += bits[rows, c][:, None] == across[c][None, :]
        near = (agree >= enough) & (component[rows][:, None] != component[y][None, :])
        near &= 100 * np.minimum(size[rows][:, None], size[y][None, :]) >= percent * np.maximum(size[rows][:, None], size[y][None, :])
        i, j = np.nonzero(near)
        found.append((rows[i], y[j], agree[i, j]))
    a, b, n = (np.concatenate(c) for c in zip(*found, strict=True))
    return a, b, n


def undecided(members: DataFrame, percent: int, least: float) -> DataFrame:
    """The (bucket, doc) of documents whose sketch agrees enough with one of another component in the bucket."""

    def compare(table: pa.Table) -> pa.Table:
        a, b, _ = agreeing(table, percent, least)
        doc = np.unique(np.asarray(table.column("doc"))[np.concatenate([a, b])])
        return pa.table({"bucket": pa.array([table.column("bucket")[0].as_py()] * len(doc), pa.int64()), "doc": pa.array(doc)})

    return in_blocks(members, "sketch").groupBy("bucket", "i", "j").applyInArrow(compare, "bucket long, doc long").distinct()


def joining_links(members: DataFrame, docs: DataFrame, percent: int, least: float) -> DataFrame:
    """Links (a, b) that join the components of each block as far as any of its pairs does.

    Every pair across components whose sketches agree enough is decided on full sets, the likeliest
    first, and left out only once its components are known to be joined; so a block gives
    fewer links than it has documents.
    """

    def compare(table: pa.Table) -> pa.Table:
        doc, component = table.column("doc").to_pylist(), table.column("component").to_pylist()
        sets = list(shingle_sets(table.column("text").to_pylist()))
        top: dict[int, int] = {c: c for c in component}

        def find(c: int) -> int:
            while top[c] != c:
                top[c] = c = top[top[c]]
            return c

        a, b, n = agreeing(table, percent, least)
        order = np.argsort(-n.astype(np.int32), kind="stable")
        links = []
        for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
            p, q = find(component[x]), find(component[y])
            if p != q and linked(sets[x], sets[y], percent):
                top[max(p, q)] = min(p, q)
                links.append((doc[x], doc[y]))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    sent = _with_text(in_blocks(members, "sketch"), docs)
    return sent.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long")


def link_buckets(members: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, least: float) -> DataFrame:
    """(bucket, doc) -> (node, component) for the documents that are linked with any other in their buckets.

    First each bucket's pivot is compared with all its documents. The pivot is the document that
    shares most places in buckets with others, so it is near the middle of its group, and the
    same one in most of the group's buckets. What that links is one component. Buckets that hold more
    than one component are gone through once more, by sketches alone, for the documents that may be
    linked across components; only those travel with their texts and are decided on full sets.
    """
    counts = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    popular = members.join(counts, "bucket").groupBy("doc").agg(F.sum("n").alias("places"))
    ranked = members.join(popular, "doc").select("bucket", "doc", F.struct(-F.col("places"), F.col("doc").alias("doc")).alias("p"))
    pivots = cut(ranked.groupBy("bucket").agg(F.min("p").alias("p")).select("bucket", F.col("p.doc").alias("pivot")))
    stars = members.join(pivots, "bucket").filter("doc <> pivot").select(F.col("doc").alias("a"), "pivot")
    links = cut(verify(stars, docs, percent))
    components = connected_components(links)

    of = components.select(F.col("node").alias("doc"), "component")
    known = members.join(of, "doc", "left").select("bucket", "doc", F.coalesce("component", "doc").alias("component"))
    state = known.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket")
    its = pivots.join(of.withColumnRenamed("doc", "pivot"), "pivot", "left").select("bucket", F.coalesce("component", "pivot").alias("its"))
    rest = cut(known.join(state.join(its, "bucket"), "bucket").join(classes.select("doc", "n_shingles", "sketch"), "doc"))
    open_ones = cut(undecided(rest, percent, least))
    more = cut(joining_links(rest.join(open_ones, ["bucket", "doc"]), docs, percent, least))
    return components if more.isEmpty() else connected_components(links.union(more))


def near_duplicates(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept, for every row of docs.

    Shingles are five lower-cased (A-Z) words; documents with a similarity of percent or more
    are linked, and component_id is the smallest id that a document reaches. A pair right at
    85 % shares none of 32 bands of 8 with a probability of 4 in 100,000; a lower percent needs
    shorter bands (80 %, 40 bands of 7: 8 in 100,000). Null, empty and blank
    texts have no shingles and are linked with nothing, nor is a row whose id is null (its
    component_id is null, and it is kept). A very long text is sketched and compared whole. Rows that repeat an id are one document; tests and
    links use the texts of all of them. Other columns are left out; an empty table gives an empty one.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, n_shingles long, set1 long, set2 long, bands array<long>, sketch binary"
    sketches = cut(docs.mapInArrow(lambda it: sketch_rows(it, bands, rows), schema))
    sets = ["n_shingles", "set1", "set2"]
    some = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # equal sets are one class; only its first document goes on
    classes = cut(some.groupBy(*sets).agg(F.min("doc_id").alias("doc"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")))
    spread = classes.select("doc", F.posexplode("bands").alias("band", "k")).select(F.xxhash64("band", "k").alias("bucket"), "doc")
    shared = spread.groupBy("bucket").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo <> hi").select("bucket")
    members = cut(spread.join(shared, "bucket").distinct())
    components = link_buckets(members, classes, docs, percent, least_estimate(percent, bands * rows))
    final = classes.join(components, F.col("doc") == F.col("node"), "left").select(*sets, F.coalesce("component", "doc").alias("class_id"))
    # rows without words share one empty set, so they stay out of the join
    found = sketches.filter("n_shingles > 0").join(final, sets, "left").select("doc_id", "n_shingles", "class_id")
    found = found.union(sketches.filter("n_shingles = 0").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op3(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM x
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), r AS (
  SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
), t AS (
  SELECT a AS doc_id, least(min(b), a) AS component FROM r GROUP BY a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def brute_force(rows: list[tuple[int, str | None]], percent: int = 85) -> list[tuple[int, int, int, bool]]:
    """What op3 returns, by comparing all pairs of word sets; for small inputs."""
    sets = []
    for _, text in rows:
        w = split_words(text, lower=True)
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    top = {doc: doc for doc, _ in rows}

    def find(x: int) -> int:
        while top[x] != x:
            x = top[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                common = len(a & b)
                if 100 * common >= percent * (len(a) + len(b) - common):
                    x, y = find(rows[i][0]), find(rows[j][0])
                    top[max(x, y)] = min(x, y)
    return [(doc, len(s), find(doc), find(doc) == doc) for (doc, _), s in zip(rows, sets, strict=True)]
