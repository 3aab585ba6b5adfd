"""Mixing sources to target weights, with DataFrame operations only.

Tokens are aggregated per source, targets are levelled under a cap, repetition
rates follow, and each document is emitted floor(rate) times plus one
hash-seeded Bernoulli copy with probability equal to the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_enough, unused_name, word_count

#: Up to here the table of sources (one row each) is broadcast; beyond, a salted shuffle join is used.
BROADCAST_ROWS, BROADCAST_BYTES, SALTS = 20_000, 8 << 20, 64


def level_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> the same with weight and target.

    Sources in code-point order, null last, take the weights in turn. They share
    share * (all sizes) by weight; a target stops at cap * source_size and the excess is
    reshared by weight until none is above. That is the level L with
    target = min(cap * size, L * weight); sorted by cap * size / weight, the level is the
    largest one that its own source does not exceed. The windows see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "rank")
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))))
    ranked = (
        sizes.withColumn("rank", F.row_number().over(by_name))
        .withColumn("weight", w)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("goal", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    )
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = ranked.withColumn("level", (F.col("goal") - before) / left)
    top = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy())
    # a share above the cap leaves no such level: then every source takes its cap
    return levels.withColumn("target", F.least("most", F.coalesce(top * F.col("weight"), F.col("most")))).select(
        "source", "source_size", "weight", "target"
    )


def uniform(seed: int, key: Column, text: Column, nth: Column) -> Column:
    """A number in [0, 1) that depends on seed, key, text and nth alone: 52 bits of an MD5 digest."""
    named = F.coalesce(key.cast("string"), F.lit("null"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), named, F.md5(F.coalesce(text, F.lit(""))), nth.cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def numbered(docs: DataFrame, repeated: DataFrame, keys: Sequence[Column], nth: str) -> DataFrame:
    """docs with each row's number, from 1, among the rows with the same keys; repeated: the keys of more than one row.

    Rows are numbered within the partition that they lie in, and the counts of the partitions before
    are added, so no task sees all rows of a key, however many there are.
    """
    if repeated.isEmpty():
        return docs.withColumn(nth, F.lit(1).cast("long"))
    at, own = unused_name(docs, "row"), unused_name(docs, "key")
    placed = docs.withColumn(own, F.struct(*keys)).withColumn(at, F.struct(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")))
    placed = cut(placed)  # places have to stay the same from here on
    again = repeated.select(F.struct(*repeated.columns).alias(own))
    same = placed.join(again.hint("shuffle_hash"), own, "left_semi").select(F.col(own).alias("k"), F.col(at).alias("at"))
    counts = same.groupBy("k", F.col("at.part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("k").alias("_k"), F.col("part").alias("_part"), before.alias("_before"))
    inside = F.row_number().over(Window.partitionBy("k", "at.part").orderBy("at.id"))
    ranked = same.withColumn("n", inside).join(counts, (F.col("k") == F.col("_k")) & (F.col("at.part") == F.col("_part")))
    ranks = ranked.select(F.col("at").alias(at), (F.col("n") + F.col("_before")).alias(nth))
    return placed.join(ranks, at, "left").withColumn(nth, F.coalesce(nth, F.lit(1).cast("long"))).drop(at, own)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """docs plus a struct column `mix`: size, source_size, target, rate and copies.

    Null and empty texts have size 0, and a very long text counts with all its words; a source without words has rate 0. A null source is a
    source of its own. A row's draw follows from its id and text, and rows that repeat both are numbered, so
    rows without ids draw each for themselves and reruns agree. Sources of equal ratios are levelled in their order.
    An empty table gives an empty one. Other columns pass through; one named `mix` is replaced.
    """
    docs = docs.drop("mix")
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    # a narrow row for each document tells the sources' sizes and which rows are repeated
    rows = docs.groupBy(F.col(source).alias("source"), F.col(key).cast("string").alias("key"), digest.alias("digest")).agg(
        F.sum(word_count(F.col(text))).alias("size"), F.count(F.lit(1)).alias("n")
    )
    rows = cut(rows)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = cut(
        level_targets(sizes, weights, share, cap).withColumn(
            "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        )
    )
    nth = unused_name(docs, "nth")
    again = rows.filter("n > 1").select(F.col("source").cast("string").alias("source"), "key", "digest").distinct()
    same_row = [F.col(source).cast("string").alias("source"), F.col(key).cast("string").alias("key"), digest.alias("digest")]
    docs = numbered(docs, cut(again), same_row, nth)
    side = rates.select(F.struct("source", "source_size", "target", "rate").alias("_side"))
    same = F.col(f"d.{source}").eqNullSafe(F.col("s._side.source"))
    if small_enough(rates, BROADCAST_ROWS, BROADCAST_BYTES):
        joined = docs.alias("d").join(F.broadcast(side.alias("s")), same)
    else:  # one source may hold a third of the rows: each is dealt to SALTS places
        salt = unused_name(docs, "salt")
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(F.col(key), F.col(nth)), F.lit(SALTS)))
        copies = side.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.alias("d").join(copies.alias("s"), same & (F.col(f"d.{salt}") == F.col(f"s.{salt}")))
    rate = F.col("s._side.rate")
    whole = F.floor(rate)
    copies = whole + (uniform(seed, F.col(f"d.{key}"), F.col(f"d.{text}"), F.col(f"d.{nth}")) < rate - whole).cast("long")
    mixed = F.struct(
        word_count(F.col(f"d.{text}")).alias("size"),
        F.col("s._side.source_size").alias("source_size"),
        F.col("s._side.target").alias("target"),
        rate.alias("rate"),
        copies.alias("copies"),
    )
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns if c != nth], mixed.alias("mix"))


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it says, without the column `mix`."""
    out = [c for c in mixed.columns if c != "mix"]
    repeated = mixed.filter(F.col("mix.copies") > 0).withColumn("mix", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in out])


def op2(docs: DataFrame) -> DataFrame:
    m = F.col("mix")
    return mix(docs).select(
        "doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"),
        (m["size"] * m["copies"]).alias("taken"), m["copies"].alias("copies"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest,
         row_number() OVER (PARTITION BY source, doc_id, md5(coalesce(text, ''))) AS nth FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM s
), w AS (
  SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS most FROM r
), g AS (
  SELECT *, most / weight AS ratio, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS goal FROM w
), l AS (
  SELECT *, (goal - coalesce(sum(most) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM g
), t AS (
  SELECT source, source_size, least(most, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER () * weight, most)) AS target FROM l
), x AS (
  SELECT d.doc_id, d.size, d.digest, d.nth, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN
    CAST(CAST(('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || digest || ':' || nth), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM x
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM c
"""
