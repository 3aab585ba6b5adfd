"""URL filters by a Bloom filter cascade, with DataFrame operations only.

Alternate levels encode the listed keys and the false positives met over the corpus's
complete key universe, so a probe is exact for every key of the corpus and needs no join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, unused_name

#: A level's bits travel inside the query, so a list may have as many keys as keep each level under this size.
MOST_BYTES = 8 << 20


@dataclass(frozen=True)
class Level:
    bits: bytes
    n_hashes: int
    seed: int

    def probe(self, key: Column) -> Column:
        n = F.lit(8 * len(self.bits))

        def set_at(h: Column) -> Column:
            at = F.pmod(F.xxhash64(F.lit(self.seed), h, key), n)
            byte = F.conv(F.hex(F.substring(F.lit(self.bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1

        return F.forall(F.array(*[F.lit(h) for h in range(self.n_hashes)]), set_at)


@dataclass(frozen=True)
class BloomCascade:
    """Levels 1, 3, ... encode listed keys, levels 2, 4, ... the others that passed so far."""

    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """True for listed keys; exact for each key of the universe that it was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            # failing level i+1 means: listed if it encodes keys that aren't, and the other way round
            answer = F.when(self.levels[i].probe(key), answer).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(answer, F.lit(False))


def _encode(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    n_hashes = max(1, round(-math.log2(rate)))
    n_bytes = max(8, math.ceil(n * n_hashes * 1.4427 / 8))
    if n_bytes > MOST_BYTES:
        raise ValueError(f"a level would take {n_bytes} bytes, more than {MOST_BYTES}: join with so long a list instead")
    at = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.lit(h), F.col("key")), F.lit(8 * n_bytes)) for h in range(n_hashes)]))
    # a row per set byte: as large as the filter, which the listed keys bound
    rows = keys.select(at.alias("at")).groupBy(F.shiftright("at", 3).alias("byte")).agg(
        F.expr("bit_or(shiftleft(1, cast(pmod(at, 8) as int)))").alias("bits")
    )
    bits = bytearray(n_bytes)
    for row in rows.toLocalIterator():
        bits[row.byte] = row.bits
    return Level(bytes(bits), n_hashes, seed)


def build_cascade(universe: DataFrame, listed: DataFrame, max_levels: int = 64) -> BloomCascade:
    """Both tables have a string column `key`; nulls and repeats are ignored.

    The first level's rate is listed / universe, so what passes it wrongly is about as large
    as the list, and each further level halves it: the whole is bounded by the list's
    length times log2(universe / listed), however large the corpus is.
    """
    listed = cut(listed.select("key").filter(F.col("key").isNotNull()).distinct())
    n = listed.count()
    if n == 0:
        return BloomCascade(())
    size = universe.agg(F.approx_count_distinct("key").alias("n")).first().n
    levels = [_encode(listed, n, min(0.5, n / max(size, 1)), 1)]
    passed = universe.select("key").filter(F.col("key").isNotNull() & levels[0].probe(F.col("key"))).distinct()
    others = cut(passed.join(listed, "key", "left_anti"))
    sides = [others, listed]
    while (n := (side := sides[(len(levels) + 1) % 2]).count()) > 0:
        if len(levels) == max_levels:
            raise RuntimeError("the cascade does not end")
        levels.append(_encode(side, n, 0.5, len(levels) + 1))
        other = len(levels) % 2
        sides[1 - other] = cut(sides[1 - other].filter(levels[-1].probe(F.col("key"))))
        if sides[1 - other].isEmpty():
            break
    return BloomCascade(tuple(levels))


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, depths: Sequence[int], lengths: Sequence[int]) -> Column:
    """Every key that a rule for this host and path could have, for rules of so many labels and paths of such lengths.

    Only the host's last labels are looked at, so a host of very many costs no more than reading it.
    """
    domains = F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in depths]))
    heads = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(domains, lambda d: F.transform(heads, lambda p: F.concat(d, p))))
    return F.when(host != "", keys).otherwise(F.array().cast("array<string>"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """pages plus host, path, rule and verdict.

    rules: (allow or block, host and path). A rule fits its host and all subdomains where the
    path starts with the rule's; the longest wins, of equally long ones the greater by code points, and default holds where none fits. A null or
    malformed url has an empty host and path and gets default. A url takes time by its length, however many
    labels its host has. Of rules with one key the last counts. Columns of the same names are
    replaced; other columns, repeated rows and an empty table pass through.
    """
    spark = pages.sparkSession
    rules = [(verdict, key) for key, verdict in {key: verdict for verdict, key in rules}.items()]
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    lengths = sorted({len(key) - key.index("/") for _, key in rules}) or [1]
    depths = sorted({key.split("/")[0].count(".") + 1 for _, key in rules}) or [1]
    keys = candidate_keys(F.col("host"), F.col("path"), depths, lengths)
    mark = unused_name(pages, "keys")
    listed = spark.createDataFrame([(key,) for _, key in rules], "key string")
    blocked = spark.createDataFrame([(key,) for verdict, key in rules if verdict == "block"], "key string")
    fits = build_cascade(pages.select(F.explode(keys).alias("key")), listed)
    blocks = build_cascade(listed, blocked)  # only rules are asked for, so they are its universe
    fitting = F.filter(F.col(mark), lambda k: fits.contains(k))
    longest = F.array_max(F.transform(fitting, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))["key"]
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocks.contains(F.col("rule")), "block").otherwise("allow")
    return pages.withColumn(mark, keys).withColumn("rule", longest).withColumn("verdict", verdict).drop(mark)


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def op6(pages: DataFrame) -> DataFrame:
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), r AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
