"""Searches for a part of a text by a written table of grams instead of a scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of the table; a gram's folder follows from its hash, and inside it rows are sorted, so a look-up reads few row groups.
FOLDERS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How texts are folded: `like` finds by case, so only ASCII letters are; `contains` finds whatever the case.
FOLDS = {"like": lambda c: F.translate(c, UPPER, LOWER), "contains": F.lower}


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def write_index(rows: DataFrame, key: str, columns: list[str], path: str, kind: str = "like") -> None:
    """The grams of 1 to 3 characters of (key, columns), each once a row and column: gram, at (the column's place), key.

    Null texts have none. A common gram's rows are dealt over several files, by the key's hash.
    """
    texts = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), FOLDS[kind](F.coalesce(F.col(c), F.lit(""))).alias("t")) for i, c in enumerate(columns)]))
    letters = rows.select(F.col(key), texts.alias("x")).select(key, "x.at", F.filter(F.split("x.t", ""), lambda c: c != "").alias("c"))
    n = F.size("c")
    later = lambda k: F.slice("c", k + 1, F.greatest(n - k, F.lit(0)))
    two, three = F.zip_with("c", later(1), lambda a, b: F.concat(a, b)), F.zip_with(F.zip_with("c", later(1), lambda a, b: F.concat(a, b)), later(2), lambda a, b: F.concat(a, b))
    grams = letters.select(key, "at", F.explode(F.array_distinct(F.filter(F.concat("c", two, three), lambda g: g.isNotNull()))).alias("gram"))
    dealt = grams.withColumn("folder", _folder(F.col("gram"))).repartition("folder", F.pmod(F.xxhash64(key), F.lit(8)))
    dealt.sortWithinPartitions("folder", "gram").write.mode("overwrite").partitionBy("folder").parquet(path)


def needed(query: str, kind: str) -> list[str]:
    """The longest grams of a folded query: of each stretch without wildcards all of three characters, or the stretch itself if it is shorter."""
    stretches = re.split(r"\\.|[%_\\]", query, flags=re.DOTALL) if kind == "like" else [query]
    out: dict[str, None] = {}
    for s in stretches:
        for i in range(max(len(s) - 2, 1)):
            if s:
                out[s[i : i + 3]] = None
    return list(out)


def search(spark: SparkSession, path: str, rows: DataFrame, key: str, columns: list[str], query: str, kind: str = "like") -> DataFrame:
    """The rows any of whose columns holds the query, as a scan would find them; in `like`, % and _ are wildcards.

    Only the query's grams are read: their folders by name, and in them their row groups. Keys that have all of them in one column are looked up
    in rows and compared in full. A query of wildcards alone, or none, has no grams; then all rows are compared.
    """
    folded = query.translate(str.maketrans(UPPER, LOWER)) if kind == "like" else query.lower()
    grams = needed(folded, kind)
    found = [F.col(c).like(f"%{query}%") if kind == "like" else F.lower(c).contains(folded) for c in columns]
    holds = F.coalesce(found[0], F.lit(False))
    for f in found[1:]:
        holds = holds | F.coalesce(f, F.lit(False))
    if not grams:
        return rows.filter(holds)
    folders = {r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(_folder(F.col("g"))).collect()}
    hits = spark.read.schema(f"gram string, at int, {key} {dict(rows.dtypes)[key]}, folder int").parquet(path).filter(F.col("folder").isin(*folders) & F.col("gram").isin(*grams))
    keys = hits.groupBy(key, "at").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(grams)).select(key).distinct()
    return rows.join(keys, key, "left_semi").filter(holds)
