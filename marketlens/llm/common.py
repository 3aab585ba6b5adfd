"""Helpers shared by the operators: tables, words, checkpoints and checked broadcasts."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null; built-in functions only."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    n = F.size(parts)
    first = (F.get(parts, F.lit(0)) == "").cast("int")
    last = ((n > 1) & (F.get(parts, n - 1) == "")).cast("int")
    return (n - first - last).cast("long")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Only where it is unset and the master is local, as in tests, is a temporary folder made.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="marketlens-checkpoint-"))
    return sc.getCheckpointDir()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of this library's own making, wherever it lies."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that df has not got, whatever its case."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"_{stem}{k or ''}" for k in range(len(taken) + 1)) if n not in taken)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once into the shared checkpoint folder, so that lost executors don't undo it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, max_rows: int, max_bytes: int) -> bool:
    """Whether a checkpointed table keeps to both bounds; strings and binaries count by their length."""
    wide = [F.coalesce(F.octet_length(c).cast("long"), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    per_row = sum(wide, F.lit(8 * len(df.columns)).cast("long"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(per_row), F.lit(0)).alias("b")).first()
    return row.n <= max_rows and row.b <= max_bytes


def join_groups(rows: DataFrame, groups: DataFrame, key: str, spread: str, how: str = "inner", salts: int = 64) -> DataFrame:
    """rows joined with a table of one row per group, wherever a group may hold a third of all rows.

    A checked small table is broadcast; beyond the bound each group is dealt to `salts` places
    by the rows' column `spread`. groups should be checkpointed, as it is counted first.
    """
    if small_enough(groups, 20_000, 16 << 20):
        return rows.join(F.broadcast(groups), key, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return salted.join(copies, [key, "_salt"], how).drop("_salt")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string: each byte is mixed in, then eight bits are shifted out."""
    steps = f"list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"
