"""Writers: listing files, exports and nested JSON."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import xlsx
from .readers import LISTING

#: The columns of a collection's sheet, in order, and where each comes from.
COLLECTION = (("Brand", "brand"), ("Name", "name"), ("Size", "size_name"), ("Status", "status"), ("Qty", "quantity"), ("Purchase Price", "price"), ("Purchase Date", "bought"), ("Notes", "notes"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write_listings(rows: DataFrame, path: str) -> None:
    """The columns of a listing file in their order, missing ones empty; sorted by state, whatever its case, and city."""
    full = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in LISTING])
    write_csv(full.orderBy(F.upper("state"), "city", "name"), path)


def write_collection(items: DataFrame, path: str) -> None:
    """A collection as spreadsheets under path, one a partition: eight columns, what is missing empty, and the status 'owned' where there is none."""
    xlsx.register(items.sparkSession)
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in items.columns else F.lit("")
    rows = items.select(*[(F.coalesce(F.nullif(value(c), F.lit("")), F.lit("owned")) if c == "status" else value(c)).alias(name) for name, c in COLLECTION])
    rows.write.format("xlsx").mode("append").save(path)


def fill_emails(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Addresses found later, merged back by name and city; an address that is there stays. found has one row per key."""
    e = found.select("name", "city", F.col("email").alias("_email"))
    return rows.join(e, ["name", "city"], "left").withColumn("email", F.coalesce(F.nullif("email", F.lit("")), "_email")).drop("_email")


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON document per row; nested columns stay nested."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def append_log(rows: DataFrame, path: str) -> None:
    """Rows added to a log, which is never rewritten."""
    rows.write.mode("append").parquet(path)


def write_template(spark: SparkSession, path: str, columns: Sequence[str], example: Sequence[str]) -> None:
    """A CSV with a header and one row that shows how to fill it in."""
    write_csv(spark.createDataFrame([tuple(example)], ", ".join(f"`{c}` string" for c in columns)).coalesce(1), path)


def apply_once(ledger: DataFrame, steps: Sequence[tuple[str, Callable[[], None]]]) -> DataFrame:
    """Named steps in order, those that the ledger (name) doesn't hold yet; the ledger after them."""
    done = {r.name for r in ledger.collect()}  # one row for each step ever made
    new = [(name,) for name, step in steps if name not in done and (step() or True)]
    return ledger.unionByName(ledger.sparkSession.createDataFrame(new, "name string"))
