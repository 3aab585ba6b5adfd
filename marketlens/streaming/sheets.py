"""Sheets merged into the stock batch by batch, with a ledger: a repeated batch changes nothing, and a broken sheet stops no other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sheet_id
from ..operators.match import sheet_lookup
from ..operators.writes import sync_stock

LEDGER = "batch long, shop_id long, synced long, unmatched long, error string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A row for each batch and shop: rows taken, rows that found no match, and the error for which a sheet was left out."""
    try:
        return spark.read.schema(LEDGER).parquet(f"{path}/ledger")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def last_batch(spark: SparkSession, path: str) -> int:
    """The last batch that was merged in full; -1 before any."""
    return ledger(spark, path).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]


def stock(spark: SparkSession, path: str, first: DataFrame) -> DataFrame:
    """The stock after the last batch; `first` before any."""
    last = last_batch(spark, path)
    return spark.read.parquet(f"{path}/stock-{last}") if last >= 0 else first


def merge_batch(rows: DataFrame, batch: int, path: str, first: DataFrame, products: DataFrame, sizes: DataFrame) -> None:
    """Sheet rows (shop_id, url, position, brand, name, size, price, quantity, problem) of any number of shops into the stock under path.

    A sheet whose URL has no id, or any of whose rows has a problem (the reader's word for what it couldn't read), is left out as a whole, with its error in the ledger. The
    batch's ledger is written last, after its version of the stock: what fails before is done again from the version before, and a batch that the ledger has is
    passed over.
    """
    spark = rows.sparkSession
    last = last_batch(spark, path)
    if batch <= last:
        return
    broken = F.when(F.first("url", ignorenulls=True).isNull() | sheet_id(F.first("url", ignorenulls=True)).isNull(), "no sheet id in the URL").otherwise(F.first("problem", ignorenulls=True))
    states = rows.groupBy("shop_id").agg(broken.alias("error"))
    good = rows.join(states.filter("error IS NULL").select("shop_id"), "shop_id", "left_semi")
    found = sheet_lookup(good.select("shop_id", "position", "brand", "name", "size", "price", "quantity"), products, sizes)
    before = stock(spark, path, first).select("shop_id", "product_id", "size_id", "price", "quantity")
    sync_stock(before, found).write.mode("overwrite").parquet(f"{path}/stock-{batch}")
    counts = found.groupBy("shop_id").agg(F.count_if(F.col("reason").isNull()).alias("synced"), F.count("reason").alias("unmatched"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    entry = states.join(counts, "shop_id", "left").select(F.lit(batch).cast("long").alias("batch"), F.col("shop_id").cast("long").alias("shop_id"), zero("synced"), zero("unmatched"), "error")
    entry.unionByName(spark.createDataFrame([(batch, None, 0, 0, None)], LEDGER)).coalesce(1).write.mode("append").parquet(f"{path}/ledger")


def merger(path: str, first: Callable[[SparkSession], DataFrame], products: Callable[[SparkSession], DataFrame], sizes: Callable[[SparkSession], DataFrame]) -> Callable[[DataFrame, int], None]:
    """merge_batch as a foreachBatch function; the tables are read anew for each batch."""
    return lambda rows, batch: merge_batch(rows, batch, path, first(rows.sparkSession), products(rows.sparkSession), sizes(rows.sparkSession))
