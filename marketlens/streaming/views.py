"""The append-only view log as a stream, and periodic merges of sheets. Windows are an addition; the log itself isn't."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def utc_instant(ts: Column) -> Column:
    """A time without a zone as the instant in UTC, whatever the session's zone is."""
    return F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone())


def utc_date(instant: Column) -> Column:
    """The date of an instant in UTC."""
    return F.to_utc_timestamp(instant, F.current_timezone()).cast("date")


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of event files as a stream; times get a zone, as watermarks need one."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", utc_instant(F.col("ts")))


def windowed(events: DataFrame, kind: str = "tumbling", late: str = "1 day") -> DataFrame:
    """Views by window; state behind the watermark is dropped. Works on streams and tables."""
    w = {"tumbling": F.window("ts", "1 day"), "sliding": F.window("ts", "7 days", "1 day"), "session": F.session_window("ts", "30 minutes")}[kind]
    views = events.filter("event_type = 'view'").withWatermark("ts", late)
    keys = [w.alias("w")] + ([F.col("user_id")] if kind == "session" else [])
    return views.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select("w.start", "w.end", *(["user_id"] if kind == "session" else []), "n")


def run_once(stream: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """All that is there now, appended to a folder; a later call goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def sync_sheets(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str, every: str = "15 minutes") -> StreamingQuery:
    """Rows of sheets merged batch by batch; merge gets the batch's number, as a batch may come twice after a failure (streaming.sheets keeps a ledger of them)."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def _tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", utc_instant(F.col("ts")))
    return windowed(events).select(utc_date(F.col("start")).alias("day"), "n")


QUERIES = {"tumbling_views": _tumbling}
SQL = {"tumbling_views": "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1"}
