"""A paged service as a data source: spark.read.format("paged"), a partition for each query and its chain of pages inside."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.text import compact, zip_code

SCHEMA = "query string, page int, position int, place_id string, name string, formatted_address string, lat double, lng double, rating double, ratings long, phone string, website string"
#: The token of a query's first page.
FIRST = ""


def save_answers(answers: DataFrame, path: str) -> None:
    """Answers (query, token, body: JSON) in the form in which the source looks them up."""
    answers.select("query", "token", "body").write.mode("overwrite").partitionBy("query").parquet(path)


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, path: str, queries: list[str]) -> None:
        self.path, self.queries = path, queries

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """The pages of a query, each found by the token that the one before names; a partition that is read again gives the same rows."""
        fs, inner = _open(self.path)
        saved = pads.dataset(inner, filesystem=fs, partitioning=pads.partitioning(flavor="hive"), format="parquet")
        token, page, seen = FIRST, 0, set()
        while token is not None and token not in seen:
            seen.add(token)
            found = saved.to_table(columns=["body"], filter=(pads.field("query") == partition.value) & (pads.field("token") == token)).column("body").to_pylist()
            if not found:
                if page:
                    raise OSError(f"the page after page {page} of {partition.value!r} is missing")
                return
            body = json.loads(found[0])
            for i, x in enumerate(body.get("results") or []):
                place = (x.get("geometry") or {}).get("location") or {}
                details = x.get("details") or {}
                number = lambda v, kind: None if v is None else kind(v)
                yield (
                    partition.value, page + 1, i, x.get("place_id"), x.get("name"), x.get("formatted_address"), number(place.get("lat"), float), number(place.get("lng"), float), number(x.get("rating"), float),
                    number(x.get("user_ratings_total"), int), details.get("formatted_phone_number"), details.get("website"),
                )
            token, page = body.get("next_page_token"), page + 1


class PagedSource(DataSource):
    """Options: path, a folder of saved answers, and queries, a JSON list of query strings."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], json.loads(self.options["queries"]))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def places(spark: SparkSession, path: str, queries: list[str], city: str, state: str) -> DataFrame:
    """All queries' places as listings, each name once (letters and digits, whatever its case): from the first query, page and place that have it."""
    register(spark)
    rows = spark.read.format("paged").option("path", path).option("queries", json.dumps(queries)).load()
    rank = F.coalesce(*[F.when(F.col("query") == q, i) for i, q in enumerate(queries)])
    first = partial(F.min_by, ord=F.struct(rank, "page", "position"))
    best = rows.groupBy(compact(F.col("name")).alias("key")).agg(first(F.struct(*[c for c in rows.columns])).alias("r"))
    r = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(""))
    return best.select(
        r("name").alias("name"), F.split(r("formatted_address"), ",")[0].alias("address"), F.lit(city).alias("city"), F.lit(state).alias("state"), zip_code(r("formatted_address")).alias("zip"), r("phone").alias("phone"), r("website").alias("website"),
        F.col("r.lat").alias("lat"), F.col("r.lng").alias("lng"), F.col("r.rating").alias("rating"), F.col("r.ratings").alias("ratings"), F.col("r.place_id").alias("place_id"),
    )
