"""Readers: uploaded CSV with guessed roles, directories of CSV, points of interest in JSON, HTML pages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import emails
from ..operators.numbering import numbered
from . import xlsx

#: What a header says about its column, the first that fits.
STOCK_ROLES = (("brand", "brand|maker"), ("name", "name|product|item"), ("size", "size|format"), ("price", "price|cost"), ("quantity", "qty|quantity|stock|count"))
REVIEW_ROLES = (("brand", "brand|maker"), ("name", "name|product|item"), ("date", "date|day"), ("rating", "rating|score"), ("notes", "note|comment|review"), ("pairing", "pair|drink"))
#: The columns of a listing file, in order.
LISTING = ("name", "email", "phone", "website", "address", "city", "state", "zip", "source", "rating", "reviews", "status", "notes")


def read_csv(spark: SparkSession, path: str, glob: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV with a header and doubled quotes; cells are trimmed, blank lines dropped, all columns are text. multi_line: cells may hold line ends, and a file is read whole."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("multiLine", multi_line)
    return (reader.option("pathGlobFilter", glob) if glob else reader).csv(path)


def column_roles(columns: Sequence[str], roles: Sequence[tuple[str, str]] = STOCK_ROLES) -> dict[str, str]:
    """Role -> column: each header takes the first role that fits; of headers with one role the last counts."""
    out: dict[str, str] = {}
    for c in columns:
        for role, pattern in roles:
            if re.search(pattern, c, re.IGNORECASE):
                out[role] = c
                break
    return out


def read_upload(spark: SparkSession, path: str, roles: Sequence[tuple[str, str]] = STOCK_ROLES) -> DataFrame:
    """An upload, CSV or XLSX by its name's ending, with its columns by role, null where no header fits, and the rows numbered from 0 in the file's order.

    Rows without brand and name are dropped first. Rows may be any number: they are sorted by their place in the file, not read in one task.
    """
    if path.lower().endswith(".xlsx"):
        xlsx.register(spark)
        raw = spark.read.format("xlsx").load(path).withColumn("_at", F.struct(F.lit(0).cast("long"), "_row")).drop("_file", "_row")
    else:
        raw = read_csv(spark, path).withColumn("_at", F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    found = column_roles([c for c in raw.columns if c != "_at"], roles)
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    named = raw.select("_at", *[text(found[r]).alias(r) if r in found else F.lit(None).cast("string").alias(r) for r, _ in roles])
    full = named.filter(F.coalesce("brand", "name").isNotNull())
    return numbered(full, [F.col("_at")], "row", start=0).drop("_at")


def read_listings(spark: SparkSession, folder: str, multi_line: bool = False) -> DataFrame:
    """All listing files of a folder but merged ones, with the file's name and all columns, missing ones as empty text."""
    rows = read_csv(spark, folder, "*.csv", multi_line).withColumn("file", F.col("_metadata.file_name")).filter(~F.col("file").contains("MASTER"))
    return rows.select("file", *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in LISTING])


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a map extract: name, contacts and coordinates, by tag or its alternative, of the point or its centre."""
    point = "lat: double, lon: double"
    schema = f"elements array<struct<{point.replace(':', ':')}, center: struct<{point}>, tags: map<string, string>>>"
    e = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("elements").alias("e"))
    tag = lambda *keys: F.coalesce(*[F.nullif(F.try_element_at(F.col("e.tags"), F.lit(k)), F.lit("")) for k in keys])
    street = F.concat_ws(" ", tag("addr:housenumber"), tag("addr:street"))
    return e.select(
        tag("name").alias("name"), F.regexp_replace(tag("phone", "contact:phone"), "^tel:", "").alias("phone"), tag("website", "contact:website").alias("website"), tag("email", "contact:email").alias("email"),
        street.alias("address"), tag("addr:city").alias("city"), tag("addr:state").alias("state"), tag("addr:postcode").alias("zip"),
        F.coalesce("e.lat", "e.center.lat").alias("lat"), F.coalesce("e.lon", "e.center.lon").alias("lng"),
    ).filter(F.length("name") >= 3)


def page_emails(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `emails`: addresses in mailto links first, then those in the text, distinct."""
    linked = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(r"""(?i)href=["']mailto:([^"'?]+)"""), F.lit(1))
    return pages.withColumn("emails", F.array_distinct(F.concat(F.transform(linked, F.lower), emails(F.col(html)))))


def read_result_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Saved answers of a paged service, a JSON document each with `results`: all results, each place once, from the first page that has it."""
    schema = "page int, results array<struct<place_id: string, name: string, formatted_address: string, formatted_phone_number: string, website: string>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(folder).select("page", F.posexplode("results").alias("place", "r"))
    first = rows.filter(F.length("r.name") > 0).groupBy(F.coalesce("r.place_id", F.concat_ws("|", "r.name", "r.formatted_address")).alias("key")).agg(F.min_by("r", F.struct("page", "place")).alias("r"))
    return first.select("key", F.col("r.name").alias("name"), F.col("r.formatted_address").alias("address"), F.col("r.formatted_phone_number").alias("phone"), F.col("r.website").alias("website"))


def inline(spark: SparkSession, columns: str, rows: Sequence[tuple]) -> DataFrame:
    """A relation of constants: a city list, a template, a seed."""
    return spark.createDataFrame(list(rows), columns)
