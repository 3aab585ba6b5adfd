"""Files that come and go: each query writes a given table in a file's form to the shared folder and reads it back with the library's reader."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_count, parse_price
from ..operators.kept import shared_folder
from ..roles import role, with_roles
from ..sources import paged, readers, writers

#: Items of a workbook, at most.
BOOK_ROWS = 100_000
#: Results of a page, and the queries in the order in which their places count.
PAGE = 20
ASKED = ("shops near 0", "shops near 1", "shops near 2")


def _folder(s) -> str:
    return f"{shared_folder(s)}/exchange-{uuid.uuid4().hex}"


def collection(s, d) -> DataFrame:
    """All items as spreadsheets of eight columns, read back as text."""
    items = role(s, d, "item").join(role(s, d, "product").select("product_id", "brand", "name"), "product_id", "left")
    rows = items.selectExpr("brand", "name", "status", "quantity", "price", "date_format(created_at, 'yyyy-MM-dd') AS bought", "CASE WHEN item_id % 4 = 0 THEN '' ELSE '<note> & \"' || item_id || '\"' END AS notes", "item_id")
    books = 1 + rows.count() // BOOK_ROWS
    path = _folder(s)
    writers.write_collection(rows.repartition(books, "item_id"), path)
    found = s.read.format("xlsx").load(path)
    return found.select(*[F.col(f"`{name}`").alias(c) for name, c in writers.COLLECTION]).withColumns({"quantity": F.col("quantity").cast("long"), "price": F.nullif("price", F.lit("")).cast("double")})


def listing_files(s, d) -> DataFrame:
    """Shops as listing files with commas, quotes and line ends in their cells, beside a merged file that is passed over."""
    shops = role(s, d, "shop").selectExpr("'Shop \"' || shop_id || '\", ' || name AS name", "city", "CASE WHEN shop_id % 3 <> 0 THEN state END AS state", "CASE WHEN shop_id % 2 = 0 THEN 'line one\nline ' || shop_id END AS notes", "CAST(shop_id AS STRING) AS zip")
    path = _folder(s)
    writers.write_listings(shops.withColumn("source", F.lit("scan")), path)
    return readers.read_listings(s, path, multi_line=True).select("name", "email", "city", "state", "zip", "source", "notes")


def uploaded(s, d) -> DataFrame:
    """Products as an upload with headers of its own, blank rows among them; columns by role, lenient numbers."""
    rows = role(s, d, "product").selectExpr(
        "CASE WHEN product_id % 9 = 0 THEN '' ELSE brand END AS `Maker`", "CASE WHEN product_id % 9 = 0 THEN '  ' ELSE name || ', ' || product_id END AS `Product Name`", "kind AS `Format`", "'$' || CAST(CAST(list_price AS INT) AS STRING) AS `Unit Cost`",
        "CASE WHEN product_id % 5 = 0 THEN '' ELSE product_id % 7 || ' boxes' END AS `In Stock`",
    )
    path = _folder(s)
    writers.write_csv(rows, path)
    found = readers.read_upload(s, path)
    dense = found.agg((F.max("row") + 1 == F.count(F.lit(1))).alias("dense"))  # one row
    return found.crossJoin(F.broadcast(dense)).select("brand", "name", "size", parse_price(F.col("price")).alias("price"), parse_count(F.col("quantity")).alias("quantity"), "dense")


def poi(s, d) -> DataFrame:
    """Shops as elements of map extracts, some with the point's own coordinates and some with a centre, contacts under either tag."""
    e = role(s, d, "shop").selectExpr(
        "shop_id % 7 AS part", "shop_id",
        "named_struct('lat', CASE WHEN shop_id % 2 = 0 THEN lat END, 'lon', CASE WHEN shop_id % 2 = 0 THEN lng END, 'center', named_struct('lat', CASE WHEN shop_id % 2 = 1 THEN lat END, 'lon', CASE WHEN shop_id % 2 = 1 THEN lng END),"
        " 'tags', map_from_arrays(array('name', CASE WHEN shop_id % 2 = 0 THEN 'phone' ELSE 'contact:phone' END, 'addr:housenumber', 'addr:street', 'addr:city', 'website'),"
        " array(CASE WHEN shop_id % 11 = 0 THEN 'ab' ELSE name END, 'tel:' || shop_id, CAST(shop_id AS STRING), 'Main St', city, ''))) AS e",
    )
    path = _folder(s)
    e.groupBy("part", F.floor(F.col("shop_id") / 1000)).agg(F.collect_list("e").alias("elements")).select("elements").write.option("maxRecordsPerFile", 1).json(path)  # an extract has a bounded number of elements
    return readers.read_places(s, path).select("name", "phone", "website", "address", "city", "lat", "lng")


def _answers(shops: DataFrame) -> DataFrame:
    """A paged service's answers about all shops: three queries, the third repeating some of the first's places, pages of a fixed size with a token each."""
    asked = shops.withColumn("k", F.explode(F.when(F.col("shop_id") % 6 == 0, F.array(F.lit(0), F.lit(2))).otherwise(F.array((F.col("shop_id") % 3).cast("int")))))
    paged_ = asked.withColumns({"query": F.concat(F.lit("shops near "), F.col("k").cast("string")), "page": F.floor(F.col("shop_id") / (3 * PAGE))})
    one = F.struct(
        F.col("shop_id").cast("string").alias("place_id"), "name", F.concat("city", F.lit(", 0"), F.format_string("%04d", F.col("shop_id") % 10_000)).alias("formatted_address"),
        F.struct(F.struct("lat", "lng").alias("location")).alias("geometry"), F.struct(F.concat(F.lit("p"), "query").alias("formatted_phone_number")).alias("details"), (F.col("k") + 1.5).alias("rating"),
    )
    found = paged_.groupBy("query", "page").agg(F.array_sort(F.collect_list(F.struct("shop_id", one.alias("r")))).alias("r"))
    last = found.groupBy("query").agg(F.max("page").alias("last"))
    after = F.when(F.col("page") < F.col("last"), F.concat(F.lit("t"), (F.col("page") + 1).cast("string")))
    body = F.to_json(F.struct(F.col("r.r").alias("results"), after.alias("next_page_token")))
    return found.join(last, "query").select("query", F.when(F.col("page") == 0, "").otherwise(F.concat(F.lit("t"), F.col("page").cast("string"))).alias("token"), body.alias("body"))


def paged_places(s, d) -> DataFrame:
    path = _folder(s)
    paged.save_answers(_answers(role(s, d, "shop").select("shop_id", "name", "city", "lat", "lng")), path)
    return paged.places(s, path, list(ASKED), "Salem", "OR").select("name", "address", "state", "zip", "phone", "rating", "lat", F.col("place_id").cast("long").alias("place_id"))


def view_log(s, d) -> DataFrame:
    """The view log written in three appends, a day's part at a time."""
    path = _folder(s)
    views = role(s, d, "shop_view")
    for k in range(3):
        writers.append_log(views.filter(F.col("view_id") % 3 == k), path)
    return s.read.parquet(path).groupBy("shop_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("view_id").alias("different"))


def mail(s, d) -> DataFrame:
    """Addresses of all documents taken as pages: those linked first, then those in the text."""
    pages = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("<a class=x href='mailto:Info"), F.col("doc_id") % 50, F.lit("@Example.org?subject=a'>mail</a> "), F.coalesce("text", F.lit(""))).alias("html"))
    return readers.page_emails(pages).select("doc_id", F.get("emails", F.lit(0)).alias("first"), F.array_join(F.array_sort("emails"), " ").alias("emails"))


def migrated(s, d) -> DataFrame:
    """Steps over the shops' table by a ledger that holds the first: each other one is made once, however often the steps are asked for."""
    path, made = _folder(s), []
    shops = role(s, d, "shop").select("shop_id", "name", "verified")

    def step(name: str, change) -> None:
        before = s.read.parquet(f"{path}/{made[-1]}") if made else shops
        change(before).write.parquet(f"{path}/{name}")
        made.append(name)

    steps = [("never", lambda: step("never", lambda t: t.limit(0))), ("add_rank", lambda: step("add_rank", lambda t: t.withColumn("rank", F.col("shop_id") * 2))), ("rename", lambda: step("rename", lambda t: t.withColumn("name", F.upper("name"))))]
    ledger = s.createDataFrame([("never",)], "name string")
    for _ in range(2):
        ledger = writers.apply_once(ledger, steps)
    return s.read.parquet(f"{path}/{made[-1]}").crossJoin(F.broadcast(ledger.agg(F.count(F.lit(1)).alias("steps"))))


def documents_json(s, d) -> DataFrame:
    """All items as JSON documents, read back."""
    path = _folder(s)
    writers.as_json(role(s, d, "item").select("item_id", F.struct("user_id", "status").alias("by"), "price")).write.text(path)
    return s.read.schema("item_id long, by struct<user_id: long, status: string>, price double").json(path).select("item_id", "by.user_id", "by.status", "price")


QUERIES = {
    "collection_sheets": collection, "listing_files": listing_files, "upload_by_roles": uploaded, "poi_places": poi, "paged_places": paged_places, "view_log": view_log, "page_mail": mail, "migrated_once": migrated, "items_as_json": documents_json,
}

_MAIL = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), lambda x: lower(x))"

SQL = {
    "collection_sheets": with_roles(
        """SELECT coalesce(brand, '') AS brand, coalesce(name, '') AS name, '' AS size_name, status, CAST(quantity AS BIGINT) AS quantity, price, strftime(item.created_at, '%Y-%m-%d') AS bought,
  CASE WHEN item_id % 4 = 0 THEN '' ELSE '<note> & "' || item_id || '"' END AS notes FROM item LEFT JOIN product USING (product_id)""", "item", "product"
    ),
    "listing_files": with_roles(
        "SELECT 'Shop \"' || shop_id || '\", ' || name AS name, '' AS email, city, CASE WHEN shop_id % 3 <> 0 THEN state ELSE '' END AS state, CAST(shop_id AS VARCHAR) AS zip, 'scan' AS source, CASE WHEN shop_id % 2 = 0 THEN 'line one' || chr(10) || 'line ' || shop_id ELSE '' END AS notes FROM shop", "shop"
    ),
    "upload_by_roles": with_roles(
        "SELECT brand, name || ', ' || product_id AS name, kind AS size, nullif(CAST(CAST(floor(list_price) AS INT) AS DOUBLE), 0) AS price, CASE WHEN product_id % 5 = 0 THEN NULL ELSE CAST(product_id % 7 AS INT) END AS quantity, TRUE AS dense FROM product WHERE product_id % 9 <> 0", "product"
    ),
    "poi_places": with_roles("SELECT name, CAST(shop_id AS VARCHAR) AS phone, CAST(NULL AS VARCHAR) AS website, shop_id || ' Main St' AS address, city, lat, lng FROM shop WHERE shop_id % 11 <> 0", "shop"),
    "paged_places": with_roles(
        """SELECT name, city AS address, 'OR' AS state, lpad(CAST(shop_id % 10000 AS VARCHAR), 5, '0') AS zip, 'pshops near ' || shop_id % 3 AS phone, shop_id % 3 + 1.5::DOUBLE AS rating, lat, shop_id AS place_id FROM shop""", "shop"
    ),
    "view_log": with_roles("SELECT shop_id, count(*) AS n, count(*) AS different FROM shop_view GROUP BY 1", "shop_view"),
    "page_mail": f"SELECT doc_id, 'info' || doc_id % 50 || '@example.org' AS first, array_to_string(list_sort(list_distinct(list_append({_MAIL}, 'info' || doc_id % 50 || '@example.org'))), ' ') AS emails FROM documents",
    "migrated_once": with_roles("SELECT shop_id, upper(name) AS name, verified, shop_id * 2 AS rank, 3 AS steps FROM shop", "shop"),
    "items_as_json": with_roles("SELECT item_id, user_id, status, price FROM item", "item"),
}
