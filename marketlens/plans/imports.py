"""Uploads and synced sheets: best matches of brand, name and size, exact lookups in stages with their reasons, and the stock after them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.match import best_match, import_preview, sheet_lookup
from ..operators.writes import sync_stock
from ..roles import role, with_roles
from .upkeep import SIZES, _sizes

#: Reviews are matched from this similarity on.
LEAST_REVIEW = 0.35


def upload(s, d) -> DataFrame:
    """An upload with a row for every product: names without inner vowels or with letters changed, some without brand or name, prices and counts as people write them."""
    return role(s, d, "product").selectExpr(
        "product_id AS position",
        "CASE WHEN product_id % 7 = 0 THEN ' ' WHEN product_id % 7 = 1 THEN replace(brand, '#', ' no ') ELSE brand END AS brand",
        "CASE WHEN product_id % 19 = 0 THEN NULL WHEN product_id % 3 = 0 THEN regexp_replace(name, '[aeiou]', '') WHEN product_id % 3 = 1 THEN upper(replace(name, 'e', 'oo')) ELSE name || '!' END AS name",
        "CASE product_id % 4 WHEN 0 THEN 'shrt' WHEN 1 THEN 'Grand!' WHEN 2 THEN 'wid' END AS size",
        "CASE WHEN product_id % 5 = 0 THEN 'ask' ELSE '$' || CAST(CAST(floor(list_price) AS BIGINT) AS STRING) || '.50 each' END AS price",
        "CASE WHEN product_id % 6 = 0 THEN '' ELSE CAST(product_id % 30 AS STRING) || ' boxes' END AS quantity",
    )


def reviews(s, d) -> DataFrame:
    """The best matches of an upload of reviews: the same rows, from a similarity of 0.35 on."""
    rows = upload(s, d).selectExpr("position", "lower(trim(regexp_replace(lower(concat_ws(' ', nullif(trim(brand), ''), nullif(trim(name), ''))), '[^a-z0-9 ]', ''))) AS text")
    products = role(s, d, "product").selectExpr("product_id AS id", "trim(regexp_replace(lower(brand || ' ' || name), '[^a-z0-9 ]', '')) AS text")
    best = best_match(rows.select(F.col("position").alias("row"), "text"), products, LEAST_REVIEW).withColumnRenamed("row", "position")
    return rows.filter("text <> ''").join(best, "position", "left").select("position", F.col("id").alias("product_id"), F.floor(F.col("score") * 100 + 0.5).alias("confidence"))


def sheets(s, d) -> DataFrame:
    """Every shop's sheet: a row for each of its stock rows, typed by hand, with gaps and unknown names."""
    rows = role(s, d, "stock").join(role(s, d, "product").select("product_id", "brand", "name"), "product_id")
    size = F.get(F.array(*[F.lit(n) for n in SIZES]), F.col("size_id") - 1).alias("size_name")
    return rows.select("stock_id", "shop_id", "product_id", "brand", "name", size, "price", "quantity").selectExpr(
        "stock_id * 100000 + product_id AS position", "shop_id",
        "CASE WHEN product_id % 17 = 0 THEN '' ELSE '  ' || upper(brand) END AS brand",
        "CASE WHEN product_id % 34 = 0 THEN ' ' WHEN product_id % 13 = 0 THEN 'no such thing' ELSE replace(name, ' ', '  ') || ' ' END AS name",
        "CASE WHEN product_id % 11 = 0 THEN 'unheard of' ELSE upper(size_name) END AS size",
        "CASE WHEN quantity IS NULL THEN 'ask' ELSE '$' || CAST(CAST(floor(price) AS BIGINT) AS STRING) || '.25' END AS price",
        "CASE WHEN quantity % 2 = 0 THEN CAST(quantity AS STRING) || ' left' ELSE ' ' END AS quantity",
    )


def _looked_up(s, d) -> DataFrame:
    return sheet_lookup(sheets(s, d), role(s, d, "product"), _sizes(s, d))


def _stock(s, d) -> DataFrame:
    """The stock before the sync: what was in it by shop and size of a product."""
    rows = role(s, d, "stock").filter("in_stock AND size_id IS NOT NULL")
    return rows.groupBy("shop_id", "product_id", "size_id").agg(F.max("price").alias("price"), F.max("quantity").alias("quantity"))


QUERIES = {
    "import_preview": lambda s, d: import_preview(upload(s, d), role(s, d, "product"), _sizes(s, d)).select(
        "row", "product_id", "confidence", "size_id", "size_confidence", "price", "quantity"
    ),
    "review_import_preview": reviews,
    "sheet_reasons": lambda s, d: _looked_up(s, d).groupBy("shop_id", F.coalesce("reason", F.lit("synced")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum("product_id").alias("products")),
    "sheet_synced_stock": lambda s, d: sync_stock(_stock(s, d), _looked_up(s, d)).select("shop_id", "product_id", "size_id", "price", "quantity", "synced"),
}

_PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'))"
_UPLOAD = """up AS (SELECT product_id AS position,
  CASE WHEN product_id % 7 = 0 THEN '' WHEN product_id % 7 = 1 THEN replace(brand, '#', ' no ') ELSE brand END AS brand,
  CASE WHEN product_id % 19 = 0 THEN '' WHEN product_id % 3 = 0 THEN regexp_replace(name, '[aeiou]', '', 'g') WHEN product_id % 3 = 1 THEN upper(replace(name, 'e', 'oo')) ELSE name || '!' END AS name,
  CASE product_id % 4 WHEN 0 THEN 'shrt' WHEN 1 THEN 'grand' WHEN 2 THEN 'wid' ELSE '' END AS size,
  CASE WHEN product_id % 5 = 0 THEN NULL ELSE floor(list_price) + 0.5 END AS price, CASE WHEN product_id % 6 = 0 THEN 0 ELSE product_id % 30 END AS quantity FROM product),
 a AS (SELECT *, row_number() OVER (ORDER BY position) - 1 AS row, {plain} AS text FROM up WHERE brand <> '' OR name <> ''),
 k AS (SELECT {known} AS known, min(product_id) AS product_id FROM product GROUP BY 1),
 t AS (SELECT DISTINCT text FROM a WHERE text <> ''),
 b AS (SELECT text, arg_max(struct_pack(id := product_id, score := score), struct_pack(s := score, i := -product_id)) AS m
  FROM (SELECT text, product_id, 1.0::DOUBLE - levenshtein(known, text) / greatest(length(known), length(text))::DOUBLE AS score FROM t, k) WHERE score > 0 GROUP BY text)""".format(
    plain=_PLAIN.format("concat_ws(' ', nullif(brand, ''), nullif(name, ''))"), known=_PLAIN.format("brand || ' ' || name")
)
_SIZES = "z AS (SELECT DISTINCT product_id, size_id, ['short', 'long', 'slim', 'wide', 'grand', 'petite'][size_id] AS size_name FROM stock WHERE in_stock AND size_id IS NOT NULL)"
_SHEET = f"""{_SIZES},
 r AS (SELECT stock_id * 100000 + product_id AS position, shop_id, CASE WHEN product_id % 17 = 0 THEN '' ELSE lower(brand) END AS b,
  CASE WHEN product_id % 34 = 0 THEN '' WHEN product_id % 13 = 0 THEN 'no such thing' ELSE lower(name) END AS n,
  CASE WHEN product_id % 11 = 0 THEN 'unheard of' ELSE coalesce(['short', 'long', 'slim', 'wide', 'grand', 'petite'][size_id], '') END AS s,
  CASE WHEN quantity IS NOT NULL THEN floor(price) + 0.25 END AS price, CASE WHEN quantity % 2 = 0 THEN quantity END AS quantity FROM stock JOIN product USING (product_id)),
 p AS (SELECT lower(brand) AS b, lower(name) AS n, min(product_id) AS product_id FROM product GROUP BY 1, 2),
 l AS (SELECT position, shop_id, p.product_id, z.size_id, price, quantity,
  CASE WHEN r.b = '' OR r.n = '' OR s = '' THEN 'missing' WHEN p.product_id IS NULL THEN 'not found' WHEN z.size_id IS NULL THEN 'size not in catalogue' WHEN price IS NULL THEN 'invalid price' ELSE 'synced' END AS reason
  FROM r LEFT JOIN p ON p.b = r.b AND p.n = r.n LEFT JOIN z ON z.product_id = p.product_id AND z.size_name = s WHERE r.b <> '' OR r.n <> '')"""

SQL = {
    "import_preview": with_roles(
        f"""WITH {_UPLOAD}, {_SIZES},
 c AS (SELECT row, size_id, 1.0::DOUBLE - levenshtein(size, size_name) / greatest(length(size), length(size_name))::DOUBLE AS score FROM a JOIN b USING (text) JOIN z ON z.product_id = m.id WHERE size <> ''),
 y AS (SELECT row, arg_max(struct_pack(id := size_id, score := score), struct_pack(s := score, i := -size_id)) AS m FROM c WHERE score > 0 GROUP BY row)
SELECT a.row, b.m.id AS product_id, CAST(floor(b.m.score * 100 + 0.5) AS BIGINT) AS confidence, y.m.id AS size_id, CAST(floor(y.m.score * 100 + 0.5) AS BIGINT) AS size_confidence, price, CAST(quantity AS INT) AS quantity
FROM a LEFT JOIN b USING (text) LEFT JOIN y ON y.row = a.row""", "product", "stock"
    ),
    "review_import_preview": with_roles(
        f"WITH {_UPLOAD} SELECT position, CASE WHEN b.m.score >= {LEAST_REVIEW} THEN b.m.id END AS product_id, CASE WHEN b.m.score >= {LEAST_REVIEW} THEN CAST(floor(b.m.score * 100 + 0.5) AS BIGINT) END AS confidence FROM a LEFT JOIN b USING (text) WHERE text <> ''",
        "product",
    ),
    "sheet_reasons": with_roles(f"WITH {_SHEET} SELECT shop_id, reason, count(*) AS n, CAST(sum(product_id) AS BIGINT) AS products FROM l GROUP BY 1, 2", "product", "stock"),
    "sheet_synced_stock": with_roles(
        f"""WITH {_SHEET}, t AS (SELECT shop_id, product_id, size_id, max(price) AS price, max(quantity) AS quantity FROM stock WHERE in_stock AND size_id IS NOT NULL GROUP BY 1, 2, 3),
 u AS (SELECT shop_id, product_id, size_id, arg_max(struct_pack(price := price, quantity := quantity), position) AS v FROM l WHERE reason = 'synced' GROUP BY 1, 2, 3)
SELECT shop_id, product_id, size_id, CASE WHEN u.v IS NULL THEN t.price ELSE u.v.price END AS price, CASE WHEN u.v IS NULL THEN t.quantity ELSE u.v.quantity END AS quantity, u.v IS NOT NULL AS synced
FROM t FULL JOIN u USING (shop_id, product_id, size_id)""", "product", "stock"
    ),
}
