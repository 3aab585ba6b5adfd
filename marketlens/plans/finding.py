"""Searching and paging over the whole catalogue: parts of names by a table of grams, pages by the last row's key, and a list in collated order."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.kept import shared_folder
from ..operators.relational import collated
from ..operators.seek import Key, pages
from ..operators.trigrams import search, write_index
from ..roles import role, with_roles

#: What is searched for: short and long parts, wildcards, and what isn't there.
WORDS = ("b", "ed w", "Brand#1", "r_d", "a%t", "#12", "widget", "BOLT", "no such name at all")
PAGE, PAGES = 24, 6


def find(s, d) -> DataFrame:
    """The products of each word, by the table of grams of their brands and names."""
    products = role(s, d, "product").select("product_id", "brand", "name")
    path = f"{shared_folder(s)}/grams-{uuid.uuid4().hex}"
    write_index(products, "product_id", ["brand", "name"], path)
    found = [search(s, path, products, "product_id", ["brand", "name"], w).select(F.lit(w).alias("word"), "product_id") for w in WORDS]
    return reduce(DataFrame.unionByName, found)


def master(s, d) -> DataFrame:
    """Shops by state and city as people sort them; cases and accents differ, some places are blank."""
    rows = role(s, d, "shop").selectExpr(
        "shop_id", "CASE WHEN shop_id % 9 = 0 THEN NULL WHEN shop_id % 3 = 0 THEN lower(state) ELSE state END AS state",
        "CASE WHEN shop_id % 7 = 0 THEN '' WHEN shop_id % 4 = 1 THEN replace(city, 'A', 'Á') WHEN shop_id % 4 = 2 THEN lower(city) ELSE city END AS city",
    )
    return collated(rows.withColumn("upper_state", F.upper("state")), ["upper_state", "city"], "rank", "shop_id").select("rank", "shop_id", "state", "city")


QUERIES = {
    "catalog_find": find,
    "master_ranked": master,
    "seek_pages": lambda s, d: pages(role(s, d, "product").select("product_id", "strength", "list_price"), [Key("strength", True, True), Key("list_price", True, True), Key("product_id")], PAGE, PAGES).select(F.col("page").cast("long").alias("page"), "product_id"),
}

SQL = {
    "catalog_find": with_roles(f"SELECT word, product_id FROM product, (VALUES {', '.join(f'''('{w}')''' for w in WORDS)}) v(word) WHERE brand LIKE '%' || word || '%' OR name LIKE '%' || word || '%'", "product"),
    "master_ranked": with_roles(
        """WITH m AS (SELECT shop_id, CASE WHEN shop_id % 9 = 0 THEN NULL WHEN shop_id % 3 = 0 THEN lower(state) ELSE state END AS state,
  CASE WHEN shop_id % 7 = 0 THEN '' WHEN shop_id % 4 = 1 THEN replace(city, 'A', 'Á') WHEN shop_id % 4 = 2 THEN lower(city) ELSE city END AS city FROM shop)
SELECT row_number() OVER (ORDER BY coalesce(upper(state), ''), strip_accents(lower(city)), lower(city), city DESC, shop_id) AS rank, shop_id, state, city FROM m""", "shop"
    ),
    "seek_pages": with_roles(
        f"SELECT (n - 1) // {PAGE} + 1 AS page, product_id FROM (SELECT product_id, row_number() OVER (ORDER BY strength DESC NULLS FIRST, list_price DESC NULLS FIRST, product_id) AS n FROM product) WHERE n <= {PAGE * PAGES}", "product"
    ),
}
