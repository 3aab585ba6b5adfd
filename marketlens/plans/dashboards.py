"""What a shop's and a product's page show, over all shops: dashboard, daily views, top items, requests, reviews by sort, availability by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.relational import asc, desc, page, star
from ..roles import AS_OF, role, with_roles

#: Days of the daily series, items and requests shown.
DAYS, ITEMS, REQUESTS = 14, 5, 100


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def since(at: str, days: int, as_of: Column) -> Column:
    return (F.col(at) > as_of - F.expr(f"INTERVAL {days} DAYS")) & (F.col(at) <= as_of)


def dashboard(shops: DataFrame, follows: DataFrame, views: DataFrame, stock: DataFrame, deals: DataFrame, notes: DataFrame, as_of: Column) -> DataFrame:
    """A row for each shop with its counts; each table is gone over once and joined by shop after it is counted."""
    n = F.count(F.lit(1))
    low = F.col("in_stock") & (F.col("quantity") < 5) & (F.col("quantity") > 0)
    sides = [
        follows.groupBy("shop_id").agg(n.alias("followers")),
        views.groupBy("shop_id").agg(F.count_if(since("viewed_at", 30, as_of)).alias("views_30d"), F.count_if(since("viewed_at", 7, as_of)).alias("views_7d")),
        stock.groupBy("shop_id").agg(F.count_if("in_stock").alias("items_in_stock"), F.count_if(low).alias("low_stock"), F.count_if(~F.col("in_stock") | (F.col("quantity") == 0)).alias("out_of_stock")),
        deals.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of)).groupBy("shop_id").agg(n.alias("active_deals")),
        notes.groupBy("shop_id").agg(n.alias("total_broadcasts")),
    ]
    return star(shops.select("shop_id", "name"), "shop_id", *sides).na.fill(0)


def daily_views(views: DataFrame, as_of: Column) -> DataFrame:
    """shop_id, day, views of the last days; days without any are left out."""
    return views.filter(since("viewed_at", DAYS, as_of)).groupBy("shop_id", F.col("viewed_at").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("views"))


def ranked(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key with their rank; tasks rank before the shuffle, so a key with very many rows sends few."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def top_items(stock: DataFrame, products: DataFrame) -> DataFrame:
    """Each shop's items in stock with a size, featured ones first, then by quantity, unknown ones before all as the service's database sorts."""
    rows = stock.filter(F.col("in_stock") & F.col("size_id").isNotNull()).join(products.select("product_id", "brand", "name"), "product_id")
    return ranked(rows, "shop_id", ITEMS, desc("featured"), desc("quantity"), asc("stock_id"), asc("product_id")).select("shop_id", "rank", "stock_id", "product_id", "brand", "name", "size_id", "price", "quantity")


def shop_requests(requests: DataFrame, users: DataFrame, products: DataFrame) -> DataFrame:
    """Each shop's latest requests with the user's and product's names, and how many requests the shop has for the product; those without one count together.

    The requests that are shown are taken first; only their products' counts are joined.
    """
    shown = ranked(requests, "shop_id", REQUESTS, desc("created_at"), asc("item_id"))
    counts = requests.groupBy("shop_id", "product_id").agg(F.count(F.lit(1)).alias("request_count"))
    same = (F.col("s.shop_id") == F.col("c.shop_id")) & F.col("s.product_id").eqNullSafe(F.col("c.product_id"))
    counted = shown.alias("s").join(counts.alias("c"), same).select("s.*", "request_count")
    return counted.join(users.select("user_id", F.col("name").alias("user_name")), "user_id").join(products.select("product_id", "brand", "name"), "product_id", "left")


def reviews_page(reviews: DataFrame, product: int, sort: str = "newest", number: int = 1, size: int = 10) -> DataFrame:
    """A page of a product's reviews: highest, lowest or newest first; any other word is newest."""
    order = {"highest": desc("rating"), "lowest": asc("rating")}.get(sort, desc("created_at"))
    return page(reviews.filter(F.col("product_id") == product), number, size, order, asc("review_id"))


def by_size(stock: DataFrame, shops: DataFrame, product: int) -> DataFrame:
    """A product's sizes, each with its shops as JSON, cheapest first; rows without a size are left out."""
    rows = stock.filter((F.col("product_id") == product) & F.col("size_id").isNotNull()).join(shops.select("shop_id", "name", "city"), "shop_id")
    item = F.struct("price", "stock_id", "shop_id", "name", "city", "quantity", "in_stock")
    listed = rows.groupBy("size_id").agg(F.array_sort(F.collect_list(item)).alias("r"), F.count(F.lit(1)).alias("n"))
    return listed.select("size_id", "n", F.to_json(F.transform("r", lambda x: F.struct(x["shop_id"].alias("shop"), x["city"].alias("city"), x["quantity"].alias("quantity")))).alias("shops"))


def _requests(s, d) -> DataFrame:
    return role(s, d, "item").filter("status = 'wished'").selectExpr("item_id", "user_id", "user_id % 100 AS shop_id", "CASE WHEN item_id % 3 = 0 THEN NULL ELSE product_id END AS product_id", "created_at")


def _sorted_reviews(s, d) -> DataFrame:
    pages = [reviews_page(role(s, d, "review"), 5, sort).withColumn("sort", F.lit(sort)) for sort in ("highest", "lowest", "newest", "best")]
    out = pages[0]
    for p in pages[1:]:
        out = out.unionByName(p)
    return out.select("sort", "review_id", "rating", "created_at")


QUERIES = {
    "shop_dashboard": lambda s, d: dashboard(*[role(s, d, r) for r in ("shop", "follow", "shop_view", "stock", "deal", "note")], now()),
    "shop_daily_views": lambda s, d: daily_views(role(s, d, "shop_view"), now()),
    "shop_top_items": lambda s, d: top_items(role(s, d, "stock"), role(s, d, "product")),
    "shop_requests": lambda s, d: shop_requests(_requests(s, d), role(s, d, "account"), role(s, d, "product")).select("shop_id", "rank", "item_id", "user_name", "brand", "name", "request_count"),
    "reviews_by_sort": _sorted_reviews,
    "availability_by_size": lambda s, d: by_size(role(s, d, "stock"), role(s, d, "shop"), 5),
}

_NOW = f"TIMESTAMP '{AS_OF}'"
SQL = {
    "shop_dashboard": with_roles(
        f"""SELECT shop_id, name, (SELECT count(*) FROM follow WHERE follow.shop_id = shop.shop_id) AS followers,
  (SELECT count(*) FROM shop_view v WHERE v.shop_id = shop.shop_id AND viewed_at > {_NOW} - INTERVAL 30 DAY AND viewed_at <= {_NOW}) AS views_30d,
  (SELECT count(*) FROM shop_view v WHERE v.shop_id = shop.shop_id AND viewed_at > {_NOW} - INTERVAL 7 DAY AND viewed_at <= {_NOW}) AS views_7d,
  (SELECT count(*) FROM stock WHERE stock.shop_id = shop.shop_id AND in_stock) AS items_in_stock,
  (SELECT count(*) FROM stock WHERE stock.shop_id = shop.shop_id AND in_stock AND quantity < 5 AND quantity > 0) AS low_stock,
  (SELECT count(*) FROM stock WHERE stock.shop_id = shop.shop_id AND (NOT in_stock OR quantity = 0)) AS out_of_stock,
  (SELECT count(*) FROM deal WHERE deal.shop_id = shop.shop_id AND (expires_at IS NULL OR expires_at > {_NOW})) AS active_deals,
  (SELECT count(*) FROM note WHERE note.shop_id = shop.shop_id) AS total_broadcasts FROM shop""", "shop", "follow", "shop_view", "stock", "deal", "note"
    ),
    "shop_daily_views": with_roles(f"SELECT shop_id, CAST(viewed_at AS DATE) AS day, count(*) AS views FROM shop_view WHERE viewed_at > {_NOW} - INTERVAL {DAYS} DAY AND viewed_at <= {_NOW} GROUP BY 1, 2", "shop_view"),
    "shop_top_items": with_roles(
        f"""SELECT * FROM (SELECT shop_id, row_number() OVER (PARTITION BY shop_id ORDER BY featured DESC, quantity DESC NULLS FIRST, stock_id, product_id) AS rank, stock_id, product_id, brand, name, size_id, price, quantity
  FROM stock JOIN product USING (product_id) WHERE in_stock AND size_id IS NOT NULL) WHERE rank <= {ITEMS}""", "stock", "product"
    ),
    "shop_requests": with_roles(
        f"""WITH r AS (SELECT item_id, user_id, user_id % 100 AS shop_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE product_id END AS product_id, created_at FROM item WHERE status = 'wished'),
 w AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY created_at DESC NULLS FIRST, item_id) AS rank, count(*) OVER (PARTITION BY shop_id, product_id) AS request_count FROM r)
SELECT shop_id, rank, item_id, account.name AS user_name, brand, product.name AS name, request_count FROM w JOIN account USING (user_id) LEFT JOIN product USING (product_id) WHERE rank <= {REQUESTS}""", "item", "account", "product"
    ),
    "reviews_by_sort": with_roles(
        " UNION ALL ".join(f"(SELECT '{sort}' AS sort, review_id, rating, created_at FROM review WHERE product_id = 5 ORDER BY {order}, review_id LIMIT 10)" for sort, order in (("highest", "rating DESC"), ("lowest", "rating"), ("newest", "created_at DESC"), ("best", "created_at DESC"))), "review"
    ),
    "availability_by_size": with_roles(
        """SELECT size_id, count(*) AS n, '[' || string_agg('{"shop":' || shop_id || ',"city":"' || city || '"' || CASE WHEN quantity IS NULL THEN '' ELSE ',"quantity":' || quantity END || '}', ',' ORDER BY price, stock_id, shop_id) || ']' AS shops
  FROM stock JOIN shop USING (shop_id) WHERE product_id = 5 AND size_id IS NOT NULL GROUP BY size_id""", "stock", "shop"
    ),
}
