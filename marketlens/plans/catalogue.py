"""Catalogue: faceted search, facets, product details, availability and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import clamp, ladder, located, miles, ordinal, tenth
from ..functions.text import json_list
from ..operators.relational import asc, desc, every, given, latest, like_any, nested, page, star, top, totals
from ..roles import STRENGTHS, role, with_roles


def order_of(sort: str) -> tuple[Column, ...]:
    """A sort by name; unknown ones go by popularity."""
    popular = (desc("review_count"), desc("avg_rating"))
    known = {"rating": popular[::-1], "price_asc": (asc("min_price"),), "price_desc": (desc("min_price"),), "newest": (desc("created_at"),)}
    return known.get(sort, popular)


def offers(stock: DataFrame) -> DataFrame:
    """Cheapest price and number of shops of each product in stock."""
    return stock.filter("in_stock").groupBy("product_id").agg(F.min("price").alias("min_price"), F.countDistinct("shop_id").alias("shop_count"))


def ratings(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("product_id").agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("review_count"))


def matching(
    products: DataFrame, reviews: DataFrame, stock: DataFrame, shops: DataFrame, q: str = "", brand: str = "", strength: str = "", kind: str = "", note: str = "", wrapper: str = "", country: str = "",
    city: str = "", state: str = "", min_price: float = 0, max_price: float = 0, in_stock: bool = False, min_rating: float = 0,
) -> DataFrame:
    """Products that meet every filter given, with rating, price and shop count over all shops.

    A price bound drops products without stock; a rating bound counts unrated ones as 0. City (a part of its name)
    and state only decide which products are found. Reviews and stock are combined by product before they are shuffled, and
    met in hash tables of one row a product: cut down to the products found first, they would be sorted, and the products three times, in each task.
    """
    hashed = lambda t: t.hint("shuffle_hash")
    p = products.filter(
        every(
            given(q, lambda v: like_any(v, "brand", "name", "kind")),
            given(brand, lambda v: F.col("brand") == v),
            given(strength, lambda v: F.col("strength") == v),
            given(kind, lambda v: F.col("kind") == v),
            given(note, lambda v: F.col("notes").like(f"%{v}%")),
            given(wrapper, lambda v: F.col("wrapper").like(f"%{v}%")),
            given(country, lambda v: F.col("country") == v),
        )
    )
    if city or state:
        near = shops.filter(every(given(city, lambda v: F.col("city").like(f"%{v}%")), given(state, lambda v: F.col("state") == v)))
        p = p.join(hashed(stock.filter("in_stock").join(near, "shop_id", "left_semi").select("product_id")), "product_id", "left_semi")
    if in_stock:
        p = p.join(hashed(stock.filter("in_stock").select("product_id")), "product_id", "left_semi")
    p = star(p, "product_id", hashed(ratings(reviews)), hashed(offers(stock)))
    p = p.withColumns({"avg_rating": F.coalesce("avg_rating", F.lit(0.0)), "review_count": F.coalesce("review_count", F.lit(0)), "shop_count": F.coalesce("shop_count", F.lit(0))})
    return p.filter(
        every(
            given(min_price, lambda v: F.col("min_price") >= v),
            given(max_price, lambda v: F.col("min_price") <= v),
            given(min_rating, lambda v: F.col("avg_rating") >= v),
        )
    )


def search(found: DataFrame, sort: str = "popular", number: int = 1, size: int = 24) -> DataFrame:
    """A page of matching(); unknown sorts go by popularity, and the size keeps to 1 to 100."""
    return page(found, number, clamp(size, 1, 100), *order_of(sort), asc("product_id")).select(*_FOUND)


_FOUND = ("product_id", "brand", "name", "avg_rating", "review_count", "min_price", "shop_count")


def _found(spark: SparkSession, d: str, **params) -> DataFrame:
    return matching(*[role(spark, d, x) for x in ("product", "review", "stock", "shop")], **params)


_FOUND_SQL = """WITH rt AS (SELECT product_id, avg(rating) AS avg_rating, count(*) AS review_count FROM review GROUP BY 1),
ofr AS (SELECT product_id, min(price) AS min_price, count(DISTINCT shop_id) AS shop_count FROM stock WHERE in_stock GROUP BY 1),
found AS (SELECT p.*, coalesce(rt.avg_rating, 0.0) AS avg_rating, coalesce(rt.review_count, 0) AS review_count, ofr.min_price, coalesce(ofr.shop_count, 0) AS shop_count
  FROM product p LEFT JOIN rt USING (product_id) LEFT JOIN ofr USING (product_id))
"""
_COLS = ", ".join(_FOUND)
_ROLES = ("product", "review", "stock", "shop")
_NEAR = "product_id IN (SELECT product_id FROM stock JOIN shop USING (shop_id) WHERE in_stock AND state = 'ASIA')"
_LIKE = "(brand LIKE '%r%' OR name LIKE '%r%' OR kind LIKE '%r%')"

QUERIES = {
    "catalog_search": lambda s, d: search(_found(s, d, q="r", state="ASIA", min_rating=60), "price_desc", 2),
    "catalog_search_total": lambda s, d: totals(_found(s, d, q="r", state="ASIA", min_rating=60), 24),
    "catalog_popular": lambda s, d: search(_found(s, d, wrapper="re", country="NATION_3", city="ION_1")),
    "catalog_rating": lambda s, d: search(_found(s, d, q="i"), "rating"),
    "catalog_newest": lambda s, d: search(_found(s, d, kind="ECONOMY"), "newest", size=100),
    "catalog_price_asc": lambda s, d: search(_found(s, d, in_stock=True), "price_asc", 2, 500),
    "catalog_price_band": lambda s, d: _found(s, d, min_price=900, max_price=1500).select(*_FOUND),
    "catalog_in_stock_exists": lambda s, d: _found(s, d, in_stock=True, strength="full").select(*_FOUND),
    "catalog_min_rating": lambda s, d: _found(s, d, min_rating=75).select(*_FOUND),
    "brand_counts": lambda s, d: role(s, d, "product").groupBy("brand").agg(F.count(F.lit(1)).alias("n")),
    "facet_strengths_ordinal": lambda s, d: (
        role(s, d, "product").select("strength").distinct().filter(F.col("strength").isNotNull())
        .withColumn("place", ordinal(F.col("strength"), STRENGTHS)).orderBy("place")
    ),
    "facet_brands_by_count": lambda s, d: role(s, d, "product").groupBy("brand").agg(F.count(F.lit(1)).alias("n")).orderBy(desc("n"), asc("brand")),
    "product_stats": lambda s, d: role(s, d, "review").groupBy("product_id").agg(
        F.avg("rating").alias("avg_rating"), F.avg("draw_rating").alias("avg_draw"), F.coalesce(F.avg("burn_rating"), F.lit(0.0)).alias("avg_burn"),
        F.count(F.lit(1)).alias("n"), F.count("burn_rating").alias("n_burn"),
    ),
    "product_top_words": lambda s, d: top(
        role(s, d, "product").select("product_id", F.posexplode(json_list(F.col("notes"))).alias("place", "word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("product_id", "place")).alias("f")).select("word", "n", "f.product_id", "f.place"),
        8, desc("n"), asc("product_id"), asc("place"),
    ).select("word", "n"),
    "similar_products": lambda s, d: similar(role(s, d, "product"), role(s, d, "review"), 7),
    "availability_nested": lambda s, d: availability(role(s, d, "stock"), role(s, d, "shop"), 34.05, -118.24),
    "price_comparison": lambda s, d: role(s, d, "stock").filter("in_stock").join(role(s, d, "shop").select("shop_id", F.col("name").alias("shop")), "shop_id").groupBy("product_id", "size_id").agg(
        F.min("price").alias("lowest"), F.max("price").alias("highest"), F.count(F.lit(1)).alias("n"), F.min_by("shop", F.struct("price", "shop_id")).alias("cheapest_shop")
    ),
    "review_page": lambda s, d: page(reviews_with_names(s, d), 3, 10, desc("rating"), asc("review_id"), asc("product_id"), asc("shop_id")),
    "rating_bands": lambda s, d: role(s, d, "review").groupBy("product_id").agg(
        *[F.count_if(F.col("rating").between(lo, hi)).alias(f"band_{lo}") for lo, hi in ((90, 100), (80, 89), (70, 79), (60, 69), (50, 59))]
    ),
    "score_color_band": lambda s, d: role(s, d, "review").groupBy(ladder(F.col("rating"), ((95, "green"), (90, "gold"), (85, "orange")), "grey").alias("colour")).agg(
        F.count(F.lit(1)).alias("n"), F.min("rating").alias("lo"), F.max("rating").alias("hi")
    ),
    "latest_review": lambda s, d: latest(role(s, d, "review"), ["product_id"], desc("created_at"), desc("rating"), asc("review_id"), asc("shop_id")).select("product_id", "review_id", "rating", "created_at"),
    "followed_products": lambda s, d: star(
        role(s, d, "item").filter("status = 'wished'").groupBy("product_id").agg(F.countDistinct("user_id").alias("followers")),
        "product_id", ratings(role(s, d, "review")), offers(role(s, d, "stock")),
    ),
}


def similar(products: DataFrame, reviews: DataFrame, product_id: int) -> DataFrame:
    """Four others of the same brand or strength, the best rated first; a null strength matches none."""
    this = products.filter(F.col("product_id") == product_id).select(F.col("brand").alias("_b"), F.col("strength").alias("_s"), F.col("product_id").alias("_id"))
    same = (F.col("product_id") != F.col("_id")) & ((F.col("brand") == F.col("_b")) | (F.col("strength") == F.col("_s")))
    found = products.join(F.broadcast(this), same)  # one row
    rated = star(found, "product_id", ratings(reviews)).withColumn("avg_rating", F.coalesce("avg_rating", F.lit(0.0)))
    return top(rated.select("product_id", "brand", "name", "avg_rating"), 4, desc("avg_rating"), asc("product_id"))


def availability(stock: DataFrame, shops: DataFrame, lat: float, lng: float) -> DataFrame:
    """Each product's shops with their sizes as JSON, and the distance from a place; shops in order of id."""
    there = located(F.col("lat"), F.col("lng"))
    away = F.when(there, tenth(miles(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))))
    sizes = nested(stock.filter("in_stock"), ["product_id", "shop_id"], ["size_id", "stock_id"], ["price"], "sizes")
    side = shops.select("shop_id", F.col("name").alias("shop"), away.alias("miles"))
    return sizes.join(side, "shop_id").select("product_id", "shop_id", "shop", "miles", F.size("sizes").alias("n_sizes"), F.array_min("sizes.price").alias("lowest"))


def reviews_with_names(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"))
    named = role(spark, d, "review").join(orders, "order_id").join(role(spark, d, "account").select("user_id", F.col("name").alias("user_name")), "user_id", "left")
    return named.select("review_id", "product_id", "shop_id", "rating", "user_name")


_MILES = "floor(3958.8 * 2 * atan2(sqrt(h), sqrt(1 - h)) * 10 + 0.5) / 10"
_H = "sin(radians(lat - {lat}) / 2) * sin(radians(lat - {lat}) / 2) + cos(radians({lat})) * cos(radians(lat)) * sin(radians(lng - {lng}) / 2) * sin(radians(lng - {lng}) / 2)"


def miles_sql(lat: float, lng: float, source: str) -> str:
    """A source of rows with lat and lng, with the distance as `miles`."""
    return f"(SELECT *, CASE WHEN lat <> 0 AND lng <> 0 THEN {_MILES} END AS miles FROM (SELECT *, {_H.format(lat=f'{lat}::DOUBLE', lng=f'({lng})::DOUBLE')} AS h FROM {source}))"


def _sql(where: str, tail: str = "", columns: str = _COLS) -> str:
    return with_roles(f"{_FOUND_SQL}SELECT {columns} FROM found WHERE {where} {tail}", *_ROLES)


SQL = {
    "catalog_search": _sql(f"{_LIKE} AND avg_rating >= 60 AND {_NEAR}", "ORDER BY min_price DESC NULLS FIRST, product_id LIMIT 24 OFFSET 24"),
    "catalog_search_total": _sql(f"{_LIKE} AND avg_rating >= 60 AND {_NEAR}", "", "count(*) AS total, CAST(ceil(count(*) / 24.0) AS BIGINT) AS pages"),
    "catalog_popular": _sql(
        "wrapper LIKE '%re%' AND country = 'NATION_3' AND product_id IN (SELECT product_id FROM stock JOIN shop USING (shop_id) WHERE in_stock AND city LIKE '%ION_1%')",
        "ORDER BY review_count DESC, avg_rating DESC, product_id LIMIT 24",
    ),
    "catalog_rating": _sql("(brand LIKE '%i%' OR name LIKE '%i%' OR kind LIKE '%i%')", "ORDER BY avg_rating DESC, review_count DESC, product_id LIMIT 24"),
    "catalog_newest": _sql("kind = 'ECONOMY'", "ORDER BY created_at DESC, product_id LIMIT 100"),
    "catalog_price_asc": _sql("EXISTS (SELECT 1 FROM stock s WHERE s.product_id = found.product_id AND s.in_stock)", "ORDER BY min_price NULLS LAST, product_id LIMIT 100 OFFSET 100"),
    "catalog_price_band": _sql("min_price >= 900 AND min_price <= 1500"),
    "catalog_in_stock_exists": _sql("strength = 'full' AND EXISTS (SELECT 1 FROM stock s WHERE s.product_id = found.product_id AND s.in_stock)"),
    "catalog_min_rating": _sql("avg_rating >= 75"),
    "brand_counts": with_roles("SELECT brand, count(*) AS n FROM product GROUP BY brand", "product"),
    "facet_strengths_ordinal": with_roles(
        "SELECT DISTINCT strength, CASE strength WHEN 'mild' THEN 1 WHEN 'mild-medium' THEN 2 WHEN 'medium' THEN 3 WHEN 'medium-full' THEN 4 WHEN 'full' THEN 5 END AS place FROM product WHERE strength IS NOT NULL ORDER BY place", "product"
    ),
    "facet_brands_by_count": with_roles("SELECT brand, count(*) AS n FROM product GROUP BY brand ORDER BY n DESC, brand", "product"),
    "product_stats": with_roles("SELECT product_id, avg(rating) AS avg_rating, avg(draw_rating) AS avg_draw, coalesce(avg(burn_rating), 0.0) AS avg_burn, count(*) AS n, count(burn_rating) AS n_burn FROM review GROUP BY product_id", "review"),
    "product_top_words": with_roles(
        """WITH w AS (SELECT product_id, unnest(string_split(name, ' ')) AS word, unnest(range(len(string_split(name, ' ')))) AS place FROM product),
        c AS (SELECT word, count(*) AS n, min(struct_pack(p := product_id, q := place)) AS f FROM w GROUP BY word)
        SELECT word, n FROM c ORDER BY n DESC, f LIMIT 8""", "product"
    ),
    "similar_products": with_roles(
        """WITH t AS (SELECT * FROM product WHERE product_id = 7), rt AS (SELECT product_id, avg(rating) AS a FROM review GROUP BY 1)
        SELECT p.product_id, p.brand, p.name, coalesce(rt.a, 0.0) AS avg_rating FROM product p JOIN t ON p.product_id <> t.product_id AND (p.brand = t.brand OR p.strength = t.strength)
        LEFT JOIN rt ON rt.product_id = p.product_id ORDER BY avg_rating DESC, p.product_id LIMIT 4""", "product", "review"
    ),
    "availability_nested": with_roles(
        f"""SELECT product_id, shop_id, s.name AS shop, s.miles, CAST(count(*) AS INT) AS n_sizes, min(price) AS lowest
        FROM stock JOIN {miles_sql(34.05, -118.24, 'shop')} s USING (shop_id) WHERE in_stock GROUP BY ALL""", "stock", "shop"
    ),
    "price_comparison": with_roles(
        """SELECT product_id, size_id, min(price) AS lowest, max(price) AS highest, count(*) AS n, arg_min(shop.name, struct_pack(a := price, b := shop_id)) AS cheapest_shop
        FROM stock JOIN shop USING (shop_id) WHERE in_stock GROUP BY product_id, size_id""", "stock", "shop"
    ),
    "review_page": with_roles(
        """SELECT review_id, product_id, shop_id, rating, account.name AS user_name FROM review JOIN orders ON o_orderkey = order_id LEFT JOIN account ON o_custkey = user_id
        ORDER BY rating DESC, review_id, product_id, shop_id LIMIT 10 OFFSET 20""", "review", "account"
    ),
    "rating_bands": with_roles(
        "SELECT product_id, " + ", ".join(f"count(*) FILTER (WHERE rating BETWEEN {lo} AND {hi}) AS band_{lo}" for lo, hi in ((90, 100), (80, 89), (70, 79), (60, 69), (50, 59))) + " FROM review GROUP BY product_id", "review"
    ),
    "score_color_band": with_roles("SELECT CASE WHEN rating >= 95 THEN 'green' WHEN rating >= 90 THEN 'gold' WHEN rating >= 85 THEN 'orange' ELSE 'grey' END AS colour, count(*) AS n, min(rating) AS lo, max(rating) AS hi FROM review GROUP BY 1", "review"),
    "latest_review": with_roles(
        """SELECT product_id, review_id, rating, created_at FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY created_at DESC NULLS FIRST, rating DESC NULLS FIRST, review_id, shop_id) AS k FROM review) WHERE k = 1""", "review"
    ),
    "followed_products": with_roles(
        """WITH w AS (SELECT product_id, count(DISTINCT user_id) AS followers FROM item WHERE status = 'wished' GROUP BY 1),
        rt AS (SELECT product_id, avg(rating) AS avg_rating, count(*) AS review_count FROM review GROUP BY 1),
        ofr AS (SELECT product_id, min(price) AS min_price, count(DISTINCT shop_id) AS shop_count FROM stock WHERE in_stock GROUP BY 1)
        SELECT product_id, followers, avg_rating, review_count, min_price, shop_count FROM w LEFT JOIN rt USING (product_id) LEFT JOIN ofr USING (product_id)""", "item", "review", "stock"
    ),
}
