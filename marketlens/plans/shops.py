"""Shops: search by place and hours, stock pages, analytics, demand and administration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import located, miles, tenth
from ..functions.text import json_map
from ..functions.times import clock, is_open_hourly, is_open_minutes, opening_minutes, shop_status, weekday
from ..operators.relational import asc, desc, every, given, latest, like_any, page, star, top, totals
from ..operators.writes import deletable
from ..roles import AS_OF, role, with_roles
from .catalogue import miles_sql


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def shop_search(
    shops: DataFrame, stock: DataFrame, follows: DataFrame, reviews: DataFrame, q: str = "", city: str = "", state: str = "", lounge: bool = False, walk_in: bool = False,
    open_now: bool = False,
) -> DataFrame:
    """Shops that meet every filter given, with rows in stock, followers and ratings; each side is aggregated before it is joined.

    Verified ones come first, then by followers and stock (see shop_order). Open ones are those known to be open: null is not.
    """
    found = shops.filter(
        every(
            given(q, lambda v: like_any(v, "name", "description", "city")), given(city, lambda v: F.col("city").like(f"%{v}%")), given(state, lambda v: F.col("state") == v),
            given(lounge, lambda v: F.col("has_lounge")), given(walk_in, lambda v: F.col("walk_in")),
        )
    ).withColumn("is_open", is_open_hourly(day_text(), now()))
    found = found.filter("is_open") if open_now else found
    if q or city or state or lounge or walk_in or open_now:  # what no shop found needs isn't aggregated
        stock, follows, reviews = (df.join(found.select("shop_id"), "shop_id", "left_semi") for df in (stock, follows, reviews))
    held = stock.filter("in_stock").groupBy("shop_id").agg(F.count(F.lit(1)).alias("stock_rows"))
    fans = follows.groupBy("shop_id").agg(F.count(F.lit(1)).alias("followers"))  # one edge per user
    rated = reviews.groupBy("shop_id").agg(tenth(F.avg("rating")).alias("avg_rating"), F.count(F.lit(1)).alias("ratings"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("stock_rows", "followers", "ratings")} | {"avg_rating": F.coalesce("avg_rating", F.lit(0.0))}
    return star(found, "shop_id", held, fans, rated).withColumns(zero).select("shop_id", "name", "city", "state", "verified", "is_open", "lat", "lng", *zero)


def shop_order() -> tuple[Column, ...]:
    return desc("verified"), desc("followers"), desc("stock_rows"), asc("shop_id")


def day_text(hours: str = "hours") -> Column:
    return F.try_element_at(json_map(F.col(hours)), weekday(now()))


def within(shops: DataFrame, lat: float, lng: float, radius: float = 50, *more: str) -> DataFrame:
    """Shops by distance, with more of their columns if asked, those without coordinates last and never dropped; the rounded distance is compared. A radius of 0 means 50."""
    away = F.when(located(F.col("lat"), F.col("lng")), tenth(miles(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))))
    near = shops.withColumn("miles", away).filter(F.col("miles").isNull() | (F.col("miles") <= (radius or 50)))
    return near.select("shop_id", "city", "miles", *more).orderBy(asc("miles"), asc("shop_id"))


def kpis(views: DataFrame, stock: DataFrame, follows: DataFrame, as_of: Column) -> DataFrame:
    """One row for each shop with anything: one pass over each table."""
    since = lambda n: F.count_if((F.col("viewed_at") > as_of - F.expr(f"INTERVAL {n} DAYS")) & (F.col("viewed_at") <= as_of))
    v = views.groupBy("shop_id").agg(F.count(F.lit(1)).alias("views"), since(7).alias("views_7d"), since(30).alias("views_30d"))
    s = stock.groupBy("shop_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("in_stock") & (F.col("quantity") < 5) & (F.col("quantity") > 0)).alias("low"),
        F.count_if(~F.col("in_stock") | (F.col("quantity") == 0)).alias("out"),
    )
    f = follows.groupBy("shop_id").agg(F.count(F.lit(1)).alias("followers"))
    return v.join(s, "shop_id", "full").join(f, "shop_id", "full").na.fill(0)


def broadcast_reads(notes: DataFrame, reads: DataFrame, follows: DataFrame) -> DataFrame:
    """Readers of each note, any reader, against its shop's followers now; the share may exceed 1."""
    r = reads.groupBy("note_id").agg(F.count("user_id").alias("readers"))
    f = follows.groupBy("shop_id").agg(F.count(F.lit(1)).alias("followers"))
    joined = notes.join(r, "note_id", "left").join(f, "shop_id", "left").na.fill(0, ["readers", "followers"])
    share = F.when(F.col("followers") > 0, F.floor(F.col("readers") * 1000.0 / F.col("followers") + 0.5) / 10).otherwise(0.0)
    return joined.select("note_id", "shop_id", "readers", "followers", share.alias("read_percent"))


def stock_page(stock: DataFrame, products: DataFrame, shop: int) -> DataFrame:
    """Rows with a size only, featured and new ones first; the total beside it counts the others too."""
    own = stock.filter((F.col("shop_id") == shop) & F.col("in_stock") & F.col("size_id").isNotNull())
    rows = own.join(products.select("product_id", "brand", "name"), "product_id").select("stock_id", "product_id", "brand", "name", "size_id", "price", "featured", "is_new")
    return page(rows, 1, 40, desc("featured"), desc("is_new"), asc("brand"), asc("name"), asc("stock_id"), asc("product_id"))


def _top_items(s, d):
    n = role(s, d, "stock").filter("in_stock").groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").cast("long").alias("units"))
    return top(n, 5, desc("n"), asc("product_id")).join(role(s, d, "product").select("product_id", "brand", "name"), "product_id")


def demand(requests: DataFrame, k: int) -> DataFrame:
    """The latest k requests with the number of all requests for their product, those without a product being one group.

    The k are taken first; then only their products' requests are counted, by key, so a hot key is no burden.
    """
    shown = top(requests, k, desc("created_at"), asc("item_id"))
    same = F.col("product_id").eqNullSafe(F.col("_key"))
    asked = requests.join(F.broadcast(shown.select(F.col("product_id").alias("_key")).distinct()), same, "left_semi")  # k rows at most
    n = asked.groupBy(F.col("product_id").alias("_key")).agg(F.count(F.lit(1)).alias("demand"))
    return shown.join(n, same).select("item_id", "product_id", "created_at", "demand")


_SHOP = ("shop_id", "name", "city", "state", "verified", "is_open", "stock_rows", "followers", "ratings", "avg_rating")


def _shops(s, d, **params):
    return shop_search(*[role(s, d, x) for x in ("shop", "stock", "follow", "review")], **params)


QUERIES = {
    "shop_search": lambda s, d: top(_shops(s, d, q="more of A", city="ION"), 30, *shop_order()).select(*_SHOP),
    "shop_search_open": lambda s, d: _shops(s, d, open_now=True).select(*_SHOP),
    "shop_search_facilities": lambda s, d: _shops(s, d, state="ASIA", lounge=True, walk_in=True).select(*_SHOP),
    "shop_search_near": lambda s, d: within(_shops(s, d, q="Supplier"), 34.05, -118.24, 700, "followers"),
    "shop_open_now": lambda s, d: role(s, d, "shop").select("shop_id", is_open_hourly(day_text(), now()).alias("is_open")),
    "shop_hours_minutes": lambda s, d: role(s, d, "shop").withColumn("m", opening_minutes(day_text())).select(
        "shop_id", F.col("m.opens").alias("opens"), F.col("m.closes").alias("closes"), clock(F.col("m.opens")).alias("opens_at"), is_open_minutes(day_text(), now()).alias("is_open")
    ),
    "shop_status_label": lambda s, d: role(s, d, "shop").select("shop_id", shop_status(F.when(F.col("hours").isNotNull(), json_map(F.col("hours"))), now()).alias("status")),
    "shop_within_radius": lambda s, d: within(role(s, d, "shop"), 34.05, -118.24, 700),
    "city_counts": lambda s, d: role(s, d, "shop").groupBy("city", "state").agg(F.count(F.lit(1)).alias("n")),
    "shop_detail_stats": lambda s, d: star(
        role(s, d, "shop").select("shop_id", "name"), "shop_id",
        role(s, d, "review").groupBy("shop_id").agg(F.avg("rating").alias("avg_rating"), F.count(F.lit(1)).alias("reviews")),
        role(s, d, "stock").filter("in_stock").join(role(s, d, "product").select("product_id", "brand"), "product_id").groupBy("shop_id").agg(F.countDistinct("brand").alias("brands")),
    ),
    "new_arrivals": lambda s, d: top(
        role(s, d, "stock").filter("is_new AND in_stock").join(role(s, d, "product").select("product_id", "name"), "product_id").select("updated_at", "stock_id", "product_id", "shop_id", "name"),
        6, desc("updated_at"), asc("stock_id"), asc("product_id"), asc("shop_id"),
    ),
    "inventory_page": lambda s, d: stock_page(role(s, d, "stock"), role(s, d, "product"), 3),
    "inventory_page_total": lambda s, d: totals(role(s, d, "stock").filter("shop_id = 3 AND in_stock"), 40),
    "stock_health": lambda s, d: role(s, d, "stock").groupBy("shop_id").agg(
        F.count_if((F.col("quantity") < 5) & (F.col("quantity") > 0)).alias("low"), F.count_if(~F.col("in_stock") | (F.col("quantity") == 0)).alias("out"), F.count_if(F.col("quantity").isNull()).alias("unknown")
    ),
    "analytics_kpis": lambda s, d: kpis(role(s, d, "shop_view"), role(s, d, "stock"), role(s, d, "follow"), now()),
    "daily_views": lambda s, d: role(s, d, "shop_view").filter(F.col("viewed_at") > now() - F.expr("INTERVAL 14 DAYS")).groupBy(F.col("viewed_at").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n")),
    "top_items": _top_items,
    "demand_window": lambda s, d: demand(role(s, d, "item").filter("status = 'wished'").withColumn("product_id", F.expr("nullif(product_id, 0)")), 100),
    "top_requested": lambda s, d: top(role(s, d, "item").filter("status = 'wished' AND priority IS NOT NULL").groupBy("product_id").agg(F.count(F.lit(1)).alias("n")), 5, desc("n"), asc("product_id")),
    "broadcast_reads": lambda s, d: broadcast_reads(role(s, d, "note"), role(s, d, "note_read"), role(s, d, "follow")),
    "active_deals": lambda s, d: top(
        role(s, d, "deal").filter(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit("2001-01-01").cast("timestamp_ntz"))).join(role(s, d, "product").select("product_id", F.col("name").alias("product")), "product_id", "left")
        .select("deal_id", "shop_id", "product", "discount", "expires_at", "created_at"), 50, desc("created_at"), asc("deal_id"),
    ),
    "latest_verification": lambda s, d: role(s, d, "account").select("user_id", "name").join(
        latest(role(s, d, "item"), ["user_id"], desc("created_at"), desc("item_id")).select("user_id", "item_id", "status"), "user_id", "left"
    ),
    "admin_kpis": lambda s, d: _admin(s, d),
    "admin_catalog_counts": lambda s, d: star(
        role(s, d, "product").select("product_id", "brand", "name"), "product_id",
        role(s, d, "stock").groupBy("product_id").agg(F.count(F.lit(1)).alias("stock_rows"), F.countDistinct("size_id").alias("sizes")),
        role(s, d, "review").groupBy("product_id").agg(F.count(F.lit(1)).alias("reviews")),
        role(s, d, "item").groupBy("product_id").agg(F.countDistinct("user_id").alias("owners")),
    ).na.fill(0, ["stock_rows", "sizes", "reviews", "owners"]),
    "guarded_delete_check": lambda s, d: deletable(
        role(s, d, "product").select("product_id"), "product_id", role(s, d, "stock").filter("in_stock AND price > 1500"), role(s, d, "item").filter("status = 'owned'")
    ),
}


def _admin(s, d):
    """The dashboard's counts in one row; each table is scanned once."""
    one = [
        role(s, d, "account").agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("segment") == "BUILDING").alias("store_users")),
        role(s, d, "shop").agg(F.count(F.lit(1)).alias("shops"), F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("unverified")),
        role(s, d, "stock").agg(F.count_if("in_stock").alias("in_stock")),
        role(s, d, "follow").agg(F.count(F.lit(1)).alias("follows")),
        role(s, d, "note").agg(F.count(F.lit(1)).alias("broadcasts")),
        role(s, d, "product").agg(F.count(F.lit(1)).alias("products"), F.countDistinct("brand").alias("brands")),
        role(s, d, "review").agg(F.count(F.lit(1)).alias("reviews")),
        role(s, d, "item").agg(F.count_if(F.col("status") == "wished").alias("wishes")),
    ]
    out = one[0]
    for x in one[1:]:
        out = out.crossJoin(x)  # one row each
    return out


_DAY = "json_extract_string(CASE WHEN json_valid(hours) THEN hours END, '$.Wed')"
_PART = r"regexp_extract(lower(day), '^\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)\s*[-–]\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)\s*$', %d)"
_MIN = lambda h, m, ap: f"((CAST({_PART % h} AS INT) % 12 + CASE WHEN {_PART % ap} = 'pm' THEN 12 ELSE 0 END) * 60 + coalesce(TRY_CAST({_PART % m} AS INT), 0))"
_HOURS = f"WITH dd AS (SELECT shop_id, {_DAY} AS day FROM shop), mm AS (SELECT *, {_PART % 1} <> '' AS ok FROM dd), m2 AS (SELECT shop_id, day, CASE WHEN ok THEN {_MIN(1, 2, 3)} END AS opens, CASE WHEN ok THEN {_MIN(4, 5, 6)} END AS c FROM mm), m AS (SELECT *, CASE WHEN c <= opens THEN c + 1440 ELSE c END AS closes FROM m2)"


def _shops_sql(where: str, tail: str = "") -> str:
    return with_roles(
        f"""{_HOURS}, h AS (SELECT shop_id, count(DISTINCT stock_id * 100000 + product_id) AS stock_rows FROM stock WHERE in_stock GROUP BY 1), f AS (SELECT shop_id, count(DISTINCT user_id) AS followers FROM follow GROUP BY 1),
        r AS (SELECT shop_id, avg(rating) AS a, count(*) AS ratings FROM review GROUP BY 1),
        o AS (SELECT shop_id, CASE WHEN lower(day) = 'closed' THEN FALSE WHEN opens IS NOT NULL THEN 15 >= opens // 60 AND 15 < c // 60 END AS is_open FROM m),
        j AS (SELECT shop.*, is_open, coalesce(stock_rows, 0) AS stock_rows, coalesce(followers, 0) AS followers, coalesce(ratings, 0) AS ratings, coalesce(floor(a * 10 + 0.5) / 10, 0.0) AS avg_rating
          FROM shop LEFT JOIN o USING (shop_id) LEFT JOIN h USING (shop_id) LEFT JOIN f USING (shop_id) LEFT JOIN r USING (shop_id))
        SELECT shop_id, name, city, state, verified, is_open, stock_rows, followers, ratings, avg_rating FROM j WHERE {where} {tail}""", "shop", "stock", "follow", "review"
    )


_CLOCK = "CAST(CASE WHEN {0} // 60 > 12 THEN {0} // 60 - 12 WHEN {0} // 60 = 0 THEN 12 ELSE {0} // 60 END AS VARCHAR) || CASE WHEN {0} % 60 > 0 THEN ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0') ELSE '' END || CASE WHEN {0} // 60 >= 12 THEN 'pm' ELSE 'am' END"
_STATUS_PART = r"regexp_extract(lower(t), '(\d+)(?::(\d+))?(am|pm)\s*[-–]\s*(\d+)(?::(\d+))?(am|pm)', %d)"
_STATUS_MIN = lambda h, m, ap: f"((CAST({_STATUS_PART % h} AS INT) % 12 + CASE WHEN {_STATUS_PART % ap} = 'pm' THEN 12 ELSE 0 END) * 60 + coalesce(TRY_CAST({_STATUS_PART % m} AS INT), 0))"
_DAYS = ", ".join(f"({k}, '{d}')" for k, d in enumerate("Wed Thu Fri Sat Sun Mon Tue Wed".split()))

SQL = {
    "shop_search": _shops_sql("(name LIKE '%more of A%' OR description LIKE '%more of A%' OR city LIKE '%more of A%') AND city LIKE '%ION%'", "ORDER BY verified DESC, followers DESC, stock_rows DESC, shop_id LIMIT 30"),
    "shop_search_open": _shops_sql("is_open = TRUE"),
    "shop_search_facilities": _shops_sql("state = 'ASIA' AND has_lounge AND walk_in"),
    "shop_search_near": with_roles(
        f"""WITH f AS (SELECT shop_id, count(DISTINCT user_id) AS n FROM follow GROUP BY 1)
        SELECT shop_id, city, miles, coalesce(n, 0) AS followers FROM {miles_sql(34.05, -118.24, 'shop')} LEFT JOIN f USING (shop_id) WHERE miles IS NULL OR miles <= 700""", "shop", "follow"
    ),
    "shop_open_now": with_roles(f"{_HOURS} SELECT shop_id, CASE WHEN lower(day) = 'closed' THEN FALSE WHEN opens IS NOT NULL THEN 15 >= opens // 60 AND 15 < c // 60 END AS is_open FROM m", "shop"),
    "shop_hours_minutes": with_roles(
        f"""{_HOURS} SELECT shop_id, opens, closes, CAST(CASE WHEN opens // 60 % 12 = 0 THEN 12 ELSE opens // 60 % 12 END AS VARCHAR) || CASE WHEN opens % 60 > 0 THEN ':' || lpad(CAST(opens % 60 AS VARCHAR), 2, '0') ELSE '' END || CASE WHEN opens < 720 THEN 'am' ELSE 'pm' END AS opens_at,
        CASE WHEN opens IS NOT NULL THEN 900 >= opens AND 900 < closes WHEN lower(day) = 'closed' THEN FALSE END AS is_open FROM m""", "shop"
    ),
    "shop_status_label": with_roles(
        f"""WITH d AS (SELECT shop_id, k, n, json_extract_string(CASE WHEN json_valid(hours) THEN hours END, '$.' || n) AS t FROM shop, (VALUES {_DAYS}) v(k, n)),
        e AS (SELECT *, {_STATUS_PART % 1} <> '' AS ok FROM d),
        p AS (SELECT shop_id, k, n, t, ok, CASE WHEN ok THEN {_STATUS_MIN(1, 2, 3)} END AS o, CASE WHEN ok THEN {_STATUS_MIN(4, 5, 6)} END AS c FROM e),
        x AS (SELECT shop_id, arg_min(CASE WHEN k = 1 THEN 'tomorrow' ELSE n END, k) AS n, arg_min(o, k) AS o FROM p WHERE k > 0 AND ok AND t <> 'Closed' GROUP BY shop_id)
        SELECT p.shop_id, CASE WHEN shop.hours IS NULL THEN NULL
          WHEN coalesce(t, '') IN ('', 'Closed') THEN CASE WHEN x.o IS NULL THEN 'Closed today' ELSE 'Opens ' || x.n || ' at ' || {_CLOCK.format('x.o')} END
          WHEN NOT ok THEN t WHEN 900 < p.o THEN CASE WHEN p.o - 900 < 60 THEN 'Opens in ' || (p.o - 900) || 'm' ELSE 'Opens at ' || {_CLOCK.format('p.o')} END
          WHEN 900 < p.c THEN CASE WHEN p.c - 900 <= 30 THEN 'Closes in ' || (p.c - 900) || 'm' WHEN p.c - 900 <= 90 THEN 'Closes in ' || CAST(floor((p.c - 900) / 30.0 + 0.5) * 30 AS INT) || 'm' ELSE 'Open until ' || {_CLOCK.format('p.c')} END
          ELSE 'Closed now' END AS status
        FROM p JOIN shop USING (shop_id) LEFT JOIN x USING (shop_id) WHERE p.k = 0""", "shop"
    ),
    "shop_within_radius": with_roles(f"SELECT shop_id, city, miles FROM {miles_sql(34.05, -118.24, 'shop')} WHERE miles IS NULL OR miles <= 700 ORDER BY miles NULLS LAST, shop_id", "shop"),
    "city_counts": with_roles("SELECT city, state, count(*) AS n FROM shop GROUP BY city, state", "shop"),
    "shop_detail_stats": with_roles(
        """WITH r AS (SELECT shop_id, avg(rating) AS avg_rating, count(*) AS reviews FROM review GROUP BY 1), b AS (SELECT shop_id, count(DISTINCT brand) AS brands FROM stock JOIN product USING (product_id) WHERE in_stock GROUP BY 1)
        SELECT shop_id, name, avg_rating, reviews, brands FROM shop LEFT JOIN r USING (shop_id) LEFT JOIN b USING (shop_id)""", "shop", "review", "stock", "product"
    ),
    "new_arrivals": with_roles("SELECT updated_at, stock_id, product_id, shop_id, name FROM stock JOIN product USING (product_id) WHERE is_new AND in_stock ORDER BY updated_at DESC, stock_id, product_id, shop_id LIMIT 6", "stock", "product"),
    "inventory_page": with_roles(
        """SELECT stock_id, product_id, brand, name, size_id, price, featured, is_new FROM stock JOIN product USING (product_id) WHERE shop_id = 3 AND in_stock AND size_id IS NOT NULL
        ORDER BY featured DESC, is_new DESC, brand, name, stock_id, product_id LIMIT 40""", "stock", "product"
    ),
    "inventory_page_total": with_roles("SELECT count(*) AS total, CAST(ceil(count(*) / 40.0) AS BIGINT) AS pages FROM stock WHERE shop_id = 3 AND in_stock", "stock"),
    "stock_health": with_roles(
        "SELECT shop_id, count(*) FILTER (WHERE quantity < 5 AND quantity > 0) AS low, count(*) FILTER (WHERE NOT in_stock OR quantity = 0) AS out, count(*) FILTER (WHERE quantity IS NULL) AS unknown FROM stock GROUP BY shop_id", "stock"
    ),
    "analytics_kpis": with_roles(
        f"""WITH v AS (SELECT shop_id, count(*) AS views, count(*) FILTER (WHERE viewed_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAYS AND viewed_at <= TIMESTAMP '{AS_OF}') AS views_7d, count(*) FILTER (WHERE viewed_at > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS AND viewed_at <= TIMESTAMP '{AS_OF}') AS views_30d FROM shop_view GROUP BY 1),
        s AS (SELECT shop_id, count(*) AS rows, count(*) FILTER (WHERE in_stock AND quantity < 5 AND quantity > 0) AS low, count(*) FILTER (WHERE NOT in_stock OR quantity = 0) AS out FROM stock GROUP BY 1), f AS (SELECT shop_id, count(*) AS followers FROM follow GROUP BY 1)
        SELECT shop_id, coalesce(views, 0) AS views, coalesce(views_7d, 0) AS views_7d, coalesce(views_30d, 0) AS views_30d, coalesce(rows, 0) AS rows, coalesce(low, 0) AS low, coalesce(out, 0) AS out, coalesce(followers, 0) AS followers
        FROM v FULL JOIN s USING (shop_id) FULL JOIN f USING (shop_id)""", "shop_view", "stock", "follow"
    ),
    "daily_views": with_roles(f"SELECT CAST(viewed_at AS DATE) AS day, count(*) AS n FROM shop_view WHERE viewed_at > TIMESTAMP '{AS_OF}' - INTERVAL 14 DAYS GROUP BY 1", "shop_view"),
    "top_items": with_roles(
        """WITH t AS (SELECT product_id, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS units FROM stock WHERE in_stock GROUP BY 1 ORDER BY n DESC, product_id LIMIT 5)
        SELECT product_id, n, units, brand, name FROM t JOIN product USING (product_id)""", "stock", "product"
    ),
    "demand_window": with_roles(
        """WITH w AS (SELECT item_id, nullif(product_id, 0) AS product_id, created_at FROM item WHERE status = 'wished')
        SELECT item_id, product_id, created_at, count(*) OVER (PARTITION BY product_id) AS demand FROM w ORDER BY created_at DESC, item_id LIMIT 100""", "item"
    ),
    "top_requested": with_roles("SELECT product_id, count(*) AS n FROM item WHERE status = 'wished' AND priority IS NOT NULL GROUP BY 1 ORDER BY n DESC, product_id LIMIT 5", "item"),
    "broadcast_reads": with_roles(
        """WITH r AS (SELECT note_id, count(user_id) AS readers FROM note_read GROUP BY 1), f AS (SELECT shop_id, count(*) AS followers FROM follow GROUP BY 1)
        SELECT note_id, shop_id, coalesce(readers, 0) AS readers, coalesce(followers, 0) AS followers, CASE WHEN coalesce(followers, 0) > 0 THEN floor(coalesce(readers, 0) * 1000.0::DOUBLE / followers + 0.5) / 10 ELSE 0.0 END AS read_percent
        FROM note LEFT JOIN r USING (note_id) LEFT JOIN f USING (shop_id)""", "note", "note_read", "follow"
    ),
    "active_deals": with_roles(
        """SELECT deal_id, shop_id, product.name AS product, discount, expires_at, deal.created_at FROM deal LEFT JOIN product USING (product_id)
        WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2001-01-01' ORDER BY deal.created_at DESC, deal_id LIMIT 50""", "deal", "product"
    ),
    "latest_verification": with_roles(
        "WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, item_id DESC) AS k FROM item) SELECT user_id, name, item_id, status FROM account LEFT JOIN (SELECT * FROM l WHERE k = 1) USING (user_id)", "item", "account"
    ),
    "admin_kpis": with_roles(
        """SELECT (SELECT count(*) FROM account) AS users, (SELECT count(*) FROM account WHERE segment = 'BUILDING') AS store_users, (SELECT count(*) FROM shop) AS shops, (SELECT count(*) FROM shop WHERE verified) AS verified, (SELECT count(*) FROM shop WHERE NOT verified) AS unverified,
        (SELECT count(*) FROM stock WHERE in_stock) AS in_stock, (SELECT count(*) FROM follow) AS follows, (SELECT count(*) FROM note) AS broadcasts,
        (SELECT count(*) FROM product) AS products, (SELECT count(DISTINCT brand) FROM product) AS brands, (SELECT count(*) FROM review) AS reviews, (SELECT count(*) FROM item WHERE status = 'wished') AS wishes""",
        "account", "shop", "product", "review", "item", "stock", "follow", "note"
    ),
    "admin_catalog_counts": with_roles(
        """WITH s AS (SELECT product_id, count(*) AS stock_rows, count(DISTINCT size_id) AS sizes FROM stock GROUP BY 1), r AS (SELECT product_id, count(*) AS reviews FROM review GROUP BY 1), o AS (SELECT product_id, count(DISTINCT user_id) AS owners FROM item GROUP BY 1)
        SELECT product_id, brand, name, coalesce(stock_rows, 0) AS stock_rows, coalesce(sizes, 0) AS sizes, coalesce(reviews, 0) AS reviews, coalesce(owners, 0) AS owners
        FROM product LEFT JOIN s USING (product_id) LEFT JOIN r USING (product_id) LEFT JOIN o USING (product_id)""", "product", "stock", "review", "item"
    ),
    "guarded_delete_check": with_roles(
        """SELECT product_id FROM product p WHERE NOT EXISTS (SELECT 1 FROM stock s WHERE s.product_id = p.product_id AND in_stock AND price > 1500) AND NOT EXISTS (SELECT 1 FROM item i WHERE i.product_id = p.product_id AND status = 'owned')""", "product", "stock", "item"
    ),
}
