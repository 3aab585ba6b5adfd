"""What the pages show: text and number forms, client-side filters, groups and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_up, or_default, tenth
from ..functions.text import blank_to_null, clean_phone, clean_url, extension, first_named, first_underscore, first_word, fitted, join_present, json_shown, shorten, tags, with_suffix, zip_code
from ..functions.times import age_label, day_key, seconds_between, stopwatch, whole_minutes
from ..operators.relational import asc, contains_any, desc, grouped_by_fallback, nested, top, upcoming, valid_ranges
from ..roles import AS_OF, role, with_roles
from ..streaming.views import utc_date, utc_instant, windowed
from .dashboards import ranked

#: Shades by the name that a wrapper's name holds, the first that fits.
SHADES = {"re": "#9e6832", "Bl": "#c4844a", "s": "#b89060"}


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def suggestions(products: DataFrame, shops: DataFrame, q: str, k: int = 5) -> DataFrame:
    """Products, then shops whose names hold the query whatever its case, k of each, tagged by type."""
    one = top(products.filter(contains_any(q, "brand", "name")).select(F.lit("product").alias("type"), F.col("product_id").alias("id"), F.concat_ws(" ", "brand", "name").alias("label")), k, asc("label"), asc("id"))
    two = top(shops.filter(contains_any(q, "name", "city")).select(F.lit("shop").alias("type"), F.col("shop_id").alias("id"), F.col("name").alias("label")), k, asc("label"), asc("id"))
    return one.unionByName(two)


def completeness(shops: DataFrame, stock: DataFrame) -> DataFrame:
    """How much of its profile each shop has filled in, as a percentage of four steps."""
    held = stock.groupBy("shop_id").agg(F.count(F.lit(1)).alias("_held"))
    steps = [F.col("lat").isNotNull() & (F.coalesce("city", F.lit("")) != ""), F.coalesce("_held", F.lit(0)) > 0, F.col("verified"), F.length(F.coalesce("description", F.lit(""))) > 40]
    done = sum((s.cast("int") for s in steps[1:]), steps[0].cast("int"))
    return shops.join(held, "shop_id", "left").select("shop_id", half_up(done * 100.0 / len(steps)).alias("pct"))


def _events(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").withColumn("ts", utc_instant(F.col("ts")))


QUERIES = {
    "text_forms": lambda s, d: role(s, d, "account").select(
        "user_id", join_present(" ", F.col("segment"), F.expr("CASE WHEN user_id % 3 = 0 THEN '' WHEN user_id % 3 = 1 THEN name END")).alias("joined"), shorten(F.col("name"), 12).alias("short"),
        with_suffix(F.col("segment"), F.expr("CASE WHEN user_id % 2 = 0 THEN name ELSE '' END"), 8).alias("titled"), F.array_join(tags(F.concat_ws(",", F.lit(" a "), F.lit(""), F.col("segment"))), "|").alias("tags"),
        json_shown(F.expr("CASE WHEN user_id % 2 = 0 THEN '[\"a\",\"b\"]' ELSE 'not a list' END")).alias("shown"), blank_to_null(F.expr("CASE WHEN user_id % 2 = 0 THEN '  ' ELSE ' x ' END")).alias("filled"),
        first_underscore(F.lit("in_stock_now")).alias("spaced"), fitted(F.col("segment"), 9).alias("fitted"), first_word(F.concat_ws(" ", "segment", "name")).alias("first"),
        extension(F.expr("CASE WHEN user_id % 2 = 0 THEN 'Photo.Of.JPG' ELSE 'noext' END")).alias("ext"), F.base64(F.encode("segment", "utf-8")).alias("coded"), F.decode(F.unbase64(F.base64(F.encode("name", "utf-8"))), "utf-8").alias("back"),
        zip_code(F.expr("CASE WHEN user_id % 2 = 0 THEN 'No 123456, Austin 78701-1234' ELSE '1234' END")).alias("zip"),
        clean_phone(F.expr("CASE user_id % 3 WHEN 0 THEN '(503) 555-0101' WHEN 1 THEN '1-503-555-0101' ELSE '123' END"), plus=False).alias("phone"),
    ),
    "url_forms": lambda s, d: s.read.parquet(f"{d}/pages.parquet").groupBy(clean_url(F.regexp_replace("url", "^http://", "")).alias("url")).agg(F.count(F.lit(1)).alias("n")),
    "number_forms": lambda s, d: role(s, d, "review").groupBy("product_id").agg(F.avg("rating").alias("a"), F.avg("draw_rating").alias("b"), F.count(F.lit(1)).alias("n")).select(
        "product_id", tenth(F.col("a")).alias("shown"), half_up(F.col("b") * 20).alias("percent"), or_default(F.col("n") - 15, F.lit(-1)).alias("or_default")
    ),
    "time_forms": lambda s, d: _events(s, d).withColumn("secs", seconds_between(F.col("ts").cast("timestamp_ntz"), now())).groupBy(
        day_key(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("day"), age_label(F.col("secs"), just=False).alias("age"), stopwatch(F.expr("secs % 7200")).alias("watch"), whole_minutes(F.expr("secs % 7200")).alias("minutes")
    ).agg(F.count(F.lit(1)).alias("n")),
    "wrapper_shades": lambda s, d: role(s, d, "product").groupBy("wrapper", first_named(F.col("wrapper"), SHADES).alias("shade")).agg(F.count(F.lit(1)).alias("n")),
    "suggestions": lambda s, d: suggestions(role(s, d, "product"), role(s, d, "shop"), "R 1", 5).unionByName(suggestions(role(s, d, "product"), role(s, d, "shop"), "ION_1", 5)),
    "valid_ranges": lambda s, d: valid_ranges(
        role(s, d, "review").select("review_id", "product_id", "rating", F.expr("CASE WHEN draw_rating > 60 THEN 'great' WHEN draw_rating > 20 THEN 'good' END").alias("word"), "draw_rating"), {"rating": (55, 95), "draw_rating": (1, 80)}, {"word": ("good", "bad")}
    ).groupBy("valid", "why").agg(F.count(F.lit(1)).alias("n")),
    "month_filter": lambda s, d: role(s, d, "item").filter(F.date_format("created_at", "yyyy-MM-dd").startswith("1997-05")).groupBy(F.col("created_at").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n")),
    "upcoming_split": lambda s, d: upcoming(role(s, d, "item").select("user_id", "created_at"), "created_at", F.lit("1998-01-01").cast("timestamp_ntz")).groupBy("user_id", "upcoming").agg(F.count(F.lit(1)).alias("n")),
    "requests_by_product": lambda s, d: grouped_by_fallback(
        role(s, d, "item").filter("status = 'wished'").selectExpr("item_id", "CASE WHEN item_id % 3 = 0 THEN NULL ELSE product_id END AS product_id", "CASE WHEN item_id % 2 = 0 THEN 'free ' || CAST(item_id % 5 AS STRING) ELSE '' END AS free"), "product_id", "free"
    ).orderBy(desc("n"), asc("key")),
    "stock_by_shop_json": lambda s, d: nested(ranked(role(s, d, "stock").filter("in_stock"), "shop_id", 3, asc("price"), asc("stock_id"), asc("product_id")), ["shop_id"], ["price", "stock_id", "product_id"], [], "rows").select("shop_id", F.to_json(F.transform("rows", lambda r: F.struct(r["stock_id"].alias("id"), r["product_id"].alias("product")))).alias("cheapest")),
    "profile_completeness": lambda s, d: completeness(role(s, d, "shop"), role(s, d, "stock")),
    "event_shops": lambda s, d: role(s, d, "note").alias("e").join(role(s, d, "shop").alias("s"), "shop_id").select("e.*", F.col("s.name").alias("shop_name"), F.col("s.city").alias("shop_city")).groupBy("shop_id", "shop_name", "shop_city").agg(F.count(F.lit(1)).alias("n")),
    "batch_take": lambda s, d: top(role(s, d, "account").filter("balance < 0").select("user_id", "balance"), 25, asc("balance"), asc("user_id")),
    "confident_matches": lambda s, d: _confident(s, d),
    "sliding_views": lambda s, d: windowed(_events(s, d), "sliding").select(utc_date(F.col("start")).alias("first"), utc_date(F.col("end")).alias("after"), "n"),
    "session_views": lambda s, d: windowed(_events(s, d), "session").select("user_id", F.unix_timestamp("start").alias("first"), F.unix_timestamp("end").alias("after"), "n"),
    "preference_matrix": lambda s, d: _preferences(s, d),
}


def _confident(s, d) -> DataFrame:
    """How many rows of the fuzzy upload reach each threshold of confidence."""
    from .files import QUERIES as files

    found = files["fuzzy_match_best"](s, d)
    return found.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("confidence") >= c).alias(f"at_{c}") for c in (35, 50, 70)])


def _preferences(s, d) -> DataFrame:
    """Notes of each type that reach a follower, by a table of switches (user, type, on), one row each."""
    kinds = ("announcement", "deal", "new_arrival", "event", "community")
    switches = role(s, d, "account").select("user_id", F.explode(F.array(*[F.struct(F.lit(k).alias("type"), ((F.col("user_id") + i) % 3 != 0).alias("on")) for i, k in enumerate(kinds)])).alias("p")).select("user_id", "p.*")
    per_shop = role(s, d, "note").groupBy("shop_id", "type").agg(F.count(F.lit(1)).alias("n"))
    reach = role(s, d, "follow").join(per_shop, "shop_id").join(switches.filter("on"), ["user_id", "type"])
    return reach.groupBy("user_id").agg(F.sum("n").alias("notes"))


_SHADE = "CASE WHEN contains(lower(wrapper), 're') THEN '#9e6832' WHEN contains(lower(wrapper), 'bl') THEN '#c4844a' WHEN contains(lower(wrapper), 's') THEN '#b89060' END"
_SECS = f"datesub('second', ts, TIMESTAMP '{AS_OF}')"


def _suggest_sql(q: str) -> str:
    return f"""(SELECT 'product' AS type, product_id AS id, brand || ' ' || name AS label FROM product WHERE contains(lower(brand), '{q}') OR contains(lower(name), '{q}') ORDER BY label, id LIMIT 5) UNION ALL
    (SELECT 'shop', shop_id, name FROM shop WHERE contains(lower(name), '{q}') OR contains(lower(city), '{q}') ORDER BY name, shop_id LIMIT 5)"""


SQL = {
    "text_forms": with_roles(
        """SELECT user_id, segment || CASE WHEN user_id % 3 = 1 THEN ' ' || name ELSE '' END AS joined, substr(name, 1, 12) || '…' AS short, segment || CASE WHEN user_id % 2 = 0 THEN ' — ' || substr(name, 1, 8) ELSE '' END AS titled, 'a|' || segment AS tags,
        CASE WHEN user_id % 2 = 0 THEN 'a, b' ELSE 'not a list' END AS shown, CASE WHEN user_id % 2 = 1 THEN 'x' END AS filled, 'in stock_now' AS spaced, rpad(substr(segment, 1, 9), 9, ' ') AS fitted, string_split(segment, ' ')[1] AS first,
        CASE WHEN user_id % 2 = 0 THEN 'jpg' ELSE 'noext' END AS ext, base64(encode(segment)) AS coded, name AS back, CASE WHEN user_id % 2 = 0 THEN '78701' ELSE '' END AS zip, CASE WHEN user_id % 3 < 2 THEN '15035550101' END AS phone FROM account""", "account"
    ),
    "url_forms": r"SELECT regexp_replace(regexp_replace(CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE 'https://' || u END, '\?.*$', ''), '/+$', '') AS url, count(*) AS n FROM (SELECT nullif(trim(regexp_replace(url, '^http://', '')), '') AS u FROM pages) GROUP BY 1",
    "number_forms": with_roles(
        "WITH g AS (SELECT product_id, avg(rating) AS a, avg(draw_rating) AS b, count(*) AS n FROM review GROUP BY 1) SELECT product_id, floor(a * 10 + 0.5) / 10 AS shown, CAST(floor(b * 20 + 0.5) AS BIGINT) AS percent, CASE WHEN n = 15 THEN -1 ELSE n - 15 END AS or_default FROM g", "review"
    ),
    "time_forms": f"""WITH e AS (SELECT ts, {_SECS} AS secs FROM events) SELECT strftime(ts, '%Y-%m-%d') AS day, CASE WHEN secs < 3600 THEN CAST(floor(secs / 60) AS BIGINT) || 'm ago' WHEN secs < 86400 THEN CAST(floor(secs / 3600) AS BIGINT) || 'h ago' ELSE CAST(floor(secs / 86400) AS BIGINT) || 'd ago' END AS age,
        CAST(floor(secs % 7200 / 60) AS BIGINT) || ':' || lpad(CAST(secs % 7200 % 60 AS VARCHAR), 2, '0') AS watch, CAST(floor(secs % 7200 / 60.0 + 0.5) AS BIGINT) AS minutes, count(*) AS n FROM e GROUP BY ALL""",
    "wrapper_shades": with_roles(f"SELECT wrapper, {_SHADE} AS shade, count(*) AS n FROM product GROUP BY ALL", "product"),
    "suggestions": with_roles(f"{_suggest_sql('r 1')} UNION ALL {_suggest_sql('ion_1')}", "product", "shop"),
    "valid_ranges": with_roles(
        """WITH r AS (SELECT rating, draw_rating, CASE WHEN draw_rating > 60 THEN 'great' WHEN draw_rating > 20 THEN 'good' END AS word FROM review),
        w AS (SELECT CASE WHEN NOT coalesce(rating BETWEEN 55 AND 95, FALSE) THEN 'rating' WHEN NOT coalesce(draw_rating BETWEEN 1 AND 80, FALSE) THEN 'draw_rating' WHEN NOT coalesce(word IN ('good', 'bad'), FALSE) THEN 'word' END AS why FROM r)
        SELECT why IS NULL AS valid, why, count(*) AS n FROM w GROUP BY ALL""", "review"
    ),
    "month_filter": with_roles("SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM item WHERE starts_with(strftime(created_at, '%Y-%m-%d'), '1997-05') GROUP BY 1", "item"),
    "upcoming_split": with_roles("SELECT user_id, created_at >= TIMESTAMP '1998-01-01' AS upcoming, count(*) AS n FROM item GROUP BY ALL", "item"),
    "requests_by_product": with_roles(
        """WITH r AS (SELECT CASE WHEN item_id % 3 = 0 THEN NULL ELSE product_id END AS p, CASE WHEN item_id % 2 = 0 THEN 'free ' || item_id % 5 ELSE '' END AS f FROM item WHERE status = 'wished')
        SELECT coalesce(CAST(nullif(p, 0) AS VARCHAR), nullif(f, ''), 'unknown') AS key, count(*) AS n FROM r GROUP BY 1""", "item"
    ),
    "stock_by_shop_json": with_roles(
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY price NULLS FIRST, stock_id, product_id) AS z FROM stock WHERE in_stock)
        SELECT shop_id, '[' || string_agg('{"id":' || stock_id || ',"product":' || product_id || '}', ',' ORDER BY z) || ']' AS cheapest FROM r WHERE z <= 3 GROUP BY shop_id""", "stock"
    ),
    "profile_completeness": with_roles(
        """WITH h AS (SELECT DISTINCT shop_id AS held FROM stock) SELECT shop_id, CAST(floor((CAST(lat IS NOT NULL AND coalesce(city, '') <> '' AS INT) + CAST(held IS NOT NULL AS INT) + CAST(verified AS INT) + CAST(length(coalesce(description, '')) > 40 AS INT)) * 100.0::DOUBLE / 4 + 0.5) AS BIGINT) AS pct
        FROM shop LEFT JOIN h ON held = shop_id""", "shop", "stock"
    ),
    "event_shops": with_roles("SELECT shop_id, name AS shop_name, city AS shop_city, count(*) AS n FROM note JOIN shop USING (shop_id) GROUP BY ALL", "note", "shop"),
    "batch_take": with_roles("SELECT user_id, balance FROM account WHERE balance < 0 ORDER BY balance, user_id LIMIT 25", "account"),
    "sliding_views": """WITH e AS (SELECT CAST(ts AS DATE) AS day FROM events WHERE event_type = 'view'), w AS (SELECT CAST(day - CAST(k AS INT) AS DATE) AS first FROM e, range(7) r(k)) SELECT first, CAST(first + 7 AS DATE) AS after, count(*) AS n FROM w GROUP BY 1""",
    "session_views": """WITH e AS (SELECT user_id, ts FROM events WHERE event_type = 'view'), m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM e),
        g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
        SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS first, CAST(floor(epoch(max(ts) + INTERVAL 30 MINUTES)) AS BIGINT) AS after, count(*) AS n FROM g GROUP BY user_id, k""",
    "preference_matrix": with_roles(
        """WITH n AS (SELECT shop_id, type, count(*) AS c FROM note GROUP BY 1, 2) SELECT user_id, CAST(sum(c) AS BIGINT) AS notes FROM follow JOIN n USING (shop_id) JOIN account USING (user_id)
        WHERE (user_id + CASE type WHEN 'announcement' THEN 0 WHEN 'deal' THEN 1 WHEN 'new_arrival' THEN 2 WHEN 'event' THEN 3 ELSE 4 END) % 3 <> 0 GROUP BY 1""", "note", "follow", "account"
    ),
}


def _confident_sql() -> str:
    from .files import SQL as files

    return f"SELECT count(*) AS n, count(*) FILTER (WHERE confidence >= 35) AS at_35, count(*) FILTER (WHERE confidence >= 50) AS at_50, count(*) FILTER (WHERE confidence >= 70) AS at_70 FROM ({files['fuzzy_match_best']})"


SQL["confident_matches"] = _confident_sql()
