"""People: notifications, community, collections, wish lists, profiles and achievements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, ladder, ordinal
from ..functions.times import age_label, month_cells, seconds_between
from ..operators.relational import asc, desc, some, star, top
from ..roles import AS_OF, TYPES, role, with_roles


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def preferences(follows: DataFrame) -> DataFrame:
    """Follow edges with a switch for each type of note; edges of the given tables get them by arithmetic."""
    k = F.col("user_id") + F.col("shop_id")
    return follows.withColumns({f"on_{t}": k % (i + 2) != 0 for i, t in enumerate(TYPES)})


def wanted(notes: DataFrame, follows: DataFrame, user: int) -> DataFrame:
    """A user's notes: of followed shops, of types switched on, by others; posts and events of their own are left out."""
    mine = preferences(follows.filter(F.col("user_id") == user)).drop("user_id")
    switched = some(*[(F.col("type") == t) & F.col(f"on_{t}") for t in TYPES])
    own = F.col("type").isin("community", "event") & F.col("created_by").eqNullSafe(user)
    return notes.join(mine, "shop_id").filter(switched & ~own).select(*notes.columns)


def feed(notes: DataFrame, follows: DataFrame, reads: DataFrame, user: int) -> DataFrame:
    read = reads.filter(F.col("user_id") == user).select("note_id", F.lit(1).alias("r")).distinct()
    flagged = wanted(notes, follows, user).join(read, "note_id", "left")
    return top(flagged.select("note_id", "shop_id", "type", "created_at", F.coalesce("r", F.lit(0)).alias("is_read")), 50, desc("created_at"), asc("note_id"))


def unread(notes: DataFrame, reads: DataFrame, user: int) -> DataFrame:
    return notes.join(reads.filter(F.col("user_id") == user), "note_id", "left_anti")


def mark_all_read(notes: DataFrame, follows: DataFrame, reads: DataFrame, user: int) -> DataFrame:
    """The reads to add: every unread note of followed shops, whatever the switches say."""
    shops = follows.filter(F.col("user_id") == user).select("shop_id")
    return unread(notes.join(shops, "shop_id", "left_semi"), reads, user).select("note_id", F.lit(user).cast("long").alias("user_id"))


def community(posts: DataFrame, likes: DataFrame, replies: DataFrame, user: int) -> DataFrame:
    n_likes = likes.groupBy("post_id").agg(F.countDistinct("user_id").alias("likes"), F.max((F.col("user_id") == user).cast("int")).alias("my_like"))
    n_replies = replies.groupBy("post_id").agg(F.count(F.lit(1)).alias("replies"))
    return star(posts, "post_id", n_likes, n_replies).na.fill(0, ["likes", "my_like", "replies"]).select("post_id", "shop_id", "author", "pinned", "likes", "my_like", "replies")


def rsvp_counts(rsvps: DataFrame) -> DataFrame:
    return rsvps.groupBy("event_id").agg(
        F.countDistinct(F.when(F.col("status") == "going", F.col("user_id"))).alias("going"), F.countDistinct(F.when(F.col("status") == "maybe", F.col("user_id"))).alias("maybe")
    )


def followed_shops(follows: DataFrame, shops: DataFrame, notes: DataFrame, reads: DataFrame, user: int) -> DataFrame:
    """Shops that a user follows, with all their followers and the user's unread notes, whatever the switches say."""
    mine = follows.filter(F.col("user_id") == user).select("shop_id")
    fans = follows.join(mine, "shop_id", "left_semi").groupBy("shop_id").agg(F.count(F.lit(1)).alias("followers"))
    new = unread(notes.join(mine, "shop_id", "left_semi"), reads, user).groupBy("shop_id").agg(F.count(F.lit(1)).alias("unread"))
    return star(mine.join(shops.select("shop_id", "name"), "shop_id"), "shop_id", fans, new).na.fill(0, ["followers", "unread"])


#: The least number of badges of each level.
LEVELS = ((12, "Master"), (8, "Aficionado"), (4, "Enthusiast"), (1, "Beginner"))


def achievements(users: DataFrame, items: DataFrame, products: DataFrame, reviews: DataFrame, follows: DataFrame, homes: tuple[str, str] = ("NATION_0", "NATION_1"), label: str = "Brand#5") -> DataFrame:
    """Fifteen badges and the level of each user: used items, reviews, items owned, countries and brands, the best rating, wishes and shops followed.

    Countries and brands are few, so their sets per user are small.
    """
    used = F.col("status") == "used"
    known = items.join(products.select("product_id", "brand", "country"), "product_id", "left")
    own = known.groupBy("user_id").agg(
        F.count_if(used).alias("used"), F.sum(F.when(F.col("status") == "owned", F.col("quantity")).otherwise(0)).alias("owned"), F.count_if(F.col("status") == "wished").alias("wished"),
        F.collect_set(F.when(used, F.col("country"))).alias("countries"), F.collect_set("brand").alias("brands"),
        F.collect_set(F.when(F.col("status") == "owned", F.col("country"))).alias("at_home"),
    )
    rated = reviews.groupBy("user_id").agg(F.count(F.lit(1)).alias("reviews"), F.max("rating").alias("best"))
    fans = follows.groupBy("user_id").agg(F.count(F.lit(1)).alias("shops"))
    none = F.array().cast("array<string>")
    joined = star(users.select("user_id"), "user_id", own, rated, fans).na.fill(0, ["used", "owned", "wished", "reviews", "best", "shops"])
    joined = joined.withColumns({c: F.coalesce(c, none) for c in ("countries", "brands", "at_home")}).withColumn("n_countries", F.size("countries"))
    least = {"used": (1, 5, 10, 25), "reviews": (1, 5), "owned": (10,), "n_countries": (3, 5), "best": (95,), "wished": (5,), "shops": (3,)}
    earned = [F.col(c) >= n for c, steps in least.items() for n in steps]
    earned += [F.array_contains("countries", h) for h in homes] + [F.array_contains("brands", label)]
    count = sum((b.cast("int") for b in earned[1:]), earned[0].cast("int"))
    all_countries = F.size(F.array_union("countries", "at_home"))
    return joined.withColumn("badges", count).select("user_id", "used", "reviews", "owned", "n_countries", all_countries.alias("n_all_countries"), F.size("brands").alias("n_brands"), "best", "wished", "shops", "badges", ladder(F.col("badges"), LEVELS, "New").alias("level"))


def _fanout(s, d):
    """What a join of reviews and stock rows before counting gives: reviews times stock rows."""
    r = role(s, d, "review").groupBy("product_id").agg(F.count(F.lit(1)).alias("reviews"))
    n = role(s, d, "stock").filter("in_stock").groupBy("product_id").agg(F.count(F.lit(1)).alias("rows"))
    joined = star(role(s, d, "product").select("product_id"), "product_id", r, n)
    return joined.select("product_id", F.coalesce("reviews", F.lit(0)).alias("review_count"), (F.coalesce("reviews", F.lit(0)) * F.greatest(F.coalesce("rows", F.lit(0)), F.lit(1))).alias("fanout_count"))


QUERIES = {
    "notification_feed": lambda s, d: feed(role(s, d, "note"), role(s, d, "follow"), role(s, d, "note_read"), 8),
    "unread_count": lambda s, d: unread(wanted(role(s, d, "note"), role(s, d, "follow"), 8), role(s, d, "note_read"), 8).agg(F.count(F.lit(1)).alias("n")),
    "mark_all_read_delta": lambda s, d: mark_all_read(role(s, d, "note"), role(s, d, "follow"), role(s, d, "note_read"), 8),
    "event_rsvp_counts": lambda s, d: rsvp_counts(role(s, d, "rsvp")),
    "calendar_or_in": lambda s, d: (
        role(s, d, "note").join(role(s, d, "follow").filter("user_id = 8").select("shop_id", F.lit(True).alias("f")), "shop_id", "left")
        .join(role(s, d, "rsvp").filter("user_id = 8").select(F.col("event_id").alias("note_id"), F.lit(True).alias("r")).distinct(), "note_id", "left")
        .filter(F.col("f") | F.col("r")).select("note_id", "shop_id", "created_at")
    ),
    "community_posts": lambda s, d: community(role(s, d, "post"), role(s, d, "post_like"), role(s, d, "reply"), 8),
    "followed_shops": lambda s, d: followed_shops(role(s, d, "follow"), role(s, d, "shop"), role(s, d, "note"), role(s, d, "note_read"), 8),
    "collection_totals": lambda s, d: role(s, d, "item").groupBy("user_id").agg(
        *[F.count_if(F.col("status") == x).alias(x) for x in ("owned", "used", "wished")], F.sum(F.when(F.col("status") == "owned", F.col("quantity")).otherwise(0)).alias("units"),
        half_up(F.coalesce(F.sum(F.when((F.col("status") == "owned") & (F.col("price") > 0), F.floor(F.col("price") * 100 + 0.5) * F.col("quantity"))), F.lit(0)).cast("double")).alias("value_cents"),
    ),
    "wish_list_priority": lambda s, d: top(
        role(s, d, "item").filter("status = 'wished'").select("item_id", "user_id", "priority", ordinal(F.col("priority"), ("high", "medium", "low")).alias("place"), "created_at"),
        200, asc("place"), desc("created_at"), asc("item_id"),
    ),
    "wish_list_fanout_count": _fanout,
    "user_public_profile": lambda s, d: star(
        role(s, d, "account").select("user_id", "name"), "user_id",
        role(s, d, "item").groupBy("user_id").agg(F.count(F.lit(1)).alias("items"), F.sum("quantity").alias("units")), role(s, d, "follow").groupBy("user_id").agg(F.count(F.lit(1)).alias("follows")),
    ).na.fill(0, ["items", "units", "follows"]),
    "activity_feed": lambda s, d: top(
        role(s, d, "item").filter("status = 'used' AND user_id <> 8").join(role(s, d, "account").select("user_id", "name"), "user_id").select("item_id", "user_id", "name", "created_at"), 20, desc("created_at"), asc("item_id")
    ),
    "achievements": lambda s, d: achievements(
        role(s, d, "account"), role(s, d, "item"), role(s, d, "product"),
        role(s, d, "review").join(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id")), "order_id"), role(s, d, "follow"),
    ),
    "recently_viewed_top8": lambda s, d: (
        role(s, d, "shop_view").groupBy("user_id", "shop_id").agg(F.max(F.struct("viewed_at", "view_id")).alias("v"))
        .withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("v").desc()))).filter("place <= 8").select("user_id", "shop_id", "place")
    ),
    "month_grid": lambda s, d: (
        role(s, d, "item").agg(F.trunc(F.max("created_at").cast("date"), "month").alias("first")).select(F.posexplode(month_cells(F.col("first"))).alias("cell", "day"))
        .join(role(s, d, "item").groupBy(F.col("created_at").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n")), "day", "left").select("cell", "day", F.coalesce("n", F.lit(0)).alias("n"))
    ),
    "time_ago_bucket": lambda s, d: role(s, d, "note").groupBy(age_label(seconds_between(F.col("created_at"), now())).alias("age")).agg(F.count(F.lit(1)).alias("n")),
}

_READ = "SELECT note_id FROM note_read WHERE user_id = 8"
_WANTED = "WITH mine AS (SELECT * FROM follow WHERE user_id = 8), wanted AS (SELECT n.* FROM note n JOIN mine USING (shop_id) WHERE (" + " OR ".join(
    f"(type = '{t}' AND (mine.user_id + mine.shop_id) % {i + 2} <> 0)" for i, t in enumerate(TYPES)
) + ") AND NOT (type IN ('community', 'event') AND created_by IS NOT DISTINCT FROM 8)) "
_NOTES = ("note", "follow", "note_read")

SQL = {
    "notification_feed": with_roles(_WANTED + f"SELECT note_id, shop_id, type, created_at, CASE WHEN note_id IN ({_READ}) THEN 1 ELSE 0 END AS is_read FROM wanted ORDER BY created_at DESC, note_id LIMIT 50", *_NOTES),
    "unread_count": with_roles(_WANTED + f"SELECT count(*) AS n FROM wanted WHERE note_id NOT IN ({_READ})", *_NOTES),
    "mark_all_read_delta": with_roles(f"SELECT note_id, CAST(8 AS BIGINT) AS user_id FROM note WHERE shop_id IN (SELECT shop_id FROM follow WHERE user_id = 8) AND note_id NOT IN ({_READ})", *_NOTES),
    "event_rsvp_counts": with_roles("SELECT event_id, count(DISTINCT user_id) FILTER (WHERE status = 'going') AS going, count(DISTINCT user_id) FILTER (WHERE status = 'maybe') AS maybe FROM rsvp GROUP BY event_id", "rsvp"),
    "calendar_or_in": with_roles(
        "SELECT note_id, shop_id, created_at FROM note WHERE shop_id IN (SELECT shop_id FROM follow WHERE user_id = 8) OR note_id IN (SELECT event_id FROM rsvp WHERE user_id = 8)", "note", "follow", "rsvp"
    ),
    "community_posts": with_roles(
        """WITH l AS (SELECT post_id, count(DISTINCT user_id) AS likes, max(CASE WHEN user_id = 8 THEN 1 ELSE 0 END) AS my_like FROM post_like GROUP BY 1), r AS (SELECT post_id, count(*) AS replies FROM reply GROUP BY 1)
        SELECT post_id, shop_id, author, pinned, coalesce(likes, 0) AS likes, coalesce(my_like, 0) AS my_like, coalesce(replies, 0) AS replies FROM post LEFT JOIN l USING (post_id) LEFT JOIN r USING (post_id)""", "post", "post_like", "reply"
    ),
    "followed_shops": with_roles(
        f"""WITH mine AS (SELECT shop_id FROM follow WHERE user_id = 8), f AS (SELECT shop_id, count(*) AS followers FROM follow GROUP BY 1), u AS (SELECT shop_id, count(*) AS unread FROM note WHERE note_id NOT IN ({_READ}) GROUP BY 1)
        SELECT shop_id, name, coalesce(followers, 0) AS followers, coalesce(unread, 0) AS unread FROM mine JOIN shop USING (shop_id) LEFT JOIN f USING (shop_id) LEFT JOIN u USING (shop_id)""", "follow", "shop", "note", "note_read"
    ),
    "collection_totals": with_roles(
        """SELECT user_id, count(*) FILTER (WHERE status = 'owned') AS owned, count(*) FILTER (WHERE status = 'used') AS used, count(*) FILTER (WHERE status = 'wished') AS wished,
        CAST(sum(CASE WHEN status = 'owned' THEN quantity ELSE 0 END) AS BIGINT) AS units, CAST(coalesce(sum(CASE WHEN status = 'owned' AND price > 0 THEN CAST(floor(price * 100 + 0.5) AS BIGINT) * quantity END), 0) AS BIGINT) AS value_cents FROM item GROUP BY user_id""", "item"
    ),
    "wish_list_priority": with_roles(
        "SELECT item_id, user_id, priority, CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 END AS place, created_at FROM item WHERE status = 'wished' ORDER BY place NULLS LAST, created_at DESC, item_id LIMIT 200", "item"
    ),
    "wish_list_fanout_count": with_roles(
        """SELECT p.product_id, count(DISTINCT r.review_id * 100000 + r.shop_id) AS review_count, count(r.review_id) AS fanout_count
        FROM product p LEFT JOIN (SELECT *, row_number() OVER () FROM review) r USING (product_id) LEFT JOIN (SELECT product_id FROM stock WHERE in_stock) s USING (product_id) GROUP BY p.product_id""", "product", "review", "stock"
    ),
    "user_public_profile": with_roles(
        """WITH i AS (SELECT user_id, count(*) AS items, CAST(sum(quantity) AS BIGINT) AS units FROM item GROUP BY 1), f AS (SELECT user_id, count(*) AS follows FROM follow GROUP BY 1)
        SELECT user_id, name, coalesce(items, 0) AS items, coalesce(units, 0) AS units, coalesce(follows, 0) AS follows FROM account LEFT JOIN i USING (user_id) LEFT JOIN f USING (user_id)""", "account", "item", "follow"
    ),
    "activity_feed": with_roles("SELECT item_id, user_id, name, created_at FROM item JOIN account USING (user_id) WHERE status = 'used' AND user_id <> 8 ORDER BY created_at DESC, item_id LIMIT 20", "item", "account"),
    "achievements": with_roles(
        """WITH k AS (SELECT item.*, brand, country FROM item LEFT JOIN product USING (product_id)),
        o AS (SELECT user_id, count(*) FILTER (WHERE status = 'used') AS used, CAST(sum(CASE WHEN status = 'owned' THEN quantity ELSE 0 END) AS BIGINT) AS owned, count(*) FILTER (WHERE status = 'wished') AS wished,
          CAST(count(DISTINCT country) FILTER (WHERE status = 'used') AS INT) AS n_countries, CAST(count(DISTINCT country) FILTER (WHERE status IN ('used', 'owned')) AS INT) AS n_all_countries, CAST(count(DISTINCT brand) AS INT) AS n_brands,
          bool_or(status = 'used' AND country = 'NATION_0') AS h0, bool_or(status = 'used' AND country = 'NATION_1') AS h1, bool_or(brand = 'Brand#5') AS b5 FROM k GROUP BY 1),
        r AS (SELECT o_custkey AS user_id, count(*) AS reviews, max(rating) AS best FROM review JOIN orders ON o_orderkey = order_id GROUP BY 1), f AS (SELECT user_id, count(DISTINCT shop_id) AS shops FROM follow GROUP BY 1),
        j AS (SELECT a.user_id, coalesce(used, 0) AS used, coalesce(reviews, 0) AS reviews, coalesce(owned, 0) AS owned, coalesce(n_countries, 0) AS n_countries, coalesce(n_all_countries, 0) AS n_all_countries, coalesce(n_brands, 0) AS n_brands,
          coalesce(best, 0) AS best, coalesce(wished, 0) AS wished, coalesce(shops, 0) AS shops, coalesce(h0, FALSE) AS h0, coalesce(h1, FALSE) AS h1, coalesce(b5, FALSE) AS b5
          FROM account a LEFT JOIN o USING (user_id) LEFT JOIN r USING (user_id) LEFT JOIN f USING (user_id)),
        b AS (SELECT *, CAST(used >= 1 AS INT) + CAST(used >= 5 AS INT) + CAST(used >= 10 AS INT) + CAST(used >= 25 AS INT) + CAST(reviews >= 1 AS INT) + CAST(reviews >= 5 AS INT) + CAST(owned >= 10 AS INT)
          + CAST(n_countries >= 3 AS INT) + CAST(n_countries >= 5 AS INT) + CAST(h0 AS INT) + CAST(h1 AS INT) + CAST(b5 AS INT) + CAST(best >= 95 AS INT) + CAST(wished >= 5 AS INT) + CAST(shops >= 3 AS INT) AS badges FROM j)
        SELECT * EXCLUDE (h0, h1, b5), CASE WHEN badges >= 12 THEN 'Master' WHEN badges >= 8 THEN 'Aficionado' WHEN badges >= 4 THEN 'Enthusiast' WHEN badges >= 1 THEN 'Beginner' ELSE 'New' END AS level FROM b""",
        "item", "product", "review", "follow", "account"
    ),
    "recently_viewed_top8": with_roles(
        """WITH v AS (SELECT user_id, shop_id, max(struct_pack(a := viewed_at, b := view_id)) AS v FROM shop_view GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY v DESC) AS INT) AS place FROM v)
        SELECT user_id, shop_id, place FROM r WHERE place <= 8""", "shop_view"
    ),
    "month_grid": with_roles(
        """WITH f AS (SELECT CAST(date_trunc('month', max(created_at)) AS DATE) AS first FROM item), c AS (SELECT CAST(k AS INT) AS cell, CAST(first - CAST(isodow(first) - 1 AS INT) + CAST(k AS INT) AS DATE) AS day FROM f, range(35) t(k)),
        n AS (SELECT CAST(created_at AS DATE) AS day, count(*) AS n FROM item GROUP BY 1) SELECT cell, day, coalesce(n, 0) AS n FROM c LEFT JOIN n USING (day)""", "item"
    ),
    "time_ago_bucket": with_roles(
        f"""WITH s AS (SELECT CAST(floor(epoch(TIMESTAMP '{AS_OF}' - created_at)) AS BIGINT) AS s FROM note)
        SELECT CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age, count(*) AS n FROM s GROUP BY 1""", "note"
    ),
}
