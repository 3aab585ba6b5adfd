"""Writes over the whole marketplace: inserts, updates, deletes, cascades and toggles, each as the table after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.match import fuzzy_best, second_stage
from ..operators.writes import check_then_write, delete_cascade, delete_rows, insert_rows, three_way, toggle_flag, update_rows, with_followups
from ..roles import role, with_roles
from ..sources.writers import fill_emails
from .files import upload

#: Fixed names for the sizes of stock rows.
SIZES = ("short", "long", "slim", "wide", "grand", "petite")


def _priced(s, d) -> DataFrame:
    return role(s, d, "item").select("item_id", "user_id", "product_id", "status", "price")


def _sizes(s, d) -> DataFrame:
    """The sizes in which each product is in stock."""
    names = F.array(*[F.lit(n) for n in SIZES])
    rows = role(s, d, "stock").filter("in_stock AND size_id IS NOT NULL").select("product_id", "size_id").distinct()
    return rows.withColumn("size_name", F.get(names, F.col("size_id") - 1))


def _upload_sizes(s, d) -> DataFrame:
    """The fuzzy upload's rows with a size each, misspelt or missing."""
    rows = upload(s, d)
    best = fuzzy_best(rows, role(s, d, "product"), 0.35)
    size = F.expr("CASE row % 4 WHEN 0 THEN 'shrt' WHEN 1 THEN 'Grand!' WHEN 2 THEN 'wid' ELSE '' END")
    return best.select("row", "product_id", size.alias("size"))


def _cascade(s, d) -> dict[str, DataFrame]:
    """Posts of shop 3 go, and their replies and likes with them."""
    tables = {"post": role(s, d, "post").select("post_id", "shop_id"), "reply": role(s, d, "reply").select("post_id", "reply_id"), "post_like": role(s, d, "post_like").select("post_id", "user_id")}
    gone = tables["post"].filter("shop_id = 3")
    return delete_cascade(tables, [("post", "post_id", "reply", "post_id"), ("post", "post_id", "post_like", "post_id")], "post", "post_id", gone)


def _cascade_counts(s, d) -> DataFrame:
    out: DataFrame | None = None
    for name, df in sorted(_cascade(s, d).items()):
        n = df.groupBy("post_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("tab"), "post_id", "n")
        out = n if out is None else out.unionByName(n)
    assert out is not None
    return out


def _used_up(s, d) -> dict[str, DataFrame]:
    """Items that come in as used end the user's wishes for the same product, and each deal tells its shop's followers."""
    items = role(s, d, "item").select("item_id", "user_id", "product_id", "status")
    return with_followups(items.filter("status = 'wished'"), items.filter("status = 'used'"), ["user_id", "product_id"], role(s, d, "deal"), role(s, d, "shop"))


QUERIES = {
    "insert_rows_numbered": lambda s, d: insert_rows(
        role(s, d, "shop").select("shop_id", "name"), role(s, d, "account").filter("segment = 'BUILDING'").select(F.col("name")), "shop_id", ["name"]
    ),
    "update_rows_by_key": lambda s, d: update_rows(
        _priced(s, d), _priced(s, d).filter("item_id % 3 <> 0").select("item_id", F.expr("price * 2").alias("price"), F.lit("owned").alias("status")), ["item_id"], ["status", "price"]
    ).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), F.sum(F.expr("CAST(floor(price * 100 + 0.5) AS BIGINT)")).alias("cents")),
    "delete_rows_by_key": lambda s, d: delete_rows(role(s, d, "follow"), role(s, d, "shop").filter("NOT verified"), ["shop_id"]).groupBy("shop_id").agg(F.count(F.lit(1)).alias("n")),
    "delete_cascade": _cascade_counts,
    "toggle_pinned": lambda s, d: toggle_flag(role(s, d, "post").select("post_id", F.col("pinned").cast("int").alias("pinned")), F.expr("post_id % 3 = 0"), "pinned"),
    "three_way_ratings": lambda s, d: three_way(
        role(s, d, "follow").select("user_id", "shop_id", F.expr("CAST(shop_id % 5 + 1 AS INT)").alias("rating")),
        role(s, d, "follow").filter("(user_id + shop_id) % 2 = 0").select("user_id", "shop_id", F.expr("CAST(CASE WHEN user_id % 3 = 0 THEN NULL ELSE 5 END AS INT)").alias("rating")), ["user_id", "shop_id"], "rating",
    ).groupBy("shop_id", "rating").agg(F.count(F.lit(1)).alias("n")),
    "check_then_write": lambda s, d: check_then_write(
        role(s, d, "stock").filter("in_stock").groupBy("shop_id", "size_id").agg(F.max("price").alias("price")),
        role(s, d, "stock").select("shop_id", "size_id", F.expr("price + 1").alias("price"), (F.col("stock_id") * 100_000 + F.col("product_id")).alias("position")), ["shop_id", "size_id"], ["price"], "position",
    )[1],
    "cascade_wishes": lambda s, d: _used_up(s, d)["wishes"],
    "cascade_notes": lambda s, d: _used_up(s, d)["notes"],
    "emails_merged_back": lambda s, d: fill_emails(
        role(s, d, "account").selectExpr("user_id", "name", "segment AS city", "CASE WHEN user_id % 3 = 0 THEN 'own@example.com' WHEN user_id % 3 = 1 THEN '' END AS email"),
        role(s, d, "account").filter("user_id % 2 = 0").selectExpr("name", "segment AS city", "'found@example.com' AS email"),
    ).select("user_id", "email"),
    "fuzzy_match_size": lambda s, d: second_stage(_upload_sizes(s, d), _sizes(s, d)).select("row", "product_id", "size_id", "size_name", "size_confidence"),
}

_FUZZY = """WITH u AS (SELECT name AS full_name, min(product_id) AS row FROM product GROUP BY name),
 up AS (SELECT row, (SELECT string_agg(CASE WHEN i > a AND list_contains(['a','e','i','o','u'], c) THEN '' ELSE c END, '' ORDER BY i) FROM (SELECT unnest(string_split(full_name, '')) AS c, unnest(range(1, length(full_name) + 1)) AS i, length(full_name) - strpos(reverse(full_name), ' ') + 1 AS a)) AS name FROM u),
 k AS (SELECT trim(regexp_replace(lower(name), '[^a-z0-9 ]', '', 'g')) AS known, min(product_id) AS product_id FROM product GROUP BY 1),
 s AS (SELECT up.row, k.product_id, 1.0::DOUBLE - levenshtein(known, up.name) / greatest(length(known), length(up.name))::DOUBLE AS score FROM up, k),
 b AS (SELECT row, product_id FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, product_id) AS z FROM s WHERE score >= 0.35) WHERE z = 1),
 m AS (SELECT up.row, b.product_id, CASE up.row % 4 WHEN 0 THEN 'shrt' WHEN 1 THEN 'grand' WHEN 2 THEN 'wid' ELSE '' END AS size FROM up LEFT JOIN b USING (row)),
 z AS (SELECT DISTINCT product_id, size_id, ['short', 'long', 'slim', 'wide', 'grand', 'petite'][size_id] AS size_name FROM stock WHERE in_stock AND size_id IS NOT NULL),
 x AS (SELECT row, size_id, size_name, 1.0::DOUBLE - levenshtein(size, size_name) / greatest(length(size), length(size_name))::DOUBLE AS score FROM m JOIN z USING (product_id) WHERE size <> ''),
 y AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, size_id) AS z FROM x WHERE score > 0) WHERE z = 1)
SELECT row, product_id, size_id, size_name, CAST(floor(score * 100 + 0.5) AS BIGINT) AS size_confidence FROM m LEFT JOIN y USING (row)"""

SQL = {
    "insert_rows_numbered": with_roles(
        "SELECT shop_id, name FROM shop UNION ALL SELECT (SELECT max(shop_id) FROM shop) + row_number() OVER (ORDER BY name), name FROM account WHERE segment = 'BUILDING'", "shop", "account"
    ),
    "update_rows_by_key": with_roles(
        """WITH u AS (SELECT CASE WHEN item_id % 3 <> 0 THEN 'owned' ELSE status END AS status, CASE WHEN item_id % 3 <> 0 THEN price * 2 ELSE price END AS price FROM item)
        SELECT status, count(*) AS n, count(price) AS priced, CAST(sum(CAST(floor(price * 100 + 0.5) AS BIGINT)) AS BIGINT) AS cents FROM u GROUP BY status""", "item"
    ),
    "delete_rows_by_key": with_roles("SELECT shop_id, count(*) AS n FROM follow WHERE shop_id NOT IN (SELECT shop_id FROM shop WHERE NOT verified) GROUP BY 1", "follow", "shop"),
    "delete_cascade": with_roles(
        """WITH dead AS (SELECT post_id FROM post WHERE shop_id = 3) SELECT 'post' AS tab, post_id, count(*) AS n FROM post WHERE shop_id <> 3 GROUP BY ALL UNION ALL
        SELECT 'reply', post_id, count(*) FROM reply WHERE post_id NOT IN (SELECT post_id FROM dead) GROUP BY ALL UNION ALL SELECT 'post_like', post_id, count(*) FROM post_like WHERE post_id NOT IN (SELECT post_id FROM dead) GROUP BY ALL""", "post", "reply", "post_like"
    ),
    "toggle_pinned": with_roles("SELECT post_id, CASE WHEN post_id % 3 = 0 THEN CASE WHEN pinned THEN 0 ELSE 1 END ELSE CAST(pinned AS INT) END AS pinned FROM post", "post"),
    "three_way_ratings": with_roles(
        """SELECT shop_id, CAST(CASE WHEN (user_id + shop_id) % 2 = 0 THEN 5 ELSE shop_id % 5 + 1 END AS INT) AS rating, count(*) AS n FROM follow WHERE NOT ((user_id + shop_id) % 2 = 0 AND user_id % 3 = 0) GROUP BY ALL""", "follow"
    ),
    "check_then_write": with_roles(
        """WITH t AS (SELECT DISTINCT shop_id, size_id FROM stock WHERE in_stock), r AS (SELECT shop_id, size_id, count(*) AS n FROM stock WHERE size_id IS NOT NULL GROUP BY 1, 2),
        a AS (SELECT r.*, t.shop_id IS NULL AS new FROM r LEFT JOIN t ON t.shop_id = r.shop_id AND t.size_id = r.size_id)
        SELECT count(*) FILTER (WHERE new) AS added, CAST(sum(n) - count(*) FILTER (WHERE new) AS BIGINT) AS updated, (SELECT count(*) FROM stock WHERE size_id IS NULL) AS skipped FROM a""", "stock"
    ),
    "cascade_wishes": with_roles("SELECT item_id, user_id, product_id, status FROM item w WHERE status = 'wished' AND NOT EXISTS (SELECT 1 FROM item u WHERE u.status = 'used' AND u.user_id = w.user_id AND u.product_id = w.product_id)", "item"),
    "cascade_notes": with_roles("SELECT deal_id, shop_id, 'deal' AS type, 'New deal at ' || name AS title, discount || '% off' || CASE WHEN product_id IS NULL THEN '' ELSE ' — product ' || product_id END AS message FROM deal JOIN shop USING (shop_id)", "deal", "shop"),
    "emails_merged_back": with_roles("SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'own@example.com' WHEN user_id % 2 = 0 THEN 'found@example.com' END AS email FROM account", "account"),
    "fuzzy_match_size": with_roles(_FUZZY, "product", "stock"),
}
