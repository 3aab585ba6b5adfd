"""Imports, merges and listings: fuzzy and exact matching, upserts, deduplication, profiles, contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import parse_count, parse_price, percent
from ..functions.text import compact, emails, first_phone, host, json_map, valid_emails
from ..operators.match import exact_lookup, fuzzy_best
from ..operators.relational import first_wins
from ..operators.writes import import_rows, insert_unless_duplicate, keep_existing, keep_latest, promote_next, set_only, toggle
from ..roles import role, with_roles

DENIED = ("mail1.example.com", "sentry.io")


def upload(s, d) -> DataFrame:
    """An upload of misspelt names, as a form would send it: 64 distinct names without their vowels' first."""
    names = role(s, d, "product").groupBy("name").agg(F.min("product_id").alias("row"))
    return names.select(F.col("row"), F.regexp_replace("name", "[aeiou](?=[a-z]*$)", "").alias("name"))


def listings(s, d) -> DataFrame:
    """Two sources of listings one after another: short documents, then all of them, with a stable order."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    one = docs.filter("n_chars < 500").select(F.lit(0).alias("source_rank"), "doc_id", "lang", F.col("text").alias("name"))
    two = docs.select(F.lit(1).alias("source_rank"), "doc_id", "lang", F.col("text").alias("name"))
    return one.unionByName(two)


def merge_listings(rows: DataFrame, key=None) -> DataFrame:
    """First-wins deduplication in source order; keys of under three letters or digits are dropped.

    Keys may be whole texts, so their 256-bit hashes are shuffled instead, without the names.
    """
    k = compact(F.col("name")) if key is None else key
    hashed = rows.filter(F.length(k) >= 3).withColumn("_hash", F.sha2(k, 256)).drop("name")
    return first_wins(hashed, F.col("_hash"), "source_rank", "doc_id").drop("_hash")


def profile(rows: DataFrame) -> DataFrame:
    """Counts and percentages of filled fields by group, a blank group as 'Unknown', in one pass."""
    n = F.count(F.lit(1))
    has = {c: F.count_if(F.col(c).isNotNull()) for c in ("email", "phone")}
    return rows.groupBy(F.coalesce(F.nullif(F.col("grp"), F.lit("")), F.lit("Unknown")).alias("grp")).agg(
        n.alias("n"), *[x.alias(f"n_{c}") for c, x in has.items()], *[percent(x, n).alias(f"pct_{c}") for c, x in has.items()]
    )


def contacts(docs: DataFrame) -> DataFrame:
    found = valid_emails(emails(F.col("text")), DENIED)
    return docs.select("doc_id", F.col("lang").alias("grp"), F.get(found, F.lit(0)).alias("email"), F.size(found).alias("n_emails"), first_phone(F.col("text")).alias("phone"))


def deal(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """A table and an upload of all rows: by their key a third is only in the table, a third in both, a third only in the upload."""
    return rows.filter(f"({key}) % 3 <> 2"), rows.filter(f"({key}) % 3 <> 0")


def _ratings(s, d):
    """Orders as ratings: one of each (user, product) as the table, and an upload."""
    table, rows = deal(role(s, d, "item").select("user_id", "product_id", F.col("quantity").alias("rating"), "item_id"), "item_id")
    return table.groupBy("user_id", "product_id").agg(F.max("rating").alias("rating")), rows


def _edges(s, d):
    return deal(role(s, d, "follow"), "user_id + shop_id")


def _import(s, d):
    """A re-import over all shops, of known rows and new ones, some without a quantity: the table after it and the counters."""
    known, sent = deal(role(s, d, "stock"), "shop_id + product_id")
    table = known.groupBy("shop_id", "product_id", "size_id").agg(F.max("price").alias("price"))
    rows = sent.select("shop_id", "product_id", "size_id", F.expr("nullif(price, 0) + 1").alias("price"), (F.col("stock_id") * 100_000 + F.col("product_id")).alias("position"), "quantity")
    return import_rows(table, rows, ["shop_id", "product_id", "size_id"], ["price"], "position", F.col("quantity").isNotNull())


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


QUERIES = {
    "fuzzy_match_best": lambda s, d: fuzzy_best(upload(s, d), role(s, d, "product"), 0.35),
    "normalized_key_match": lambda s, d: exact_lookup(
        role(s, d, "stock").join(role(s, d, "product").select("product_id", F.upper("name").alias("product")), "product_id")
        .select((F.col("stock_id") * 100_000 + F.col("product_id")).alias("row"), F.when(F.col("product_id") % 5 == 0, "no such thing").otherwise(F.concat(F.lit("  "), "product")).alias("product"),
                F.format_string("supplier#%09d ", "shop_id").alias("shop"), F.expr("CASE WHEN quantity > 10 THEN price END").alias("price")),
        role(s, d, "product"), role(s, d, "shop"),
    ).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count("product_id").alias("products"), F.sum("shop_id").alias("shops")),
    "upsert_keep_latest": lambda s, d: keep_latest(*_ratings(s, d), ["user_id", "product_id"], "item_id"),
    "upsert_do_nothing": lambda s, d: keep_existing(*_edges(s, d), ["user_id", "shop_id"]),
    "toggle_edges": lambda s, d: toggle(*_edges(s, d), ["user_id", "shop_id"]),
    "null_safe_upsert_counts": lambda s, d: _import(s, d)[1],
    "null_safe_upsert_rows": lambda s, d: _import(s, d)[0],
    "insert_unless_duplicate": lambda s, d: insert_unless_duplicate(
        role(s, d, "item").filter("item_id % 2 = 0"), role(s, d, "item").withColumn("created_at", F.expr("CASE WHEN item_id % 11 = 0 THEN NULL ELSE created_at END")), ["user_id", "created_at"], "created_at", "item_id"
    ).select("item_id", "user_id", "created_at"),
    "promote_next_default": lambda s, d: promote_next(
        role(s, d, "item").select("product_id", "item_id", "created_at", F.expr("CASE WHEN item_id % 40 = 0 THEN 1 ELSE 0 END").alias("is_default")), "product_id", "item_id", "is_default", "created_at"
    ).filter("is_default = 1").select("product_id", "item_id"),
    "set_default": lambda s, d: set_only(
        role(s, d, "item").select("product_id", "item_id", F.expr("CASE WHEN item_id % 40 = 0 THEN 1 ELSE 0 END").alias("is_default")), "product_id", "item_id",
        role(s, d, "item").groupBy("product_id").agg(F.max("item_id").alias("item_id")).filter("product_id % 2 = 0"), "is_default",
    ).filter("is_default = 1").select("product_id", "item_id"),
    "union_dedup_first_wins": lambda s, d: merge_listings(listings(s, d)).select("source_rank", "doc_id", "lang"),
    "listing_profile": lambda s, d: profile(contacts(_docs(s, d))),
    "email_phone_extract": lambda s, d: contacts(_docs(s, d)).select("doc_id", "email", "n_emails", "phone"),
    "url_host": lambda s, d: s.read.parquet(f"{d}/pages.parquet").groupBy(host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n")),
    "lenient_parse": lambda s, d: role(s, d, "stock").select(
        F.concat(F.lit("$"), F.format_string("%d.50 each", "product_id")).alias("p"), F.concat(F.col("shop_id").cast("string"), F.lit(" boxes")).alias("q")
    ).groupBy("p", "q").agg(F.count(F.lit(1)).alias("n")).select("n", parse_price(F.col("p")).alias("price"), parse_count(F.col("q"), 0).alias("quantity")),
    "json_prop_counts": lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy(F.try_element_at(json_map(F.col("props")), F.lit("k")).alias("k")).agg(F.count(F.lit(1)).alias("n")),
}

_PLAIN = "trim(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'))"
_EMAIL = "list_filter(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), lambda x: lower(x))), lambda e: length(e) BETWEEN 6 AND 100 AND NOT list_contains(['mail1.example.com', 'sentry.io'], string_split(e, '@')[-1]) AND NOT regexp_matches(e, '\\.(png|jpg|jpeg|gif|svg|webp)$'))"
_FIRST_EMAIL = _EMAIL.replace("list_distinct(", "(")
_DIGITS = "regexp_replace(regexp_extract(text, '(?:\\+?1[ .-]?)?\\(?[0-9]{3}\\)?[ .-]?[0-9]{3}[ .-][0-9]{4}', 0), '\\D', '', 'g')"
_CONTACTS = f"c AS (SELECT doc_id, lang AS grp, {_FIRST_EMAIL}[1] AS email, CAST(len({_EMAIL}) AS INT) AS n_emails, CASE WHEN length({_DIGITS}) = 10 THEN '+1' || {_DIGITS} WHEN length({_DIGITS}) = 11 AND starts_with({_DIGITS}, '1') THEN '+' || {_DIGITS} END AS phone FROM documents)"
_EDGES = "a AS (SELECT * FROM follow WHERE (user_id + shop_id) % 3 <> 2), b AS (SELECT * FROM follow WHERE (user_id + shop_id) % 3 <> 0)"
_UPSERT = """WITH t AS (SELECT shop_id, product_id, size_id, max(price) AS price FROM stock WHERE (shop_id + product_id) % 3 <> 2 GROUP BY 1, 2, 3),
r AS (SELECT shop_id, product_id, size_id, nullif(price, 0) + 1 AS price, stock_id * 100000 + product_id AS position FROM stock WHERE (shop_id + product_id) % 3 <> 0 AND quantity IS NOT NULL),
j AS (SELECT r.*, t.shop_id IS NOT NULL AS known, row_number() OVER (PARTITION BY r.shop_id, r.product_id, r.size_id ORDER BY position) AS k, row_number() OVER (PARTITION BY r.shop_id, r.product_id, r.size_id ORDER BY position DESC) AS z
  FROM r LEFT JOIN t ON r.shop_id = t.shop_id AND r.product_id = t.product_id AND r.size_id IS NOT DISTINCT FROM t.size_id)
"""

SQL = {
    "fuzzy_match_best": with_roles(
        f"""WITH u AS (SELECT name AS full_name, min(product_id) AS row FROM product GROUP BY name), w AS (SELECT row, regexp_replace(full_name, '[aeiou]([a-z]*)$', '\\1') AS n1, full_name FROM u),
        up AS (SELECT row, (SELECT string_agg(CASE WHEN i > strpos_last AND list_contains(['a','e','i','o','u'], c) THEN '' ELSE c END, '' ORDER BY i) FROM (SELECT unnest(string_split(full_name, '')) AS c, unnest(range(1, length(full_name) + 1)) AS i, length(full_name) - strpos(reverse(full_name), ' ') + 1 AS strpos_last)) AS name FROM w),
        k AS (SELECT {_PLAIN.format('name')} AS known, arg_min(name, product_id) AS match_name, min(product_id) AS product_id FROM product GROUP BY 1),
        s AS (SELECT up.row, k.product_id, k.match_name, 1.0::DOUBLE - levenshtein(known, {_PLAIN.format('up.name')}) / greatest(length(known), length({_PLAIN.format('up.name')}))::DOUBLE AS score FROM up, k),
        b AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, product_id) AS z FROM s WHERE score >= 0.35)
        SELECT up.row, up.name, product_id, match_name, CAST(floor(coalesce(score, 0) * 100 + 0.5) AS BIGINT) AS confidence FROM up LEFT JOIN (SELECT * FROM b WHERE z = 1) b USING (row)""", "product"
    ),
    "normalized_key_match": with_roles(
        """WITH x AS (SELECT product_id, shop_id, CASE WHEN quantity > 10 THEN price END AS price FROM stock), f AS (SELECT name, min(product_id) AS first FROM product GROUP BY 1),
        m AS (SELECT CASE WHEN x.product_id % 5 = 0 THEN NULL ELSE first END AS product_id, shop.shop_id, price FROM x JOIN product USING (product_id) JOIN f USING (name) LEFT JOIN shop USING (shop_id)),
        r AS (SELECT *, CASE WHEN product_id IS NULL THEN 'unknown product' WHEN shop_id IS NULL THEN 'unknown shop' WHEN price IS NULL THEN 'no price' ELSE 'matched' END AS reason FROM m)
        SELECT reason, count(*) AS n, count(product_id) AS products, CAST(sum(shop_id) AS BIGINT) AS shops FROM r GROUP BY 1""", "stock", "product", "shop"
    ),
    "upsert_keep_latest": with_roles(
        """WITH t AS (SELECT user_id, product_id, max(quantity) AS rating FROM item WHERE item_id % 3 <> 2 GROUP BY 1, 2), r AS (SELECT user_id, product_id, arg_max(quantity, item_id) AS rating FROM item WHERE item_id % 3 <> 0 GROUP BY 1, 2)
        SELECT user_id, product_id, coalesce(r.rating, t.rating) AS rating FROM t FULL JOIN r USING (user_id, product_id)""", "item"
    ),
    "upsert_do_nothing": with_roles(f"WITH {_EDGES} SELECT user_id, shop_id FROM a UNION SELECT user_id, shop_id FROM b", "follow"),
    "toggle_edges": with_roles(f"WITH {_EDGES} (SELECT user_id, shop_id FROM a EXCEPT SELECT user_id, shop_id FROM b) UNION ALL (SELECT user_id, shop_id FROM b EXCEPT SELECT user_id, shop_id FROM a)", "follow"),
    "null_safe_upsert_counts": with_roles(
        _UPSERT + "SELECT count(*) FILTER (WHERE NOT known AND k = 1) AS added, count(*) FILTER (WHERE known OR k > 1) AS updated, (SELECT count(*) FROM stock WHERE (shop_id + product_id) % 3 <> 0 AND quantity IS NULL) AS skipped FROM j", "stock"
    ),
    "null_safe_upsert_rows": with_roles(
        _UPSERT + """SELECT shop_id, product_id, size_id, price FROM j WHERE z = 1 UNION ALL
        SELECT shop_id, product_id, size_id, price FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.shop_id = t.shop_id AND r.product_id = t.product_id AND r.size_id IS NOT DISTINCT FROM t.size_id)""", "stock"
    ),
    "insert_unless_duplicate": with_roles(
        """WITH r AS (SELECT item_id, user_id, CASE WHEN item_id % 11 = 0 THEN NULL ELSE created_at END AS created_at FROM item), t AS (SELECT user_id, created_at FROM item WHERE item_id % 2 = 0),
        n AS (SELECT *, row_number() OVER (PARTITION BY user_id, created_at ORDER BY item_id) AS k FROM r WHERE created_at IS NOT NULL AND (user_id, created_at) NOT IN (SELECT user_id, created_at FROM t))
        SELECT item_id, user_id, created_at FROM n WHERE k = 1 UNION ALL SELECT item_id, user_id, created_at FROM r WHERE created_at IS NULL""", "item"
    ),
    "promote_next_default": with_roles(
        """WITH f AS (SELECT product_id, item_id, created_at, CASE WHEN item_id % 40 = 0 THEN 1 ELSE 0 END AS x FROM item), g AS (SELECT *, max(x) OVER (PARTITION BY product_id) AS has, row_number() OVER (PARTITION BY product_id ORDER BY created_at, item_id) AS k FROM f)
        SELECT product_id, item_id FROM g WHERE x = 1 OR (has = 0 AND k = 1)""", "item"
    ),
    "set_default": with_roles(
        """WITH f AS (SELECT product_id, item_id, CASE WHEN item_id % 40 = 0 THEN 1 ELSE 0 END AS x, max(item_id) OVER (PARTITION BY product_id) AS last FROM item)
        SELECT product_id, item_id FROM f WHERE CASE WHEN product_id % 2 = 0 THEN item_id = last ELSE x = 1 END""", "item"
    ),
    "union_dedup_first_wins": """WITH u AS (SELECT 0 AS source_rank, doc_id, lang, text AS name FROM documents WHERE n_chars < 500 UNION ALL SELECT 1, doc_id, lang, text FROM documents),
        k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS key FROM u), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_rank, doc_id) AS z FROM k WHERE length(key) >= 3)
        SELECT source_rank, doc_id, lang FROM r WHERE z = 1""",
    "listing_profile": f"""WITH {_CONTACTS} SELECT coalesce(nullif(grp, ''), 'Unknown') AS grp, count(*) AS n, count(email) AS n_email, count(phone) AS n_phone,
        CAST(floor(count(email) * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS pct_email, CAST(floor(count(phone) * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS pct_phone FROM c GROUP BY 1""",
    "email_phone_extract": f"WITH {_CONTACTS} SELECT doc_id, email, n_emails, phone FROM c",
    "url_host": "SELECT regexp_replace(nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), ''), '^www\\.', '') AS host, count(*) AS n FROM pages GROUP BY 1",
    "lenient_parse": with_roles("SELECT count(*) AS n, product_id + 0.5::DOUBLE AS price, CAST(shop_id AS INT) AS quantity FROM stock GROUP BY product_id, shop_id", "stock"),
    "json_prop_counts": "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1",
}
