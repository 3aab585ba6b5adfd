"""The marketplace's roles as views of the given tables, each with the same view as SQL.

The given tables are orders and parts, so a product is a part, a shop a supplier, a stock row
an open order line, a review a filled one, and a user a customer. What they lack (hours,
coordinates, strengths, nulls) follows from the keys by arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time by which everything is judged; a Wednesday.
AS_OF = "2024-01-31 15:00:00"
STRENGTHS = ("mild", "mild-medium", "medium", "medium-full", "full")
TYPES = ("announcement", "deal", "new_arrival", "event", "community")

_SELECTS: dict[str, tuple[str, str]] = {
    # name: (tables joined, columns); the columns are written so that Spark and ANSI SQL read them alike
    "product": (
        "part",
        "p_partkey AS product_id, p_brand AS brand, p_name AS name, p_type AS kind, "
        "CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'mild' WHEN p_size % 5 = 1 THEN 'mild-medium' WHEN p_size % 5 = 2 THEN 'medium' WHEN p_size % 5 = 3 THEN 'medium-full' ELSE 'full' END AS strength, "
        "p_retailprice AS list_price, 'NATION_' || CAST(p_size % 7 AS STRING) AS country, split_part(p_name, ' ', 1) AS wrapper, DATE '2020-01-01' + CAST(p_partkey * 7 % 1000 AS INT) AS created_at, '[\"' || replace(p_name, ' ', '\",\"') || '\"]' AS notes",
    ),
    "shop": (
        "supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
        "s_suppkey AS shop_id, s_name AS name, n_name AS city, r_name AS state, "
        "CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 10 = 5 THEN CAST(0 AS DOUBLE) ELSE CAST(25 AS DOUBLE) + CAST(s_suppkey * 37 % 2400 AS DOUBLE) / CAST(100 AS DOUBLE) END AS lat, "
        "CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 10 = 5 THEN CAST(0 AS DOUBLE) ELSE CAST(-120 AS DOUBLE) + CAST(s_suppkey * 53 % 5000 AS DOUBLE) / CAST(100 AS DOUBLE) END AS lng, "
        "CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 7 = 1 THEN '{\"Wed\":\"10am-8pm\"}' WHEN s_suppkey % 7 = 2 THEN '{\"Wed\":\"12pm-12am\"}' WHEN s_suppkey % 7 = 3 THEN '{\"Wed\":\"Closed\"}' "
        "WHEN s_suppkey % 7 = 4 THEN '{\"Wed\":\"9:30am-3:30pm\",\"Thu\":\"9am-5pm\"}' WHEN s_suppkey % 7 = 5 THEN '{\"Fri\":\"8am-1pm\"}' ELSE 'not json' END AS hours, "
        "s_acctbal > 0 AS verified, s_suppkey % 3 = 0 AS has_lounge, s_suppkey % 4 = 0 AS walk_in, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'A shop with stock from ' || n_name || ' and more of ' || r_name END AS description",
    ),
    "stock": (
        "lineitem",
        "l_orderkey * 8 + l_linenumber AS stock_id, l_suppkey AS shop_id, l_partkey AS product_id, nullif(l_linenumber, 7) AS size_id, "
        "CAST(floor(l_extendedprice / l_quantity * CAST(100 AS DOUBLE)) AS DOUBLE) / CAST(100 AS DOUBLE) AS price, "
        "CASE WHEN l_quantity = 1 THEN NULL ELSE CAST(l_quantity AS INT) - 2 END AS quantity, "
        "l_returnflag = 'N' AND l_quantity > 40 AS in_stock, l_linenumber = 1 AS featured, l_linenumber % 3 = 0 AS is_new, l_shipdate AS updated_at",
    ),
    "review": (
        "lineitem",
        "l_orderkey * 8 + l_linenumber AS review_id, l_orderkey AS order_id, l_suppkey AS shop_id, l_partkey AS product_id, 50 + CAST(l_quantity AS INT) AS rating, "
        "CAST(floor(l_discount * CAST(1000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INT) AS draw_rating, nullif(CAST(floor(l_tax * CAST(1000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS INT), 0) AS burn_rating, l_shipdate AS created_at",
    ),
    "account": ("customer", "c_custkey AS user_id, c_name AS name, c_mktsegment AS segment, c_acctbal AS balance"),
    "item": (
        "orders",
        "o_orderkey AS item_id, o_custkey AS user_id, o_orderkey % 1000 AS product_id, CASE WHEN o_orderstatus = 'O' THEN 'owned' WHEN o_orderstatus = 'F' THEN 'used' ELSE 'wished' END AS status, "
        "CAST(o_orderkey % 4 + 1 AS INT) AS quantity, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS price, "
        "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' WHEN o_orderpriority = '5-LOW' THEN 'low' END AS priority, o_orderdate AS created_at",
    ),
    "deal": (
        "orders",
        "o_orderkey AS deal_id, o_custkey % 100 AS shop_id, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey % 2000 END AS product_id, CAST(o_orderkey % 50 AS INT) AS discount, "
        "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate END AS expires_at, o_orderdate AS created_at",
    ),
    "shop_view": ("events", "event_id AS view_id, user_id % 100 AS shop_id, user_id, ts AS viewed_at"),
    "note": (
        "events",
        "event_id AS note_id, user_id % 100 AS shop_id, CASE event_type WHEN 'view' THEN 'announcement' WHEN 'click' THEN 'deal' WHEN 'purchase' THEN 'new_arrival' WHEN 'signup' THEN 'event' ELSE 'community' END AS type, "
        "CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS created_by, ts AS created_at",
    ),
    "note_read": ("events", "event_id - 1 AS note_id, user_id"),
    "post": ("conversations", "conv_id AS post_id, conv_id % 10 AS shop_id, role AS author, text AS content, conv_id % 7 = 0 AS pinned"),
    "reply": ("conversations", "conv_id AS post_id, turn AS reply_id, role AS author, text AS content"),
    "post_like": ("events", "DISTINCT event_id % 120 AS post_id, user_id"),
    "rsvp": ("events", "event_id % 50 AS event_id, user_id, CASE WHEN value > 20 THEN 'going' ELSE 'maybe' END AS status"),
    "follow": (
        "orders JOIN lineitem ON o_orderkey = l_orderkey",
        "DISTINCT o_custkey AS user_id, l_suppkey AS shop_id",
    ),
}
_WHERE = {
    "stock": "l_linestatus = 'O'", "review": "l_linestatus = 'F'", "shop_view": "event_type = 'view'", "note_read": "event_id % 3 = 0",
    "post": "turn = 0", "reply": "turn > 0", "post_like": "event_type = 'click'", "rsvp": "event_type = 'signup'",
}
_TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A role as a lazy DataFrame; columns and filters reach the Parquet scan."""
    source, columns = _SELECTS[name]
    frames = [w for w in source.replace("=", " ").split() if w in _TABLES]
    df = spark.read.parquet(f"{sf_dir}/{frames[0]}.parquet")
    if name == "shop":
        nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
        df = df.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    if name == "follow":
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey")
        df = df.select("o_orderkey", "o_custkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    if name in _WHERE:
        df = df.filter(_WHERE[name])
    distinct = columns.startswith("DISTINCT ")
    out = df.selectExpr(*_split(columns.removeprefix("DISTINCT ")))
    if name == "follow":  # few bytes but many rows: a number of partitions that isn't coalesced
        out = out.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "user_id", "shop_id")
    return out.distinct() if distinct else out


def _split(columns: str) -> list[str]:
    """Expressions parted at commas outside brackets and quotes."""
    out, depth, quoted, now = [], 0, False, ""
    for c in columns:
        quoted ^= c == "'"
        depth += 0 if quoted else (c in "([") - (c in ")]")
        if c == "," and not depth and not quoted:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()]


def with_roles(body: str, *names: str) -> str:
    """SQL text: the roles as common table expressions before the body, which may go on with more of them."""
    parts = []
    for name in names:
        source, columns = _SELECTS[name]
        where = f" WHERE {_WHERE[name]}" if name in _WHERE else ""
        parts.append(f"{name} AS (SELECT {columns} FROM {source}{where})")
    body = body.strip()
    return "WITH " + ",\n".join(parts) + (",\n" + body[5:] if body.startswith("WITH ") else "\n" + body)


Query = Callable[[SparkSession, str], DataFrame]
