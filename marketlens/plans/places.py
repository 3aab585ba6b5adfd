"""Where users live and which shops are near: radius and nearest over all users and shops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import EARTH_MILES, located, tenth
from ..operators.places import nearest, within_radius
from ..roles import role, with_roles

_LAT = "CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST(25 AS DOUBLE) + CAST(user_id * 29 % 2400 AS DOUBLE) / CAST(100 AS DOUBLE) END"
_LNG = "CASE WHEN user_id % 10 = 0 THEN NULL ELSE CAST(-120 AS DOUBLE) + CAST(user_id * 71 % 5000 AS DOUBLE) / CAST(100 AS DOUBLE) END"
#: Miles of the search around a home, and how many nearest shops are shown.
RADIUS, NEAREST = 60.0, 3


def homes(s, d) -> DataFrame:
    return role(s, d, "account").selectExpr("user_id AS place_id", f"{_LAT} AS lat", f"{_LNG} AS lng")


def shops(s, d) -> DataFrame:
    """Shops with coordinates; 0 counts as none."""
    return role(s, d, "shop").filter(located(F.col("lat"), F.col("lng"))).select("shop_id", "lat", "lng")


QUERIES = {
    "homes_within_radius": lambda s, d: within_radius(homes(s, d), shops(s, d), RADIUS).select(F.col("place_id").alias("user_id"), "shop_id", tenth(F.col("miles")).alias("miles")),
    "nearest_shops": lambda s, d: nearest(homes(s, d), shops(s, d), NEAREST).select(F.col("place_id").alias("user_id"), "rank", "shop_id", tenth(F.col("miles")).alias("miles")),
}

_PAIRS = f"""u AS (SELECT user_id, {_LAT} AS ulat, {_LNG} AS ulng FROM account),
 h AS (SELECT user_id, shop_id, radians(lat - ulat) / 2 AS a, radians(lng - ulng) / 2 AS o, cos(radians(ulat)) * cos(radians(lat)) AS c FROM u, shop WHERE ulat IS NOT NULL AND lat <> 0 AND lng <> 0),
 x AS (SELECT user_id, shop_id, sin(a) * sin(a) + c * sin(o) * sin(o) AS v FROM h),
 m AS (SELECT user_id, shop_id, {EARTH_MILES}::DOUBLE * 2 * atan2(sqrt(v), sqrt(1 - v)) AS miles FROM x)"""

SQL = {
    "homes_within_radius": with_roles(f"WITH {_PAIRS} SELECT user_id, shop_id, floor(miles * 10 + 0.5) / 10 AS miles FROM m WHERE miles <= {RADIUS}::DOUBLE", "account", "shop"),
    "nearest_shops": with_roles(
        f"WITH {_PAIRS} SELECT user_id, CAST(rank AS INT) AS rank, shop_id, floor(miles * 10 + 0.5) / 10 AS miles FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY miles, shop_id) AS rank FROM m) WHERE rank <= {NEAREST}", "account", "shop"
    ),
}
