"""Listings from several sources: deduplication by name and city, parsed places, profiles and contacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import percent
from ..functions.text import city_state, clean_phone, compact, locality, sheet_id
from ..operators.relational import asc, desc, first_wins, top
from ..roles import role, with_roles
from ..sources.readers import inline
from ..sources.variants import json_records

#: Where a scan looks, in order.
SCANNED = (("NATION_1", "ASIA"), ("NATION_3", "AFRICA"), ("NATION_7", ""), ("NATION_404", "EUROPE"))
#: The keys by which sources drop repeated listings: on name and city together or apart, on the name alone.
KEYS = ("joined", "apart", "name", "name_kept", "loose")


def dedup_key(kind: str) -> tuple[Column, Column]:
    """The key of a listing (name, city) and whether it is kept at all.

    joined: name and city in one, names of three or more characters. apart: each stripped, keys of three or more. name: the name alone, empty
    keys dropped; name_kept: one empty key stays. loose: name and city in one, whatever their length.
    """
    name, city = F.coalesce("name", F.lit("")), F.coalesce("city", F.lit(""))
    both = compact(F.concat(name, city))
    apart = F.concat(compact(name), compact(city))
    return {
        "joined": (both, F.length(name) >= 3), "apart": (apart, F.length(apart) >= 3), "name": (compact(name), compact(name) != ""), "name_kept": (compact(name), F.lit(True)), "loose": (both, F.lit(True)),
    }[kind]


def dedup(rows: DataFrame, kind: str) -> DataFrame:
    """(source_rank, position, name, city, ...) -> the first listing of each key in source order."""
    key, keep = dedup_key(kind)
    return first_wins(rows.filter(keep), key, "source_rank", "position")


def unlisted(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows whose exact name isn't among the known ones: a scan's fallback cards."""
    return rows.join(known.select("name").distinct(), "name", "left_anti").select(*rows.columns)


def sources(s, d) -> DataFrame:
    """Three sources of listings over all accounts, in order of precedence, with names that differ in case, blanks and punctuation."""
    base = role(s, d, "account").join(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_nationkey"), "user_id")
    city = F.expr("CASE WHEN user_id % 9 = 0 THEN NULL ELSE 'NATION_' || CAST(c_nationkey AS STRING) END")
    name = F.expr("CASE WHEN user_id % 50 = 1 THEN '' WHEN user_id % 50 = 2 THEN 'ab' WHEN user_id % 50 = 3 THEN NULL ELSE 'Shop ' || CAST(user_id % 400 AS STRING) || CASE WHEN user_id % 2 = 0 THEN ' & Co.' ELSE '-CO' END END")
    rows = base.select((F.col("user_id") % 3).cast("int").alias("source_rank"), F.col("user_id").alias("position"), name.alias("name"), city.alias("city"))
    return rows


_SOURCES = """sources AS (SELECT CAST(user_id % 3 AS INT) AS source_rank, user_id AS position, CASE WHEN user_id % 50 = 1 THEN '' WHEN user_id % 50 = 2 THEN 'ab' WHEN user_id % 50 = 3 THEN NULL
  ELSE 'Shop ' || CAST(user_id % 400 AS VARCHAR) || CASE WHEN user_id % 2 = 0 THEN ' & Co.' ELSE '-CO' END END AS name, CASE WHEN user_id % 9 = 0 THEN NULL ELSE 'NATION_' || CAST(c_nationkey AS VARCHAR) END AS city
  FROM account JOIN customer ON c_custkey = user_id)"""


def _dedup_sql(key: str, keep: str) -> str:
    strip = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
    k = {
        "both": strip.format("coalesce(name, '') || coalesce(city, '')"), "apart": strip.format("coalesce(name, '')") + " || " + strip.format("coalesce(city, '')"), "name": strip.format("coalesce(name, '')"),
    }[key]
    return with_roles(
        f"""WITH {_SOURCES}, k AS (SELECT *, {k} AS key FROM sources), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_rank, position) AS z FROM k WHERE {keep})
        SELECT source_rank, position, name, city FROM r WHERE z = 1""", "account"
    )


def report(rows: DataFrame) -> DataFrame:
    """Totals, filled fields with percentages and no contact at all, in one row: (email, phone, website) as text."""
    has = {c: F.coalesce(F.col(c), F.lit("")) != "" for c in ("email", "phone", "website")}
    n = F.count(F.lit(1))
    none = F.count_if(~has["email"] & ~has["phone"] & ~has["website"])
    return rows.agg(n.alias("total"), *[F.count_if(x).alias(f"with_{c}") for c, x in has.items()], none.alias("without_contact"), percent(F.count_if(has["email"]), n).alias("pct_email"))


def top_states(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k states with the most listings, blank ones left out, ties by name."""
    return top(rows.filter(F.coalesce("state", F.lit("")) != "").groupBy("state").agg(F.count(F.lit(1)).alias("n")), k, desc("n"), asc("state"))


def contacts(s, d) -> DataFrame:
    """Listings with contacts, some missing, and where a mailing stands."""
    rows = role(s, d, "account").join(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("user_id"), "c_nationkey"), "user_id")
    return rows.selectExpr(
        "user_id", "CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN '' ELSE 'u' || CAST(user_id AS STRING) || '@example.com' END AS email",
        "CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN '1-503-555-' || lpad(CAST(user_id % 10000 AS STRING), 4, '0') WHEN user_id % 5 = 2 THEN '(503) 555-' || lpad(CAST(user_id % 10000 AS STRING), 4, '0') ELSE '12 34' END AS phone",
        "CASE WHEN user_id % 4 = 0 THEN 'example.com/' || CAST(user_id AS STRING) ELSE '' END AS website", "CASE WHEN user_id % 7 = 0 THEN '' ELSE 'NATION_' || CAST(c_nationkey AS STRING) END AS state",
        "CASE WHEN user_id % 11 = 0 THEN 'emailed' ELSE '' END AS status",
    )


_CONTACTS = """contacts AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN '' ELSE 'u' || user_id || '@example.com' END AS email,
  CASE WHEN user_id % 5 = 0 THEN NULL WHEN user_id % 5 = 1 THEN '1-503-555-' || lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') WHEN user_id % 5 = 2 THEN '(503) 555-' || lpad(CAST(user_id % 10000 AS VARCHAR), 4, '0') ELSE '12 34' END AS phone,
  CASE WHEN user_id % 4 = 0 THEN 'example.com/' || user_id ELSE '' END AS website, CASE WHEN user_id % 7 = 0 THEN '' ELSE 'NATION_' || c_nationkey END AS state, CASE WHEN user_id % 11 = 0 THEN 'emailed' ELSE '' END AS status
  FROM account JOIN customer ON c_custkey = user_id)"""


def segments(rows: DataFrame) -> DataFrame:
    """Contacts by where a mailing stands: with an address and not started, or emailed; and the subset with a valid phone number."""
    mail = F.coalesce(F.col("email"), F.lit("")) != ""
    kind = F.when(mail & (F.col("status") == "emailed"), "emailed").when(mail, "not started").otherwise("no address")
    return rows.groupBy(kind.alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.count(clean_phone(F.col("phone"))).alias("callable"))


def master(rows: DataFrame) -> DataFrame:
    """All sources merged: deduplicated with name and city stripped apart, then by state whatever its case, and city."""
    return dedup(rows, "apart").orderBy(F.upper(F.coalesce("city", F.lit(""))), F.coalesce("name", F.lit("")), asc("source_rank"), asc("position"))


def _trees(s, d) -> DataFrame:
    """JSON of several shapes over all shops: businesses at the top, in lists, deeper than is looked, and malformed text."""
    one = "'{\"name\":\"' || name || '\",\"businessUrl\":\"/b/' || shop_id || '\",\"city\":\"' || city || '\"}'"
    nest = one
    for _ in range(9):
        nest = "'{\"a\":' || " + nest + " || '}'"
    text = f"CASE shop_id % 4 WHEN 0 THEN {one} WHEN 1 THEN '{{\"list\":[' || {one} || ',{{\"name\":\"x\",\"businessUrl\":\"/short\"}},3]}}' WHEN 2 THEN {nest} ELSE '{{oops' END"
    return role(s, d, "shop").selectExpr("shop_id AS id", f"{text} AS json")


def page_links(pages: DataFrame) -> DataFrame:
    """The links of each page as listings: (page_id, place, href, label), in order; a page's markup is read with patterns."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(0))
    each = pages.select("page_id", F.posexplode(found).alias("place", "a"))
    part = lambda k: F.regexp_extract("a", r'<a href="([^"]*)">([^<]*)</a>', k)
    return each.select("page_id", "place", part(1).alias("href"), F.trim(part(2)).alias("label"))


def enrich(rows: DataFrame, pages: DataFrame, paths: tuple[str, ...] = ("", "contact", "about")) -> DataFrame:
    """(user_id, website) with the first address found: on the home page, else on the first contact page that has one.

    pages: (website, path, email), read before; a path's place in `paths` is its rank.
    """
    rank = F.array_position(F.array(*[F.lit(p) for p in paths]), F.col("path"))
    hits = pages.filter(F.col("email").isNotNull() & F.col("path").isin(*paths)).withColumn("rank", rank)
    best = hits.groupBy("website").agg(F.min_by(F.struct("path", "email"), F.struct("rank", "email")).alias("m"))
    return rows.join(best, "website", "left").select("user_id", "website", F.col("m.path").alias("path"), F.col("m.email").alias("email"))


def _read_pages(s, d) -> DataFrame:
    return contacts(s, d).filter("website <> ''").select("website", F.explode(F.array(*[F.lit(p) for p in ("", "contact", "about", "team")])).alias("path"), "user_id").selectExpr(
        "website", "path", "CASE WHEN user_id % 8 = 0 AND path = '' THEN 'home@' || CAST(user_id AS STRING) || '.example.com' WHEN user_id % 3 = 0 AND path = 'about' THEN 'about@example.com' WHEN path = 'team' THEN 'team@example.com' END AS email"
    )


def _places(s, d) -> DataFrame:
    """Places as people write them, over all accounts."""
    return role(s, d, "account").selectExpr(
        "user_id",
        "CASE user_id % 5 WHEN 0 THEN 'New Orleans LA' WHEN 1 THEN '  New Orleans, la ' WHEN 2 THEN 'Portland' WHEN 3 THEN 'OR' ELSE 'St Paul, MN, MN' END AS place",
        "CASE user_id % 4 WHEN 0 THEN 'Austin, TX 78701' WHEN 1 THEN 'Austin' WHEN 2 THEN '' ELSE ', OR' END AS line",
        "CASE user_id % 3 WHEN 0 THEN 'https://docs.example.com/spreadsheets/d/abc-_' || CAST(user_id AS STRING) || '/edit#gid=0' WHEN 1 THEN 'https://docs.example.com/d/x' END AS url",
    )


QUERIES = {
    **{f"dedup_{k}": (lambda kind: lambda s, d: dedup(sources(s, d), kind))(k) for k in KEYS},
    "unlisted_cards": lambda s, d: unlisted(sources(s, d).filter("source_rank = 2 AND name IS NOT NULL").withColumn("name", F.expr("name || CASE WHEN position % 10 = 0 THEN ' II' ELSE '' END")), sources(s, d).filter("source_rank < 2")),
    "master_list": lambda s, d: master(sources(s, d)),
    "contact_report": lambda s, d: report(contacts(s, d)),
    "contact_top_states": lambda s, d: top_states(contacts(s, d)),
    "contact_segments": lambda s, d: segments(contacts(s, d)),
    "contact_enrichment": lambda s, d: enrich(contacts(s, d).filter("website <> '' AND coalesce(email, '') = ''").select("user_id", "website"), _read_pages(s, d)),
    "parsed_places": lambda s, d: _places(s, d).select("user_id", city_state(F.col("place")).alias("c"), locality(F.col("line"), "Salem", "OR").alias("l"), sheet_id(F.col("url")).alias("sheet")).select("user_id", "c.city", "c.state", F.col("l.city").alias("line_city"), F.col("l.state").alias("line_state"), F.col("l.zip").alias("line_zip"), "sheet"),
    "scanned_cities": lambda s, d: inline(s, "city string, area string", SCANNED).join(role(s, d, "shop").groupBy("city").agg(F.count(F.lit(1)).alias("shops")), "city", "left").select("city", "area", F.coalesce("shops", F.lit(0)).alias("shops")),
    "json_businesses": lambda s, d: json_records(_trees(s, d)).select("id", "name", "url", "city"),
    "page_link_counts": lambda s, d: page_links(s.read.parquet(f"{d}/pages.parquet")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("href").alias("different")),
}

SQL = {
    "dedup_joined": _dedup_sql("both", "length(coalesce(name, '')) >= 3"),
    "dedup_apart": _dedup_sql("apart", "length(key) >= 3"),
    "dedup_name": _dedup_sql("name", "key <> ''"),
    "dedup_name_kept": _dedup_sql("name", "TRUE"),
    "dedup_loose": _dedup_sql("both", "TRUE"),
    "unlisted_cards": with_roles(
        f"""WITH {_SOURCES}, c AS (SELECT source_rank, position, name || CASE WHEN position % 10 = 0 THEN ' II' ELSE '' END AS name, city FROM sources WHERE source_rank = 2 AND name IS NOT NULL)
        SELECT * FROM c WHERE name NOT IN (SELECT name FROM sources WHERE source_rank < 2 AND name IS NOT NULL)""", "account"
    ),
    "master_list": _dedup_sql("apart", "length(key) >= 3"),
    "contact_report": with_roles(
        f"""WITH {_CONTACTS} SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(email, '') <> '') AS with_email, count(*) FILTER (WHERE coalesce(phone, '') <> '') AS with_phone, count(*) FILTER (WHERE coalesce(website, '') <> '') AS with_website,
        count(*) FILTER (WHERE coalesce(email, '') = '' AND coalesce(phone, '') = '' AND coalesce(website, '') = '') AS without_contact, CAST(floor(count(*) FILTER (WHERE coalesce(email, '') <> '') * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS pct_email FROM contacts""", "account"
    ),
    "contact_top_states": with_roles(f"WITH {_CONTACTS} SELECT state, count(*) AS n FROM contacts WHERE coalesce(state, '') <> '' GROUP BY 1 ORDER BY n DESC, state LIMIT 5", "account"),
    "contact_segments": with_roles(
        f"""WITH {_CONTACTS} SELECT CASE WHEN coalesce(email, '') = '' THEN 'no address' WHEN status = 'emailed' THEN 'emailed' ELSE 'not started' END AS segment, count(*) AS n,
        count(*) FILTER (WHERE length(regexp_replace(phone, '\\D', '', 'g')) = 10 OR (length(regexp_replace(phone, '\\D', '', 'g')) = 11 AND regexp_replace(phone, '\\D', '', 'g') LIKE '1%')) AS callable FROM contacts GROUP BY 1""", "account"
    ),
    "contact_enrichment": with_roles(
        f"""WITH {_CONTACTS}, p AS (SELECT website, r, path, CASE WHEN user_id % 8 = 0 AND path = '' THEN 'home@' || user_id || '.example.com' WHEN user_id % 3 = 0 AND path = 'about' THEN 'about@example.com' END AS email
          FROM contacts, (VALUES (1, ''), (2, 'contact'), (3, 'about')) v(r, path) WHERE website <> ''),
        b AS (SELECT *, row_number() OVER (PARTITION BY website ORDER BY r) AS z FROM p WHERE email IS NOT NULL)
        SELECT user_id, website, path, b.email FROM contacts LEFT JOIN (SELECT * FROM b WHERE z = 1) b USING (website) WHERE website <> '' AND coalesce(contacts.email, '') = ''""", "account"
    ),
    "parsed_places": with_roles(
        """SELECT user_id, CASE user_id % 5 WHEN 0 THEN 'New Orleans' WHEN 1 THEN 'New Orleans' WHEN 2 THEN 'Portland' WHEN 3 THEN 'OR' ELSE 'St Paul MN,' END AS city, CASE user_id % 5 WHEN 0 THEN 'LA' WHEN 1 THEN 'LA' WHEN 4 THEN 'MN' ELSE '' END AS state,
        CASE user_id % 4 WHEN 0 THEN 'Austin' WHEN 1 THEN 'Austin' ELSE 'Salem' END AS line_city, CASE user_id % 4 WHEN 0 THEN 'TX' ELSE 'OR' END AS line_state, CASE user_id % 4 WHEN 0 THEN '78701' ELSE '' END AS line_zip,
        CASE user_id % 3 WHEN 0 THEN 'abc-_' || user_id END AS sheet FROM account""", "account"
    ),
    "scanned_cities": with_roles("SELECT city, area, count(shop_id) AS shops FROM (VALUES ('NATION_1', 'ASIA'), ('NATION_3', 'AFRICA'), ('NATION_7', ''), ('NATION_404', 'EUROPE')) v(city, area) LEFT JOIN shop USING (city) GROUP BY ALL", "shop"),
    "json_businesses": with_roles("SELECT shop_id AS id, name, '/b/' || shop_id AS url, city FROM shop WHERE shop_id % 4 < 2", "shop"),
    "page_link_counts": """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href FROM pages) SELECT page_id, count(*) AS n, count(DISTINCT href) AS different FROM a GROUP BY 1""",
}
