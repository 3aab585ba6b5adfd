"""The text functions over the given texts: listings from page headings and hosts, contacts and places from documents, forms of texts and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import STATES, blank_to_null, city_state, clean_phone, clean_url, emails, extension, first_underscore, first_word, fitted, host, join_present, json_shown, locality, shorten, tags, with_suffix
from ..operators.state import client_state
from .listings import KEYS, dedup, report, segments, top_states

#: A phone number as people write it, with more or fewer digits than one has.
_PHONE = r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{3,5}"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_SITE = r"https?://[A-Za-z0-9./?=_-]+"


def headings(s, d) -> DataFrame:
    """Pages as listings of three sources: the first word of the heading is the name, the host the city."""
    pages = s.read.parquet(f"{d}/pages.parquet")
    return pages.select((F.col("page_id") % 3).cast("int").alias("source_rank"), F.col("page_id").alias("position"), F.regexp_extract("html", "<h1>([^ <]*)", 1).alias("name"), F.regexp_extract("url", r"\.([a-z]+\.[a-z]+)/", 1).alias("city"))


def document_contacts(s, d) -> DataFrame:
    """Documents as listings: the first address, number and site of each text, its language as state."""
    docs = s.read.parquet(f"{d}/documents.parquet")
    return docs.select(
        F.col("doc_id").alias("user_id"), F.get(emails(F.col("text")), F.lit(0)).alias("email"), F.nullif(F.regexp_extract("text", _PHONE, 0), F.lit("")).alias("phone"), F.regexp_extract("text", _SITE, 0).alias("website"),
        F.when(F.col("source") != "web", F.col("lang")).otherwise("").alias("state"), F.when(F.col("n_chars") % 4 == 0, "emailed").otherwise("").alias("status"),
    )


def places(s, d) -> DataFrame:
    """The beginning of each document read as a place."""
    line = F.left(F.coalesce("text", F.lit("")), F.lit(24))
    rows = s.read.parquet(f"{d}/documents.parquet").select("doc_id", city_state(line).alias("c"), locality(line, "Salem", "OR").alias("l"))
    return rows.select("doc_id", "c.city", "c.state", F.col("l.city").alias("line_city"), F.col("l.state").alias("line_state"), F.col("l.zip").alias("zip"))


def forms(s, d) -> DataFrame:
    t = F.col("text")
    return s.read.parquet(f"{d}/documents.parquet").select(
        "doc_id", shorten(t, 80).alias("short"), with_suffix(F.col("source"), t, 40).alias("suffixed"), F.size(tags(t)).cast("long").alias("n_tags"), F.get(tags(t), F.lit(0)).alias("first_tag"), first_word(t).alias("word"), F.sha2(blank_to_null(t), 256).alias("trimmed_sha256"),
        first_underscore(F.left(t, F.lit(200))).alias("spaced"), fitted(t, 14).alias("fitted"), clean_phone(F.left(F.regexp_extract(t, _PHONE, 0), F.lit(30))).alias("phone"), join_present(" / ", F.col("lang"), F.when(F.col("n_chars") > 500, "long"), F.lit("")).alias("joined"),
    )


def changes(s, d) -> DataFrame:
    """What users do, as changes of what their clients keep: views make the list of recent ones, clicks star events, sign-ups save a place or clear it."""
    return s.read.parquet(f"{d}/events.parquet").selectExpr(
        "user_id", "CASE event_type WHEN 'view' THEN 'recent' WHEN 'click' THEN 'starred' WHEN 'signup' THEN 'place' END AS key",
        "CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN NULL ELSE regexp_extract(props, '[0-9]+', 0) END AS item", "ts AS at", "event_id AS seq",
    ).filter("key IS NOT NULL")


QUERIES = {
    "client_state": lambda s, d: client_state(changes(s, d), ("recent",), ("starred",), ("place",)).withColumn("place", F.col("place").cast("long")),
    **{f"dedup_pages_{k}": (lambda kind: lambda s, d: dedup(headings(s, d), kind))(k) for k in KEYS},
    "document_contact_report": lambda s, d: report(document_contacts(s, d)),
    "document_contact_states": lambda s, d: top_states(document_contacts(s, d)),
    "document_contact_segments": lambda s, d: segments(document_contacts(s, d)),
    "document_places": places,
    "document_forms": forms,
    "page_url_forms": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", clean_url(F.col("url")).alias("clean"), clean_url(F.regexp_replace("url", "^https?://", "")).alias("schemed"), extension(host(F.col("url"))).alias("domain"), host(F.col("url")).alias("host")),
    "event_props_shown": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", json_shown(F.concat(F.lit('["'), "event_type", F.lit('","'), F.regexp_extract("props", "[0-9]+", 0), F.when(F.col("event_id") % 3 > 0, '"]').otherwise(""))).alias("shown")),
}

_ROWS = "s AS (SELECT CAST(page_id % 3 AS INT) AS source_rank, page_id AS position, regexp_extract(html, '<h1>([^ <]*)', 1) AS name, regexp_extract(url, '\\.([a-z]+\\.[a-z]+)/', 1) AS city FROM pages)"
_STRIP = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_KEY = {"joined": ("name || city", "length(name) >= 3"), "apart": (None, "length(key) >= 3"), "name": ("name", "key <> ''"), "name_kept": ("name", "TRUE"), "loose": ("name || city", "TRUE")}


def _dedup_sql(kind: str) -> str:
    text, keep = _KEY[kind]
    key = _STRIP.format(text) if text else f"{_STRIP.format('name')} || {_STRIP.format('city')}"
    return f"WITH {_ROWS}, k AS (SELECT *, {key} AS key FROM s) SELECT source_rank, position, name, city FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_rank, position) AS z FROM k WHERE {keep}) WHERE z = 1"


_CONTACTS = f"""c AS (SELECT lower(nullif(regexp_extract(text, '{_EMAIL}', 0), '')) AS email, nullif(regexp_extract(text, '{_PHONE}', 0), '') AS phone, regexp_extract(text, '{_SITE}', 0) AS website,
  CASE WHEN source <> 'web' THEN lang ELSE '' END AS state, CASE WHEN n_chars % 4 = 0 THEN 'emailed' ELSE '' END AS status FROM documents),
 x AS (SELECT *, coalesce(email, '') <> '' AS e, coalesce(phone, '') <> '' AS p, coalesce(website, '') <> '' AS w, regexp_replace(phone, '\\D', '', 'g') AS digits FROM c)"""
_TAGS = "list_filter(list_transform(string_split(text, ','), lambda t: trim(t)), lambda t: t <> '')"
_DIGITS = f"regexp_replace(left(regexp_extract(text, '{_PHONE}', 0), 30), '\\D', '', 'g')"
_KNOWN = ", ".join(f"'{x}'" for x in STATES)

SQL = {
    "client_state": """WITH c AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'recent' WHEN 'click' THEN 'starred' WHEN 'signup' THEN 'place' END AS key, CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN NULL ELSE regexp_extract(props, '[0-9]+', 0) END AS item,
   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('view', 'click', 'signup')),
 i AS (SELECT user_id, key, item, max(k) AS last, count(*) AS n FROM c WHERE key <> 'place' AND item IS NOT NULL GROUP BY 1, 2, 3)
SELECT user_id, key, place, item FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS place FROM i WHERE key = 'recent') WHERE place <= 8
UNION ALL SELECT user_id, key, row_number() OVER (PARTITION BY user_id ORDER BY last) AS place, item FROM i WHERE key = 'starred' AND n % 2 = 1
UNION ALL SELECT user_id, key, 1, item FROM (SELECT user_id, key, item, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS z FROM c WHERE key = 'place') WHERE z = 1 AND item IS NOT NULL""",
    **{f"dedup_pages_{k}": _dedup_sql(k) for k in KEYS},
    "document_contact_report": f"""WITH {_CONTACTS} SELECT count(*) AS total, count(*) FILTER (WHERE e) AS with_email, count(*) FILTER (WHERE p) AS with_phone, count(*) FILTER (WHERE w) AS with_website, count(*) FILTER (WHERE NOT e AND NOT p AND NOT w) AS without_contact,
  CAST(floor(count(*) FILTER (WHERE e) * 100.0::DOUBLE / count(*) + 0.5) AS BIGINT) AS pct_email FROM x""",
    "document_contact_states": f"WITH {_CONTACTS} SELECT state, count(*) AS n FROM x WHERE coalesce(state, '') <> '' GROUP BY 1 ORDER BY n DESC, state LIMIT 5",
    "document_contact_segments": f"""WITH {_CONTACTS} SELECT CASE WHEN NOT e THEN 'no address' WHEN status = 'emailed' THEN 'emailed' ELSE 'not started' END AS segment, count(*) AS n,
  count(*) FILTER (WHERE length(digits) = 10 OR length(digits) = 11 AND digits LIKE '1%') AS callable FROM x GROUP BY 1""",
    "document_places": f"""WITH l AS (SELECT doc_id, left(coalesce(text, ''), 24) AS line FROM documents),
 p AS (SELECT *, trim(line) AS t, string_split(line, ',') AS c, regexp_split_to_array(CASE WHEN strpos(trim(line), ',') > 0 THEN substr(trim(line), 1, strpos(trim(line), ',') - 1) || substr(trim(line), strpos(trim(line), ',') + 1) ELSE trim(line) END, '\\s+') AS w FROM l),
 k AS (SELECT *, upper(w[-1]) IN ({_KNOWN}) AND len(w) > 1 AS known FROM p)
SELECT doc_id, CASE WHEN known THEN array_to_string(w[:-2], ' ') ELSE t END AS city, CASE WHEN known THEN upper(w[-1]) ELSE '' END AS state, coalesce(nullif(trim(c[1]), ''), 'Salem') AS line_city,
  coalesce(nullif(string_split(trim(c[2]), ' ')[1], ''), 'OR') AS line_state, regexp_extract(line, '\\d{{5}}', 0) AS zip FROM k""",
    "document_forms": f"""SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS short, CASE WHEN coalesce(text, '') = '' THEN source ELSE source || ' — ' || left(text, 40) END AS suffixed, CAST(len({_TAGS}) AS BIGINT) AS n_tags, {_TAGS}[1] AS first_tag,
  string_split(text, ' ')[1] AS word, sha256(nullif(trim(text), '')) AS trimmed_sha256, CASE WHEN strpos(left(text, 200), '_') > 0 THEN substr(left(text, 200), 1, strpos(text, '_') - 1) || ' ' || substr(left(text, 200), strpos(text, '_') + 1) ELSE left(text, 200) END AS spaced,
  rpad(left(coalesce(text, ''), 14), 14, ' ') AS fitted, CASE WHEN length({_DIGITS}) = 10 THEN '+1' || {_DIGITS} WHEN length({_DIGITS}) = 11 AND {_DIGITS} LIKE '1%' THEN '+' || {_DIGITS} END AS phone, concat_ws(' / ', nullif(lang, ''), CASE WHEN n_chars > 500 THEN 'long' END) AS joined FROM documents""",
    "page_url_forms": """WITH c AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '\\?.*$', ''), '/+$', '') AS clean, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '^www\\.', '') AS host, url FROM pages)
SELECT page_id, clean, 'https://' || regexp_replace(clean, '^https?://', '') AS schemed, string_split(host, '.')[-1] AS domain, host FROM c""",
    "event_props_shown": """SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_type || ', ' || regexp_extract(props, '[0-9]+', 0) ELSE '["' || event_type || '","' || regexp_extract(props, '[0-9]+', 0) END AS shown FROM events""",
}
