"""What scans bring in: cards of result pages, and businesses anywhere in JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.html import cards, listed
from ..sources.variants import json_records

#: The given pages as a directory would show them: each link of the navigation is a card, with quotes of both kinds and a locality on every other page.
_AS_RESULTS = [
    ("<li><a href=\"/", "<li><div class='v-card result'><h2 class=n><a class=\"track-visit-website x\" href=\"http://site.example.com/"),
    ("</a></li>", "</a></h2><div><span class=\"street-address\">1 Main St &amp; 2nd</span><span class=locality> Paris, TX 7546{0} </span></div></div>"),
    ("</nav>", "<a class='next {1}' href=2>Next</a></nav>"),
]
#: The text of an event's JSON; deep ones lie further down than is looked.
_EVENT_JSON = (
    "'{\"props\":' || props || ',\"seen\":[{\"name\":\"' || event_type || ' of ' || CAST(user_id AS STRING) || '\",\"businessUrl\":\"/e/' || CAST(event_id AS STRING) || '\",\"rating\":' || CAST(CAST(floor(value) AS BIGINT) AS STRING)"
    " || ',\"zip\":' || CAST(event_id AS STRING) || '},[' || repeat('{\"a\":', CAST(event_id % 12 AS INT)) || '{\"name\":\"deep one\",\"businessUrl\":true,\"website\":\"http://x.example.com?q=1\"}' || repeat('}', CAST(event_id % 12 AS INT)) || ']],\"name\":\"ab\",\"businessUrl\":\"/short\"}'"
)


def _results(s, d) -> DataFrame:
    html = F.col("html")
    for old, new in _AS_RESULTS:
        html = F.replace(html, F.lit(old), F.lit(new))
    html = F.replace(F.replace(html, F.lit("{0}"), (F.col("page_id") % 10).cast("string")), F.lit("{1}"), F.when(F.col("page_id") % 2 == 0, "last").otherwise("on"))
    some = F.when(F.col("page_id") % 2 == 0, html).otherwise(F.regexp_replace(html, "<span class=locality>[^<]*</span>", ""))
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", some.alias("html"))


QUERIES = {
    "page_cards": lambda s, d: cards(s.read.parquet(f"{d}/pages.parquet"), "nav li", {"name": ("b.none", "a"), "link": ("a.none@href", "a@href")}, "nav").select("page_id", F.col("position").cast("long").alias("position"), "name", "link", "has_next"),
    "listing_cards": lambda s, d: listed(cards(_results(s, d), next_="a.next.on"), "Salem", "OR").select("page_id", F.col("position").cast("long").alias("position"), "name", "address", "city", "state", "zip", "website", "has_next"),
    "json_event_records": lambda s, d: json_records(s.read.parquet(f"{d}/events.parquet").selectExpr("event_id AS id", f"{_EVENT_JSON} AS json")).select("id", "depth", "name", "url", "website", "zip", "rating"),
}

_TEXT = "trim(replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'))"
_LINKS = """l AS (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1)) AS shown,
  unnest(range(len(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)))) AS position FROM pages)"""

SQL = {
    "page_cards": f"WITH {_LINKS} SELECT page_id, position, {_TEXT.format('shown')} AS name, {_TEXT.format('href')} AS link, TRUE AS has_next FROM l",
    "listing_cards": f"""WITH {_LINKS} SELECT page_id, position, {_TEXT.format('shown')} AS name, '1 Main St & 2nd' AS address, CASE WHEN page_id % 2 = 0 THEN 'Paris' ELSE 'Salem' END AS city,
  CASE WHEN page_id % 2 = 0 THEN 'TX' ELSE 'OR' END AS state, CASE WHEN page_id % 2 = 0 THEN '7546' || page_id % 10 ELSE '' END AS zip, 'http://site.example.com/' || split_part({_TEXT.format('substr(href, 2)')}, '?', 1) AS website, page_id % 2 = 1 AS has_next FROM l""",
    "json_event_records": f"""WITH RECURSIVE w AS (
  SELECT event_id AS id, CAST({_EVENT_JSON} AS JSON) AS v, 0 AS depth FROM events
  UNION ALL
  SELECT id, unnest(items), depth + 1 FROM (
    SELECT id, depth, flatten(list_transform(kids, lambda c: CASE WHEN json_type(c) = 'ARRAY' THEN json_extract(c, '$[*]') ELSE [c] END)) AS items FROM (
      SELECT id, depth, CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') ELSE list_transform(json_keys(v), lambda k: json_extract(v, '$."' || k || '"')) END AS kids
      FROM w WHERE depth < 8 AND json_type(v) IN ('OBJECT', 'ARRAY'))))
SELECT id, depth, json_extract_string(v, '$.name') AS name, json_extract_string(v, '$.businessUrl') AS url, regexp_replace(coalesce(json_extract_string(v, '$.website'), ''), '\\?.*$', '') AS website,
  coalesce(nullif(json_extract_string(v, '$.zip'), '0'), '') AS zip, coalesce(nullif(json_extract_string(v, '$.rating'), '0'), '') AS rating
FROM w WHERE json_type(v) = 'OBJECT' AND length(json_extract_string(v, '$.name')) BETWEEN 3 AND 79 AND json_extract_string(v, '$.businessUrl') IS NOT NULL""",
}
