"""Cards from HTML and businesses in JSON on small pages and documents."""

import json

from marketlens.sources.html import cards, listed, parse
from marketlens.sources.variants import json_records

PAGE = """<html><body><div class="search result-list">
<div class='x result first'><h2 class="n"><a href="/a">Ann &amp; <b>Bob&#39;s</b></a></h2><p class=street-address>1 Main<p class="locality">Austin, TX 78701-1</p>
<a class='track-visit-website' href='https://ann.example.com/x?utm=1'>site</a><img src=x><br></div>
<DIV CLASS="result"><span class="business-name"> <span>Second</span><span>!</span> </span><h2 class=n><a>other</a></h2><ul><li class=phone>(1) 2<li class="locality">Waco</ul><a class="track-visit-website" href="/own">s</a></div>
<div class="result"><h2 class="m"><a>no name</a></h2></div>
<div class="resultant"><h2 class="n"><a>no card</a></h2></div>
<script>var x = "<div class='result'>";</script></div></span><a class="page next">more</a>"""


def test_cards(spark):
    pages = spark.createDataFrame([(1, PAGE, "-"), (2, None, "-"), (3, "", "-"), (4, "<div class=result><h2 class=n><a>Open", "-"), (5, "< <<&& not html", "-")], "page_id int, html string, position string")
    got = {(r.page_id, r.position): r.asDict() for r in listed(cards(pages), "Salem", "OR").collect()}
    assert sorted(got) == [(1, 0), (1, 1), (4, 0)]
    one, two, three = got[1, 0], got[1, 1], got[4, 0]
    assert (one["name"], one["address"], one["city"], one["state"], one["zip"], one["website"], one["has_next"]) == ("Ann & Bob's", "1 Main", "Austin", "TX", "78701", "https://ann.example.com/x", True)
    assert (two["name"], two["phone"], two["city"], two["state"], two["zip"], two["website"]) == ("Second!", "(1) 2", "Waco", "OR", "", "")
    assert (three["name"], three["has_next"]) == ("Open", False)


def test_deep_and_long_pages():
    deep = parse("<div>" * 20_000 + "x")
    assert deep.text() == "x" and len(deep.find("div")) == 20_000
    assert len(parse("<p>a" * 50_000).find("p")) == 50_000


def walk(x, depth=0):
    """As a scan's own script walks: objects and arrays, the items of arrays on their array's level."""
    if depth > 8 or not x or not isinstance(x, (dict, list)):
        return
    if isinstance(x, dict) and isinstance(x.get("name"), str) and x.get("businessUrl") and 2 < len(x["name"]) < 80:
        yield depth, x["name"]
    for v in x.values() if isinstance(x, dict) else x:
        for y in v if isinstance(v, list) else [v]:
            yield from walk(y, depth + 1)


def test_json_records(spark):
    b = lambda name, **more: {"name": name, "businessUrl": "/b"} | more
    deep = b("deepest")
    for _ in range(8):
        deep = {"a": deep, "b": b("at each level")}
    trees = [
        b("Top one", list=[b("in"), b("In list"), [b("nested"), [[b("nested more")]]]]), [b("in an array"), [b("again")]], {"a": deep}, deep, {"x": b("falsy", businessUrl=0), "y": b("empty", businessUrl=""), "z": {"name": 3, "businessUrl": 1}},
        [], {}, "text", 5, None, {"a": [], "b": [[]], "c": [1, "x", None]}, {"name": "x" * 80, "businessUrl": 1}, {"text": json.dumps(b("only a text"))},
    ]
    rows = [(i, json.dumps(t)) for i, t in enumerate(trees)] + [(90, "{oops"), (91, None), (92, "")]
    found = json_records(spark.createDataFrame(rows, "id int, json string")).select("id", "path", "depth", "name").collect()
    assert sorted((r.id, r.depth, r.name) for r in found) == sorted((i, d, n) for i, t in enumerate(trees) for d, n in walk(t))
    assert [r.name for r in sorted((r for r in found if r.id == 0), key=lambda r: r.path)] == ["Top one", "In list", "nested", "nested more"]


def test_fields_of_records(spark):
    one = {"name": "Abc", "businessUrl": "/b", "phone": "", "phoneNumber": 5, "formattedPhone": "x", "website": None, "websiteUrl": "http://w?q=1", "address": {"a": 1}, "formattedAddress": "1 St\nCity", "zip": 0, "postalCode": "01234", "rating": 4.5, "reviewCount": 7, "city": "C"}
    (r,) = json_records(spark.createDataFrame([(1, json.dumps(one))], "id int, json string")).collect()
    assert (r.phone, r.website, r.address, r.zip, r.rating, r.reviews, r.city, r.state) == ("", "http://w", "", "01234", "4.5", "7", "C", "")
