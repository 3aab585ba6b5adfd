"""Readers and writers of files on small ones."""

import json

from marketlens.sources import readers, writers
from marketlens.streaming import views


def test_result_pages_are_united(spark, tmp_path):
    one = {"page": 1, "results": [{"place_id": "a", "name": "A", "website": "w"}, {"name": "B", "formatted_address": "x"}, {"place_id": "c", "name": ""}]}
    two = {"page": 2, "results": [{"place_id": "a", "name": "A again"}, {"name": "B", "formatted_address": "x"}, {"name": "B", "formatted_address": "y"}]}
    for i, page in enumerate((one, two)):
        (tmp_path / f"{i}.json").write_text(json.dumps(page))
    found = readers.read_result_pages(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.address or "", r.website or "") for r in found) == [("A", "", "w"), ("B", "x", ""), ("B", "y", "")]


def test_log_template_and_steps(spark, tmp_path):
    for i in range(2):
        writers.append_log(spark.createDataFrame([(i, "view")], "id int, kind string"), f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    writers.write_template(spark, f"{tmp_path}/template", ["Brand", "Qty"], ["A, B", "2"])
    assert [tuple(r) for r in readers.read_csv(spark, f"{tmp_path}/template").collect()] == [("A, B", "2")]
    made = []
    steps = [("one", lambda: made.append(1)), ("two", lambda: made.append(2))]
    ledger = writers.apply_once(spark.createDataFrame([("one",)], "name string"), steps)
    ledger = writers.apply_once(ledger, steps)
    assert made == [2] and sorted(r.name for r in ledger.collect()) == ["one", "two"]


def test_upload_listings_places_and_mail(spark, tmp_path):
    (tmp_path / "u.csv").write_text('Maker,Product Name,Size,Cost,Qty\nA,"x, y",t,$5,3\n,,,,\nB, z ,,,\n')
    rows = readers.read_upload(spark, f"{tmp_path}/u.csv").collect()
    assert [(r.brand, r.name, r.price, r.row) for r in rows] == [("A", "x, y", "$5", 0), ("B", "z", None, 1)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("name,state\nN,or\n")
    (tmp_path / "in" / "MASTER.csv").write_text("name\nold\n")
    found = readers.read_listings(spark, f"{tmp_path}/in")
    assert [(r.name, r.state, r.city) for r in found.collect()] == [("N", "or", "")]
    writers.write_listings(found, f"{tmp_path}/out")
    assert readers.read_csv(spark, f"{tmp_path}/out").columns == list(readers.LISTING)
    pages = spark.createDataFrame([('<a href="mailto:A@x.org?s=1">m</a> b@y.org a@x.org',), (None,)], "html string")
    assert [r.emails for r in readers.page_emails(pages).collect()] == [["a@x.org", "b@y.org"], []]
    (tmp_path / "p.json").write_text(json.dumps({"elements": [{"lat": 1.0, "lon": 2.0, "tags": {"name": "Place", "contact:phone": "tel:123"}}, {"center": {"lat": 3.0, "lon": 4.0}, "tags": {"name": "ab"}}]}))
    assert [(r.name, r.phone, r.lat) for r in readers.read_places(spark, f"{tmp_path}/p.json").collect()] == [("Place", "123", 1.0)]


def test_sheets_are_merged_batch_by_batch(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, v string").parquet(f"{tmp_path}/in")
    seen = []
    query = views.sync_sheets(stream, lambda df, batch: seen.extend(tuple(r) for r in df.collect()), f"{tmp_path}/check", "1 second")
    query.processAllAvailable()
    query.stop()
    assert sorted(seen) == [(1, "a"), (2, "b")]
