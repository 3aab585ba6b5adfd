"""Spreadsheets and a paged service as data sources."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from marketlens.sources import paged, readers, writers, xlsx

SHEET = """<worksheet xmlns="{0}"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>Unit Price</t></is></c><c r="E1" t="s"><v>0</v></c></row>
<row r="3"><c r="A3" t="s"><v>2</v></c><c r="C3" t="str"><f>A1</f><v>f&lt;</v></c><c r="D3"><v>12.5</v></c></row>
<row r="4"><c r="B4" t="b"><v>1</v></c><c r="C4" t="e"><v>#N/A</v></c><c r="D4"><v>1E1</v></c></row>
<row r="5"/><row r="6"><c r="C6" t="s"><v>1</v></c><c r="AA6"><v>9</v></c></row></sheetData></worksheet>"""
SHARED = '<sst xmlns="{0}"><si><t>Brand</t></si><si><r><t>Na</t></r><r><t>me</t></r></si><si><t xml:space="preserve"> a &amp; b </t><rPh sb="0" eb="1"><t>no</t></rPh></si></sst>'


def workbook(path):
    with zipfile.ZipFile(path, "w") as book:
        for name, text in xlsx._PARTS.items():
            book.writestr(name, text.replace("worksheets/sheet1", "worksheets/other"))
        book.writestr("xl/worksheets/other.xml", SHEET.format(xlsx._MAIN))
        book.writestr("xl/sharedStrings.xml", SHARED.format(xlsx._MAIN))


def test_foreign_workbook(spark, tmp_path):
    xlsx.register(spark)
    workbook(tmp_path / "a.xlsx")
    df = spark.read.format("xlsx").load(str(tmp_path / "a.xlsx"))
    assert df.columns == ["_file", "_row", "Brand", "_c1", "Name", "Unit Price", "Brand_1"]
    assert sorted(tuple(r)[1:] for r in df.collect()) == [(0, " a & b ", "", "f<", "12.5", ""), (1, "", "TRUE", "", "10", ""), (2, "", "", "Name", "", "")]


def test_round_trip_and_overwrite(spark, tmp_path):
    xlsx.register(spark)
    rows = [(i, f'<x> & "{i}" \n é', None if i % 3 else i / 4, i % 2 == 0) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, text string, price double, even boolean").repartition(3)
    for _ in range(2):
        df.write.format("xlsx").mode("overwrite").save(f"{tmp_path}/out")
    found = spark.read.format("xlsx").load(f"{tmp_path}/out")
    price = lambda p: "" if p is None else str(int(p)) if p == int(p) else str(p)
    assert sorted((int(r.id), r.text, r.price, r.even) for r in found.collect()) == [(i, t, price(p), str(e).upper()) for i, t, p, e in rows]
    assert found.select("_file").distinct().count() == 3


def test_failed_write_leaves_nothing(spark, tmp_path):
    xlsx.register(spark)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        spark.range(10).repartition(2).selectExpr("1 / (id - 3) AS x").write.format("xlsx").mode("append").save(f"{tmp_path}/bad")
    assert xlsx.files(str(tmp_path)) == [] and not list(tmp_path.rglob("*.xlsx"))


def test_both_kinds_of_upload_give_the_same_rows(spark, tmp_path):
    rows = [("Acme", " Red ", "long", "$3", "4"), (None, "", "x", "1", "1"), ("Bolt", None, None, "5.5", ""), (None, "Blue, \"1\"", "", "7", "2")]
    df = spark.createDataFrame(rows, "Maker string, `Product Name` string, Size string, `Unit Cost` string, Qty string").coalesce(1)
    xlsx.register(spark)
    df.write.format("xlsx").mode("append").save(f"{tmp_path}/x")
    writers.write_csv(df, f"{tmp_path}/c")
    (book,) = xlsx.files(f"{tmp_path}/x")
    a, b = (sorted(map(tuple, readers.read_upload(spark, p).select("row", "brand", "name", "size", "price", "quantity").collect())) for p in (book, f"{tmp_path}/c"))
    assert a == b == [(0, "Acme", "Red", "long", "$3", "4"), (1, "Bolt", None, None, "5.5", None), (2, None, 'Blue, "1"', None, "7", "2")]


def test_large_upload_keeps_its_order(spark, tmp_path):
    with open(tmp_path / "big.csv", "w") as f:
        f.write("brand,name\n" + "".join(f"b{i},n{i}\n" if i % 7 else ",\n" for i in range(30_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30k")
    try:
        found = readers.read_upload(spark, f"{tmp_path}/big.csv").orderBy("row").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    kept = [i for i in range(30_000) if i % 7]
    assert [(r.row, r["name"]) for r in found] == [(k, f"n{i}") for k, i in enumerate(kept)]


def answers(spark, pages):
    return spark.createDataFrame([(q, t, json.dumps(b)) for q, t, b in pages], "query string, token string, body string")


def test_pages_of_three_queries(spark, tmp_path):
    r = lambda name, **more: {"name": name, "place_id": name, "formatted_address": "1 Main St, Austin, TX 78701", "geometry": {"location": {"lat": 1, "lng": 2.5}}} | more
    pages = [
        ("shops", "", {"results": [r("A", rating=4), r("B & Co")], "next_page_token": "t1"}), ("shops", "t1", {"results": [r("C")], "next_page_token": "t2"}), ("shops", "t2", {"results": []}),
        ("lounges in x, y", "", {"results": [r("b co", rating=1), r("D", details={"website": "w", "formatted_phone_number": "p"})]}), ("never asked", "", {"results": [r("E")]}),
    ]
    paged.save_answers(answers(spark, pages), f"{tmp_path}/saved")
    found = paged.places(spark, f"{tmp_path}/saved", ["shops", "lounges in x, y", "nothing"], "Austin", "TX").collect()
    assert sorted((r.name, r.address, r.zip, r.lat, r.rating, r.phone, r.website) for r in found) == [
        ("A", "1 Main St", "78701", 1.0, 4.0, "", ""), ("B & Co", "1 Main St", "78701", 1.0, None, "", ""), ("C", "1 Main St", "78701", 1.0, None, "", ""), ("D", "1 Main St", "78701", 1.0, None, "p", "w"),
    ]
    rows = spark.read.format("paged").option("path", f"{tmp_path}/saved").option("queries", '["shops", "nothing"]').load()
    assert sorted((r.query, r.page, r.position) for r in rows.collect()) == [("shops", 1, 0), ("shops", 1, 1), ("shops", 2, 0)] and rows.rdd.getNumPartitions() == 2


def test_missing_page_is_an_error_and_a_later_read_is_whole(spark, tmp_path):
    pages = [("q", "", {"results": [{"name": "A"}], "next_page_token": "gone"})]
    paged.save_answers(answers(spark, pages), f"{tmp_path}/saved")
    paged.register(spark)
    rows = spark.read.format("paged").option("path", f"{tmp_path}/saved").option("queries", '["q"]').load()
    with pytest.raises(Exception, match="is missing"):
        rows.collect()
    paged.save_answers(answers(spark, [*pages, ("q", "gone", {"results": [{"name": "B"}], "next_page_token": "gone"})]), f"{tmp_path}/saved")
    assert [r.name for r in rows.collect()] == ["A", "B"]


def test_collection_sheet(spark, tmp_path):
    items = spark.createDataFrame([("A", "n", None, 2, 3.5), ("B", None, "used", None, None)], "brand string, name string, status string, quantity int, price double")
    writers.write_collection(items, f"{tmp_path}/c")
    found = spark.read.format("xlsx").load(f"{tmp_path}/c").drop("_file", "_row")
    assert found.columns == [n for n, _ in writers.COLLECTION]
    assert sorted(map(tuple, found.collect())) == [("A", "n", "", "owned", "2", "3.5", "", ""), ("B", "", "", "used", "", "", "", "")]
    assert found.filter(F.col("Qty") != "").count() == 1
