"""Writes, deduplication, files and streams on small tables."""

from pyspark.sql import functions as F

from marketlens.operators import match, relational, writes
from marketlens.sources import readers, writers
from marketlens.streaming import views


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_import_last_wins_and_counts(spark):
    table = spark.createDataFrame([(1, None, 5.0), (1, 2, 6.0)], "shop int, size int, price double")
    up = spark.createDataFrame([(0, 1, None, 7.0), (1, 9, 1, 1.0), (2, 9, 1, 2.0), (3, 1, 3, None)], "pos int, shop int, size int, price double")
    after, counts = writes.import_rows(table, up, ["shop", "size"], ["price"], "pos", F.col("price").isNotNull())
    assert rows(after) == [(1, 2, 6.0), (1, None, 7.0), (9, 1, 2.0)]
    assert counts.first().asDict() == {"added": 1, "updated": 2, "skipped": 1}
    again = writes.import_rows(after, up, ["shop", "size"], ["price"], "pos", F.col("price").isNotNull())
    assert again[1].first().added == 0 and rows(again[0]) == rows(after)


def test_edges_and_cascade(spark):
    edges = spark.createDataFrame([(1, 1), (1, 2)], "a int, b int")
    other = spark.createDataFrame([(1, 2), (2, 2), (2, 2)], "a int, b int")
    assert rows(writes.toggle(edges, other, ["a", "b"])) == [(1, 1), (2, 2)]
    assert rows(writes.keep_existing(edges, other, ["a", "b"])) == [(1, 1), (1, 2), (2, 2)]
    tables = {"shop": spark.createDataFrame([(1,), (2,)], "id int"), "post": spark.createDataFrame([(10, 1), (20, 2)], "post int, shop int"), "like": spark.createDataFrame([(10,), (20,)], "p int")}
    left = writes.delete_cascade(tables, [("shop", "id", "post", "shop"), ("post", "post", "like", "p")], "shop", "id", spark.createDataFrame([(1,)], "id int"))
    assert [rows(left[t]) for t in ("shop", "post", "like")] == [[(2,)], [(20, 2)], [(20,)]]


def test_update_insert_three_way(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert rows(writes.update_rows(t, spark.createDataFrame([(2, None)], "id int, v string"), ["id"], ["v"])) == [(1, "a"), (2, None)]
    assert rows(writes.insert_rows(t, spark.createDataFrame([("c",), ("d",)], "v string"), "id", ["v"])) == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert rows(writes.three_way(t, spark.createDataFrame([(1, None), (3, "x")], "id int, v string"), ["id"], "v")) == [(2, "b"), (3, "x")]


def test_first_wins_and_fuzzy_ties(spark):
    t = spark.createDataFrame([(1, 5, "x"), (0, 9, "x"), (0, 7, "y")], "source_rank int, pos int, k string")
    assert rows(relational.first_wins(t, F.col("k"), "source_rank", "pos")) == [(0, 7, "y"), (0, 9, "x")]
    up = spark.createDataFrame([(0, "abx"), (1, "zzzz"), (2, None)], "row int, name string")
    known = spark.createDataFrame([(5, "abc"), (3, "abd"), (4, "ABD!")], "product_id int, name string")
    assert [(r.row, r.product_id, r.confidence) for r in match.fuzzy_best(up, known).orderBy("row").collect()] == [(0, 3, 67), (1, None, 0), (2, None, 0)]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Brand,Product Name,Unit Price\n"x, ""y""", n1 ,$3\n\n,,\nb,n2,4\n')
    up = readers.read_upload(spark, str(tmp_path / "a.csv"))
    assert [(r.brand, r["name"], r.price, r.size) for r in up.orderBy("row").collect()] == [('x, "y"', "n1", "$3", None), ("b", "n2", "4", None)]
    (tmp_path / "in").mkdir()
    for name in ("one", "MASTER"):
        (tmp_path / "in" / f"{name}.csv").write_text("name,city\nshop,rome\n")
    listed = readers.read_listings(spark, str(tmp_path / "in"))
    assert listed.count() == 1 and listed.first().email == ""
    writers.write_listings(listed, str(tmp_path / "out"))
    assert readers.read_csv(spark, str(tmp_path / "out")).first()["name"] == "shop"
    found = spark.createDataFrame([("shop", "rome", "a@b.co")], "name string, city string, email string")
    assert writers.fill_emails(listed, found).first().email == "a@b.co"
    (tmp_path / "poi.json").write_text('{"elements":[{"lat":1.0,"lon":2.0,"tags":{"name":"Abc","contact:phone":"tel:1"}},{"center":{"lat":3.0,"lon":4.0},"tags":{"name":"Def"}},{"tags":{"name":"x"}}]}')
    assert [(r["name"], r.phone, r.lat) for r in readers.read_places(spark, str(tmp_path / "poi.json")).orderBy("name").collect()] == [("Abc", "1", 1.0), ("Def", None, 3.0)]
    page = spark.createDataFrame([("<a href='mailto:B@c.org?x'>w</a> a@b.co",), (None,)], "html string")
    assert [r.emails for r in readers.page_emails(page).collect()] == [["b@c.org", "a@b.co"], []]
    assert writers.as_json(found).first().json == '{"name":"shop","city":"rome","email":"a@b.co"}'


def test_stream_equals_table(spark, data, tmp_path):
    folder = str(tmp_path / "events")
    spark.read.parquet(f"{data}/events.parquet").write.parquet(folder)
    stream = views.windowed(views.read_events(spark, folder))
    views.run_once(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    done = {(r.start, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = {(r.start, r.n) for r in views.windowed(spark.read.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))).collect()}
    assert done and done <= whole


def test_entry():
    import __spark_entry__ as e

    names = e.queries()
    assert "catalog_search" in names and set(e.oracle_sql()) <= set(names)
