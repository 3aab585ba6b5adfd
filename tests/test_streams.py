"""The stateful count batch by batch against the tables, expiry, and merges of sheets that repeat or break."""

import pytest
from pyspark.sql import functions as F

from marketlens.roles import role
from marketlens.streaming import sheets, unread, views


def test_unread_counts_batch_by_batch(spark, data, tmp_path):
    notes, follows = role(spark, data, "note").filter("note_id < 400"), role(spark, data, "follow")
    reads = role(spark, data, "note_read").filter("note_id < 400").join(notes.select("note_id", F.col("created_at").alias("at")), "note_id").select("user_id", "note_id", "at")
    for k in range(4):
        notes.filter(f"note_id % 4 = {k}").coalesce(1).write.parquet(f"{tmp_path}/notes/{k}")
        reads.filter(f"note_id % 4 = {(k + 1) % 4}").coalesce(1).write.parquet(f"{tmp_path}/reads/{k}")  # some are read before they come
    stream = lambda name: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/{name}/0").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")
    counts, steps = {}, []

    def keep(df, batch):
        counts.update({r.user_id: r.unread for r in df.collect()})
        steps.append(dict(counts))

    counted = unread.unread_counts(stream("notes"), follows, stream("reads"), 10_000, "365 days")
    counted.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    table = {r.user_id: r.unread for r in unread.unread_by_user(notes, follows, reads).collect()}
    assert len(steps) >= 4 and {u: n for u, n in counts.items() if n} == {u: n for u, n in table.items() if n}
    assert set(table) <= set(counts)


def test_old_notes_are_forgotten(spark, tmp_path):
    follows = spark.createDataFrame([(1, 10), (2, 10)], "user_id long, shop_id long")
    note = lambda i, day: (i, 10, "deal", None, day)
    schema = "note_id long, shop_id long, type string, created_by long, created_at string"
    for k, rows in enumerate([[note(1, "2024-01-01"), note(2, "2024-01-02")], [note(3, "2024-01-20")], [note(4, "2024-01-21")], [note(5, "2024-01-21")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/notes/{k}")
    spark.createDataFrame([(1, 2, "2024-01-02"), (1, 2, "2024-01-03")], "user_id long, note_id long, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{tmp_path}/reads/0")
    stream = lambda name, s: spark.readStream.schema(s).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}")
    seen = {}
    counted = unread.unread_counts(stream("notes", schema), follows, stream("reads", "user_id long, note_id long, at timestamp"), 7, "1 hour")
    wanted = {u for u in (1, 2) if (u + 10) % (unread.TYPES.index("deal") + 2)}
    query = counted.writeStream.foreachBatch(lambda df, _: [seen.setdefault(r.user_id, []).append(r.unread) for r in df.collect()]).outputMode("update").option("checkpointLocation", f"{tmp_path}/check").start()
    query.processAllAvailable()
    query.stop()
    assert {u: c[-1] for u, c in seen.items() if u in wanted} == dict.fromkeys(wanted, 3)
    assert max(map(max, seen.values())) <= 3


COLUMNS = "shop_id long, url string, position long, brand string, name string, size string, price string, quantity string, problem string"
URL = "https://docs.example.com/spreadsheets/d/abc_{}/edit"


@pytest.fixture
def tables(spark):
    first = spark.createDataFrame([(1, 1, 10, 5.0, 1), (3, 1, 10, 9.0, 1)], "shop_id long, product_id long, size_id long, price double, quantity int")
    products = spark.createDataFrame([(1, "Acme", "Red"), (2, "Acme", "Blue")], "product_id long, brand string, name string")
    sizes = spark.createDataFrame([(1, 10, "Long"), (2, 20, "Long")], "product_id long, size_id long, size_name string")
    return first, products, sizes


def row(shop, at, name, price="2", url=URL, problem=None):
    return (shop, url and url.format(shop), at, "acme", name, "long", price, "4", problem)


def test_a_repeated_batch_changes_nothing_and_a_broken_sheet_stops_no_other(spark, tables, tmp_path):
    path = str(tmp_path / "sync")
    sent = [row(1, 1, "red"), row(1, 2, "blue", "3"), row(1, 3, "green"), row(2, 1, "red", url="https://example.com/no"), row(3, 1, "red"), row(3, 2, "red", problem="unclosed quote"), row(4, 1, "blue")]
    batch = spark.createDataFrame(sent, COLUMNS)
    for _ in range(2):
        sheets.merge_batch(batch, 0, path, *tables)
    want = [(1, 1, 10, 2.0, 4), (1, 2, 20, 3.0, 4), (3, 1, 10, 9.0, 1), (4, 2, 20, 2.0, 4)]
    now = lambda: sorted(map(tuple, sheets.stock(spark, path, tables[0]).drop("synced").collect()))
    assert now() == want
    book = {r.shop_id: (r.synced, r.unmatched, r.error) for r in sheets.ledger(spark, path).filter("shop_id IS NOT NULL").collect()}
    assert book == {1: (2, 1, None), 2: (0, 0, "no sheet id in the URL"), 3: (0, 0, "unclosed quote"), 4: (1, 0, None)}
    sheets.merge_batch(spark.createDataFrame([row(3, 1, "red", "7")], COLUMNS), 1, path, *tables)
    sheets.merge_batch(batch, 0, path, *tables)
    assert now() == [w if w[0] != 3 else (3, 1, 10, 7.0, 4) for w in want] and sheets.last_batch(spark, path) == 1


def test_a_batch_that_failed_before_its_ledger_is_done_again(spark, tables, tmp_path):
    path = str(tmp_path / "sync")
    spark.createDataFrame([(9, 9, 9, 1.0, 1, True)], "shop_id long, product_id long, size_id long, price double, quantity int, synced boolean").write.parquet(f"{path}/stock-0")
    assert sheets.last_batch(spark, path) == -1
    sheets.merge_batch(spark.createDataFrame([row(1, 1, "red")], COLUMNS), 0, path, *tables)
    assert sorted((r.shop_id, r.price) for r in sheets.stock(spark, path, tables[0]).collect()) == [(1, 2.0), (3, 9.0)]


def test_as_a_stream(spark, tables, tmp_path):
    for k, rows in enumerate([[row(1, 1, "red")], [row(1, 1, "red", "8"), row(4, 1, "blue")]]):
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    path = str(tmp_path / "sync")
    query = views.sync_sheets(stream, sheets.merger(path, *[lambda _, t=t: t for t in tables]), f"{tmp_path}/check", "1 second")
    query.processAllAvailable()
    query.stop()
    assert sorted((r.shop_id, r.price) for r in sheets.stock(spark, path, tables[0]).collect()) == [(1, 8.0), (3, 9.0), (4, 2.0)]
