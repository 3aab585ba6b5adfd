"""Queries over their whole input, by brute force."""

import re
from collections import defaultdict

from marketlens.plans import files
from marketlens.roles import role


def test_listings_are_told_apart_by_their_whole_text(spark, tmp_path):
    head = "same licence line " * 30
    texts = [(1, head + "one"), (2, head + "two"), (3, head.upper() + "-- ONE!"), (4, "short"), (5, "Short."), (6, "a!"), (7, None)]
    spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = files.QUERIES["union_dedup_first_wins"](spark, str(tmp_path)).collect()
    assert sorted((r.source_rank, r.doc_id) for r in found) == [(0, 4), (1, 1), (1, 2)]


def test_listings_of_the_given_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    both = [(0, r.doc_id, r.text) for r in docs if r.n_chars < 500] + [(1, r.doc_id, r.text) for r in docs]
    first = {}
    for rank, doc, text in sorted(both, key=lambda x: x[:2]):
        key = re.sub("[^a-z0-9]", "", (text or "").lower())
        if len(key) >= 3:
            first.setdefault(key, (rank, doc))
    found = files.QUERIES["union_dedup_first_wins"](spark, data).collect()
    assert sorted((r.source_rank, r.doc_id) for r in found) == sorted(first.values())


def test_every_stock_row_is_looked_up(spark, data):
    stock, products, shops = (role(spark, data, n).collect() for n in ("stock", "product", "shop"))
    names, first, known = {r.product_id: r.name for r in products}, {}, {r.shop_id for r in shops}
    for p in sorted(names):
        first.setdefault(names[p].lower(), p)
    want = defaultdict(lambda: [0, 0, 0])
    for r in stock:
        if r.product_id in names:
            product = None if r.product_id % 5 == 0 else first[names[r.product_id].lower()]
            shop = r.shop_id if r.shop_id in known else None
            price = r.price if r.quantity is not None and r.quantity > 10 else None
            reason = "unknown product" if product is None else "unknown shop" if shop is None else "no price" if price is None else "matched"
            want[reason] = [a + b for a, b in zip(want[reason], (1, product is not None, shop or 0), strict=True)]
    found = {r.reason: [r.n, r.products, r.shops] for r in files.QUERIES["normalized_key_match"](spark, data).collect()}
    assert found == want


def test_ratings_of_all_orders_are_upserted(spark, data):
    table, latest = {}, {}
    for r in sorted(role(spark, data, "item").collect(), key=lambda r: r.item_id):
        if r.item_id % 3 != 2:
            table[r.user_id, r.product_id] = max(r.quantity, table.get((r.user_id, r.product_id), r.quantity))
        if r.item_id % 3 != 0:
            latest[r.user_id, r.product_id] = r.quantity
    found = files.QUERIES["upsert_keep_latest"](spark, data).collect()
    assert sorted(map(tuple, found)) == sorted((*k, v) for k, v in (table | latest).items())


def test_all_edges_are_worked_on(spark, data):
    edges = {tuple(r) for r in role(spark, data, "follow").select("user_id", "shop_id").collect()}
    found = {n: sorted(map(tuple, files.QUERIES[n](spark, data).select("user_id", "shop_id").collect())) for n in ("upsert_do_nothing", "toggle_edges")}
    assert found == {"upsert_do_nothing": sorted(edges), "toggle_edges": sorted(e for e in edges if sum(e) % 3 != 1)}


def test_import_goes_over_all_shops(spark, data):
    stock = sorted(role(spark, data, "stock").collect(), key=lambda r: r.stock_id)
    table, added, updated, skipped = {}, 0, 0, 0
    for r in stock:
        key = (r.shop_id, r.product_id, r.size_id)
        if (r.shop_id + r.product_id) % 3 != 2:
            table[key] = max(r.price, table.get(key, r.price))
    for r in stock:
        key = (r.shop_id, r.product_id, r.size_id)
        if (r.shop_id + r.product_id) % 3 == 0:
            continue
        if r.quantity is None:
            skipped += 1
            continue
        added, updated = added + (key not in table), updated + (key in table)
        table[key] = r.price + 1
    assert files.QUERIES["null_safe_upsert_counts"](spark, data).first().asDict() == {"added": added, "updated": updated, "skipped": skipped}
    found = files.QUERIES["null_safe_upsert_rows"](spark, data).collect()
    assert sorted(map(str, ((r.shop_id, r.product_id, r.size_id, r.price) for r in found))) == sorted(str((*k, v)) for k, v in table.items())
