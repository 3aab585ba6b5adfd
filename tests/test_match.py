"""Best matches by the gram index against all pairs, and dense numbers over many partitions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marketlens.operators import match
from marketlens.operators.numbering import numbered
from marketlens.operators.writes import insert_rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def all_pairs(wanted, known, least=0.0):
    first = {}
    for i, text in sorted(known):
        if text:
            first.setdefault(text, i)
    out = {}
    for row, text in wanted:
        scored = [(1.0 - distance(text, k) / max(len(text), len(k)), -i) for k, i in first.items()] if text else []
        score, i = max(scored, default=(0, 0))
        if score > 0 and score >= least - 1e-12:
            out[row] = (-i, round(score, 9))
    return out


def names(rng, n, alphabet="abcdef gh"):
    return ["".join(rng.choices(alphabet, k=rng.randint(1, 14))).strip() for _ in range(n)]


@pytest.mark.parametrize("least", [0.0, 0.35, 0.9])
def test_same_as_all_pairs(spark, least):
    rng = random.Random(8)
    known = list(enumerate(names(rng, 150) + ["aaaa", "aaaa", "xyz", ""]))
    near = [re.sub("[ae]", "", k, count=1) + rng.choice(["", "b"]) for _, k in known[:60]]
    wanted = list(enumerate(near + names(rng, 60) + ["zzzz", "q", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "", "x" * 300] + [k for _, k in known[:10]]))
    found = match.best_match(spark.createDataFrame(wanted, "row int, text string"), spark.createDataFrame(known, "id int, text string"), least)
    assert {r.row: (r.id, round(r.score, 9)) for r in found.collect()} == all_pairs(wanted, known, least)


def test_nothing_known_or_wanted(spark):
    some, none = spark.createDataFrame([(1, "abc")], "row int, text string"), spark.createDataFrame([], "id int, text string")
    assert match.best_match(some, none).collect() == []
    assert match.best_match(some.limit(0), spark.createDataFrame([(1, "abc")], "id int, text string")).collect() == []


def test_no_nested_loop_is_planned(spark, capsys):
    some = spark.createDataFrame([(1, "red widget"), (2, None)], "row int, name string")
    known = spark.createDataFrame([(7, "red widgets"), (8, "blue bolt")], "product_id int, name string")
    found = match.fuzzy_best(some, known)
    found.explain()
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, "red widget", 7, "red widgets", 91), (2, None, None, None, 0)]


def test_preview_of_an_import(spark):
    up = [(10, "Acme", "Red Widgt", "Lng", "$12.50 each", "12 boxes"), (20, " ", "", "long", "1", "1"), (30, None, "blue-bolt", None, "free", None), (40, "Acme", None, "?", "0", "x")]
    products = [(1, "Acme", "Red Widget"), (2, "Bolt Co", "Blue Bolt"), (3, "Acme", "Red Widget")]
    sizes = [(1, 11, "Long"), (1, 12, "Short"), (2, 21, "Wide")]
    df = match.import_preview(
        spark.createDataFrame(up, "position int, brand string, name string, size string, price string, quantity string"), spark.createDataFrame(products, "product_id int, brand string, name string"), spark.createDataFrame(sizes, "product_id int, size_id int, size_name string"),
    )
    got = {r.row: (r.product_id, r.match_name, r.confidence, r.size_id, r.size_confidence, r.price, r.quantity) for r in df.collect()}
    assert got == {0: (1, "Red Widget", 93, 11, 75, 12.5, 12), 1: (2, "Blue Bolt", 47, None, None, None, 0), 2: (1, "Red Widget", 27, None, None, None, 0)}


def test_numbers_are_dense_and_in_order(spark):
    rows = [(i % 5 if i % 11 else None, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        found = numbered(df, [F.col("a").asc_nulls_first(), F.col("b").desc()], "n")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = [(r.a, r.b) for r in sorted(found.collect(), key=lambda r: r.n)]
    assert [r.n for r in sorted(found.collect(), key=lambda r: r.n)] == list(range(1, 1001))
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1]))
    assert numbered(df.limit(0), [F.col("b")], "n").collect() == []


def test_inserted_rows_go_on_from_the_last_key(spark, capsys):
    table = spark.createDataFrame([(41, "x")], "id long, v string")
    new = insert_rows(table, spark.createDataFrame([("b",), ("a",), (None,)], "v string"), "id", ["v"])
    assert sorted(map(tuple, new.collect())) == [(41, "x"), (42, None), (43, "a"), (44, "b")]
    assert sorted(map(tuple, insert_rows(table.limit(0), spark.createDataFrame([("b",)], "v string"), "id", ["v"]).collect())) == [(1, "b")]


def test_sheet_rows_and_their_reasons(spark):
    products = spark.createDataFrame([(2, "ACME  Co", "Red Widget"), (1, "acme co", "red widget "), (3, "Acme Co", "Blue")], "product_id int, brand string, name string")
    sizes = spark.createDataFrame([(1, 10, "Long  one"), (2, 20, "Short"), (3, 30, "Wide")], "product_id int, size_id int, size_name string")
    sent = [
        (1, "Acme co", " red  WIDGET", "long one", "$3.50", " "), (2, "acme co", "red widget", "short", "1", "2"), (3, None, " ", "x", "1", "2"), (4, "acme co", None, "wide", "1", "2"),
        (5, "acme co", "green", "wide", "1", "2"), (6, "acme co", "blue", "wide", "free", "2"), (7, "acme co", "blue", "wide", "0", "2"), (8, "acme co", "blue", "WIDE", "1.2.3", "12 boxes"), (9, "acme co", "blue", " ", "1", "2"),
    ]
    found = match.sheet_lookup(spark.createDataFrame(sent, "position int, brand string, name string, size string, price string, quantity string"), products, sizes)
    got = {r.position: (r.reason, r.product_id, r.size_id, r.price, r.quantity) for r in found.collect()}
    assert got == {
        1: (None, 1, 10, 3.5, None), 2: ("size not in catalogue", 1, None, 1.0, 2), 4: ("missing", None, None, 1.0, 2), 5: ("not found", None, None, 1.0, 2),
        6: ("invalid price", 3, 30, None, 2), 7: ("invalid price", 3, 30, None, 2), 8: (None, 3, 30, 1.2, 12), 9: ("missing", 3, None, 1.0, 2),
    }
