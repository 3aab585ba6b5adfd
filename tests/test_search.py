"""Searches by grams against a scan, seek paging against the sorted table, collated order."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marketlens.operators import trigrams
from marketlens.operators.relational import collated
from marketlens.operators.seek import Key, pages, seek

QUERIES = ["a", "AB", "abc", "bca b", "%", "", "_", "a%c", "a_c", "%%b_", "x\\%y", "ΑΣ", "é", "É", "no such text at all", "abcabcabcabcabcabcab", "a'b", "%zz%a"]


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("abcABC é", k=rng.randint(0, 14))), "".join(rng.choices("abcz_%", k=3))) for i in range(400)]
    rows += [(900, None, "abc"), (901, "ΑΣΑ", None), (902, "x%y a'b", ""), (903, None, None), (904, "abc" * 9, "zz")]
    return spark.createDataFrame(rows, "id int, a string, b string")


@pytest.mark.parametrize("kind", ["like", "contains"])
def test_same_rows_as_a_scan(spark, texts, tmp_path, kind):
    trigrams.write_index(texts, "id", ["a", "b"], f"{tmp_path}/index", kind)
    for q in QUERIES:
        scan = F.coalesce(F.col("a").like(f"%{q}%"), F.lit(False)) | F.coalesce(F.col("b").like(f"%{q}%"), F.lit(False)) if kind == "like" else F.coalesce(F.lower("a").contains(q.lower()), F.lit(False)) | F.coalesce(F.lower("b").contains(q.lower()), F.lit(False))
        want = sorted(r.id for r in texts.filter(scan).collect())
        assert sorted(r.id for r in trigrams.search(spark, f"{tmp_path}/index", texts, "id", ["a", "b"], q, kind).collect()) == want, q


def test_only_the_grams_folders_are_read(spark, texts, tmp_path, capsys):
    trigrams.write_index(texts, "id", ["a"], f"{tmp_path}/index")
    trigrams.search(spark, f"{tmp_path}/index", texts, "id", ["a"], "abca").explain("formatted")
    plan = capsys.readouterr().out
    assert re.search(r"PartitionFilters: \[.*folder", plan) and re.search(r"PushedFilters: \[.*In\(gram, \[abc,bca\]\)", plan)


KEYS = [[Key("x", True, True), Key("id")], [Key("x", False, False), Key("y", True, False), Key("id", True)], [Key("x", True, False), Key("id")], [Key("x", False, True), Key("y", False, True), Key("id")]]


@pytest.mark.parametrize("keys", KEYS)
def test_pages_one_after_another_are_the_sorted_table(spark, keys):
    rng = random.Random(2)
    df = spark.createDataFrame([(i, rng.choice([None, 1, 2, 3]), rng.choice([None, 0.5, 1.5])) for i in range(60)], "id int, x int, y double")
    whole = [r.id for r in df.orderBy(*[k.order() for k in keys]).collect()]
    got, last = [], None
    while rows := seek(df, keys, 7, last).collect():
        got += [r.id for r in rows]
        last = rows[-1]
    assert got == whole
    numbered = pages(df, keys, 25, 9).collect()
    assert [r.id for r in sorted(numbered, key=lambda r: r.page)] == whole and {r.page for r in numbered} == {1, 2, 3}


def test_the_bound_reaches_the_scan(spark, data, capsys):
    df = spark.read.parquet(f"{data}/part.parquet").select("p_partkey", "p_retailprice")
    keys = [Key("p_retailprice", True, True), Key("p_partkey")]
    last = seek(df, keys, 3).collect()[-1]
    seek(df, keys, 3, last).explain("formatted")
    assert "LessThanOrEqual(p_retailprice" in capsys.readouterr().out


def test_collated_order(spark):
    names = ["b", "B", "a", "A", "é", "e", "Ea", "ea", "", "É", "z", "Z", "f"]
    df = collated(spark.createDataFrame([(n,) for n in names], "n string").repartition(3), ["n"], "rank")
    assert [r.n for r in sorted(df.collect(), key=lambda r: r.rank)] == ["", "a", "A", "b", "B", "e", "é", "É", "ea", "Ea", "f", "z", "Z"]
