"""The catalogue's search, where no side is small enough to be broadcast."""

import re

from marketlens.plans import catalogue


def test_a_task_sorts_nothing_by_product(spark, data, capsys):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalogue._found(spark, data, q="r", state="ASIA", min_rating=60, in_stock=True)
        found.explain()
        plan = capsys.readouterr().out
        rows = {r.product_id for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not re.search(r"SortMergeJoin \[(product_id|p_partkey)", plan) and plan.count("part.parquet") == 1
    assert rows == {r.product_id for r in catalogue._found(spark, data, q="r", state="ASIA", min_rating=60, in_stock=True).collect()} and rows
