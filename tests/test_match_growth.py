"""Best matches: work dealt out by text, and the wanted rows never sent to every task."""

import random

import pytest
from pyspark.sql import functions as F
from test_match import all_pairs, names

from marketlens.operators import match
from marketlens.operators.kept import kept


def tasks(spark, group):
    tracker = spark.sparkContext.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return [info.numTasks for info in map(tracker.getStageInfo, stages) if info]


def test_few_bytes_are_still_dealt_out(spark):
    known = spark.range(40).selectExpr("id", "concat('name ', id, ' of ', id * 7) AS text")
    wanted = spark.range(60).selectExpr("id AS row", "concat('nam ', id, ' off ', id * 7) AS text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.sparkContext.setJobGroup("dealt", "dealt")
    try:
        assert match.best_match(wanted, known).count() == 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.sparkContext.setJobGroup("", "")
    assert max(tasks(spark, "dealt")) >= 13


@pytest.mark.parametrize("few", [20_000, 3])
def test_wanted_rows_are_not_broadcast(spark, capsys, monkeypatch, few):
    monkeypatch.setattr(match, "FEW_ROWS", few, raising=False)
    known = spark.range(9).selectExpr("id", "concat('name ', id) AS text")
    wanted = kept(spark.range(5000).select(F.col("id").alias("row"), F.concat(F.lit("nam "), F.col("id") % 9).alias("text")))
    found = match.best_match(wanted, known)
    capsys.readouterr()
    found.explain()
    plan = capsys.readouterr().out
    assert "BuildLeft" not in plan and ("BroadcastHashJoin" if few > 9 else "SortMergeJoin") in plan
    assert sorted((r.row, r.id) for r in found.collect()) == [(i, i % 9) for i in range(5000)]


@pytest.mark.parametrize("characters", [200_000, 0])
def test_tasks_follow_the_meetings(spark, monkeypatch, characters):
    monkeypatch.setattr(match, "FEW_CHARACTERS", characters, raising=False)
    monkeypatch.setattr(match, "MEETINGS_A_TASK", 100, raising=False)
    known = spark.range(40).selectExpr("id", "concat('name ', id, ' of ', id * 7) AS text")
    wanted = spark.range(60).selectExpr("id AS row", "concat('nam ', id, ' off ', id * 7) AS text")
    group = f"followed {characters}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        match.best_match(wanted, known).count()
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert max(tasks(spark, group)) >= 20


@pytest.mark.parametrize(("least", "meetings"), [(0.0, 1_000_000), (0.0, 50), (0.35, 50)])
def test_a_large_index_gives_the_same_matches(spark, monkeypatch, least, meetings):
    monkeypatch.setattr(match, "FEW_CHARACTERS", 0, raising=False)
    monkeypatch.setattr(match, "MEETINGS_A_TASK", meetings, raising=False)
    rng = random.Random(5)
    known = list(enumerate(names(rng, 60) + ["aaaa", "aaaa", "xyz", ""]))
    wanted = list(enumerate([k[1:] + "b" for _, k in known[:40]] + names(rng, 30) + ["zzzz", "q", "", "x" * 300] + [k for _, k in known[:5]]))
    found = match.best_match(spark.createDataFrame(wanted, "row int, text string"), spark.createDataFrame(known, "id int, text string"), least)
    assert {r.row: (r.id, round(r.score, 9)) for r in found.collect()} == all_pairs(wanted, known, least)
