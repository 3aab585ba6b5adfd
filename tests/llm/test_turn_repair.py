"""Structure repair against plain Python, and that against every possible edit of short conversations."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from marketlens.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(5)
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"])
            text = rng.choice(["Yes.", "No!", "what", "a b. c", "open ", "Done? \t\n", " \n", "", None, f"turn {t}.", "é…", "naïve!"])
            rows.append((c if c != 70 else None, rng.choice([t, t, t, t + 2, None, 3]), role, text))
    for c, n in ((1000, 63), (1001, 64), (1002, 65), (1003, 700)):
        rows += [(c, t // 2, rng.choice(["user", "assistant"]), f"t {t % 90}{rng.choice('.!? x')}") for t in range(n)]
    rows += [(2000, 5, "user", "same.")] * 40 + [(2001, 1, "user", "w " * 200_000 + ".")]
    return rows


@pytest.fixture(scope="module")
def rows():
    return conversations()


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_brute_force(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"kind": F.lit("-"), "Digest": F.lit("-"), "later": F.lit("-"), "cost": F.lit(1)})
    same(turn_repair.op12(df), turn_repair.brute_force(rows))


def test_conversations_go_on_in_the_next_batch(rows):
    """Batches of a few rows: costs, audits and hashes are carried along, also where the ways to the states part."""
    undamaged = [r for r in rows if r[0] is None or r[0] < 2000]
    import pyarrow as pa

    sent = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in undamaged]
    first: dict = {}
    for c, t, r, x in sent:
        first[c, r, x] = min(first.get((c, r, x), (True, 1 << 60)), (t is not None, t or 0))
    sent.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3]))
    full = [(*r, False, (r[1] is not None, r[1] or 0) > first[r[0], r[2], r[3]]) for r in sent]
    names = ["conv_id", "turn", "role", "text", "absent", "later"]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in full[i : i + 50]], pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("absent", pa.bool_()), ("later", pa.bool_())])) for i in range(0, len(full), 50)]
    before = turn_repair.BATCH_ROWS
    try:
        for size in (3, 37, 100_000):
            turn_repair.BATCH_ROWS = size
            got = [tuple(r.values()) for b in turn_repair.repair_batches(iter(batches)) for r in b.to_pylist()]
            assert sorted(got, key=str) == sorted(turn_repair.brute_force(undamaged, damage=False), key=str)
    finally:
        turn_repair.BATCH_ROWS = before


def test_repaired_turns_have_the_hash(spark, rows):
    turns = turn_repair.damaged(spark.createDataFrame(rows, SCHEMA).repartition(4))
    repairs = turn_repair.repair(turns).cache()
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "role", "text"))), lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    got = {r.conv_id: r.h for r in turn_repair.repaired_turns(turns, repairs).groupBy("conv_id").agg(F.sha2(lines, 256).alias("h")).collect()}
    want = {r.conv_id: r.repaired_sha256 for r in repairs.collect() if set(r.audit) - {"D"}}
    assert got == want


def test_plain_python_finds_the_cheapest_of_all_edits():
    rng = random.Random(2)
    inserts = ["", "u", "a", "ua", "au"]
    names = {"u": "user", "a": "assistant", "s": "system", "t": "tool"}
    for n in (1, 2, 2, 2, 3, 3):
        for _ in range(8):
            turns = [(1, t, names[rng.choice("uaust")], rng.choice([f"x{t}.", f"y{t}", " "])) for t in range(n)]
            ways = []
            for _, _, role, text in turns:
                cut = 3 * (text[-1] not in ".!?")
                ways.append([("D", "", 4)] + ([] if text == " " else [("K", role[0], cut), ("R", "u", 3 + cut), ("R", "a", 3 + cut)]))
            found = []
            for way in itertools.product(*ways):
                for put in itertools.product(inserts, repeat=n + 1):
                    roles = put[0] + "".join(r + p for (_, r, _), p in zip(way, put[1:], strict=True))
                    if re.fullmatch("(s?(ua)+)?", roles):
                        audit = "I" * len(put[0]) + "".join(e + "I" * len(p) for (e, _, _), p in zip(way, put[1:], strict=True))
                        found.append((sum(c for _, _, c in way) + 3 * sum(map(len, put)), audit))
            (row,) = turn_repair.brute_force(turns, damage=False)
            assert min(found) == (row[6], row[7])


def test_empty_table(spark):
    assert turn_repair.op12(spark.createDataFrame([], SCHEMA)).collect() == []
