"""Structure repair of conversations: a recursive DuckDB query inside hash-partitioned batches.

Conversations are dealt to tasks by their id and come in order of turns. A task takes its rows in batches; a batch is cut into
chunks of CHUNK turns, and a recursive query advances one turn of all chunks at a time, keeping the cheapest edits and
their audit for each grammar state in which a chunk may begin and end. A second recursion joins the chunks of a conversation. A conversation that goes
on in the next batch takes along one cost, audit and hash for each state, never its rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_sql, cut, join_groups

#: Turns that the first recursion goes through one by one.
CHUNK = 64
#: A batch has at most so many rows, and about so many characters.
BATCH_ROWS, BATCH_CHARS = 20_000, 4 << 20
GAP = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

# Grammar (s?(ua)+)? : state 0 has nothing yet, 1 a system turn, 2 a user turn last, 3 an assistant turn last; 0 and 3 may end.
#: State after a turn with this initial, and the states in which it may stand.
AFTER = {"s": 1, "u": 2, "a": 3}
MAY_STAND = {"s": (0,), "u": (0, 1, 3), "a": (2,)}
#: What is inserted, or a turn rerolled to, in each state.
WANTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}
#: Edits with which a conversation may end in each state.
ENDINGS = {0: "", 1: "II", 2: "I", 3: ""}


def moves() -> list[tuple[int, str, int, int, str]]:
    """(state, need, next state, cost, edits) of one turn: need is a role's initial, * for any undeleted turn, D for a deleted one.

    An insert comes right before a kept or rerolled turn. Before a deleted one it would be no cheaper than after it, and D is less than I; two in a row
    lead to no state from which more may follow than from the one before, so they are cheapest nowhere but at an end.
    """
    out: list[tuple[int, str, int, int, str]] = []
    for state, role in WANTED.items():
        out.append((state, "D", state, DELETE, "D"))
        beyond = AFTER[role[0]]
        for at, cost, edit in ((state, 0, ""), (beyond, INSERT, "I")):
            out += [(state, i, AFTER[i], cost + KEEP, edit + "K") for i, where in MAY_STAND.items() if at in where]
            out.append((state, "*", AFTER[WANTED[at][0]], cost + REROLE, edit + "R"))
    return out


WALK = f"""
WITH RECURSIVE walk AS (
  SELECT chunk, entry, 0 AS i, entry AS state, struct_pack(cost := 0, audit := '') AS best FROM start
  UNION ALL
  SELECT w.chunk, w.entry, w.i + 1, m.next, min(struct_pack(cost := w.best.cost + m.cost + CASE WHEN t.truncated AND m.need <> 'D' THEN {TRUNCATED} ELSE 0 END, audit := w.best.audit || m.edits))
  FROM walk AS w JOIN turn AS t ON t.chunk = w.chunk AND t.i = w.i
  JOIN move AS m ON m.state = w.state AND (m.need = 'D' OR NOT t.doomed AND m.need IN ('*', t.initial))
  GROUP BY w.chunk, w.entry, w.i, m.next)
SELECT walk.chunk, entry, state, best.cost AS cost, best.audit AS audit FROM walk JOIN place ON place.chunk = walk.chunk AND place.n = walk.i
"""
FOLD = """
WITH RECURSIVE fold AS (
  SELECT part, 0 AS k, state, struct_pack(cost := cost, audit := mark) AS best FROM carried
  UNION ALL
  SELECT f.part, f.k + 1, e.state, min(struct_pack(cost := f.best.cost + e.cost, audit := f.best.audit || e.audit))
  FROM fold AS f JOIN place AS p ON p.part = f.part AND p.k = f.k JOIN edge AS e ON e.chunk = p.chunk AND e.entry = f.state
  GROUP BY f.part, f.k, e.state)
SELECT fold.part, state, best.cost, best.audit FROM fold JOIN (SELECT part, max(k) + 1 AS k FROM place GROUP BY part) AS last USING (part, k)
"""


def replay(state: int, edits: str, turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that edits leave from a state on."""
    turns = iter(turns)
    for edit in edits:
        role, text = (WANTED[state], "") if edit == "I" else next(turns)
        if edit == "D":
            continue
        if edit == "R":
            role = WANTED[state]
        state = AFTER[role[0]]
        yield role, text


class State:
    """The cheapest way to a grammar state: its cost, its edits, and the hash of what they leave."""

    def __init__(self, state: int = 0, cost: int = 0, audit: str = "", sha: Any = None, lines: int = 0) -> None:
        self.state, self.cost, self.audit, self.sha, self.lines = state, cost, audit, sha or hashlib.sha256(), lines

    def then(self, state: int, cost: int, edits: str, turns: list[tuple[str, str]]) -> State:
        sha, lines = self.sha.copy(), self.lines
        for role, text in replay(self.state, edits, turns):
            sha.update((b"\n" if lines else b"") + f"{role}:{text}".encode())
            lines += 1
        return State(state, cost, self.audit + edits, sha, lines)


class Conversation:
    """What a conversation takes along from batch to batch."""

    def __init__(self, conv: int | None) -> None:
        self.conv = conv
        self.turns: list[tuple[str, str]] = []  # of this batch
        self.faults: list[tuple[str, bool, bool]] = []  # of this batch: initial, has to be deleted, truncated
        self.states = [State()]
        self.least: int | None = None
        self.most = self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: tuple[int | None, str, str] | None = None

    def add(self, turn: int | None, role: str, text: str, later: bool) -> None:
        rest = text.rstrip(GAP)
        blank = not rest
        duplicate = not blank and (later or self.last == (turn, role, text))
        truncated = not blank and not duplicate and rest[-1] not in ".!?"
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.last is not None and self.last[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None:
            if self.least is None:
                self.least, self.most, self.distinct = turn, turn, 1
            elif turn != self.most:
                self.most, self.distinct = turn, self.distinct + 1
        self.last = (turn, role, text)
        self.turns.append((role, text))
        self.faults.append((role[:1], blank or duplicate, truncated))

    def advance(self, found: list[tuple[int, int, str]], ends: bool) -> None:
        """found: (state, cost, mark and edits) after this batch's turns; the mark says which state they come from. At its end only the best is worked out."""
        if ends:
            best = min(found, key=lambda x: (x[1] + INSERT * len(ENDINGS[x[0]]), self.states[int(x[2][0])].audit + x[2][1:] + ENDINGS[x[0]]))
            found = [(0, best[1] + INSERT * len(ENDINGS[best[0]]), best[2] + ENDINGS[best[0]])]
        self.states = [self.states[int(x[0])].then(state, cost, x[1:], self.turns) for state, cost, x in found]
        self.states.sort(key=lambda s: s.audit)
        self.turns, self.faults = [], []

    def row(self) -> tuple:
        best = min(self.states, key=lambda s: (s.cost + INSERT * len(ENDINGS[s.state]), s.audit + ENDINGS[s.state]))
        best = best.then(best.state, best.cost + INSERT * len(ENDINGS[best.state]), ENDINGS[best.state], [])
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, best.cost, best.audit, best.sha.hexdigest())


def solve(con: Any, parts: list[Conversation]) -> list[list[tuple[int, int, str]]]:
    """For each conversation (state, cost, mark and edits) after its turns of this batch, from the states that it has now."""
    turn, start, place, carried = [], [], [], []
    for p, part in enumerate(parts):
        carried += [(p, s.state, s.cost, str(mark)) for mark, s in enumerate(part.states)]
        for k in range(0, len(part.faults), CHUNK):
            chunk, rows = len(place), part.faults[k : k + CHUNK]
            place.append((chunk, p, k // CHUNK, len(rows)))
            start += [(chunk, e) for e in ([s.state for s in part.states] if k == 0 else WANTED)]
            turn += [(chunk, i, *row) for i, row in enumerate(rows)]
    tables = {
        "turn": (turn, ["chunk", "i", "initial", "doomed", "truncated"]), "start": (start, ["chunk", "entry"]), "place": (place, ["chunk", "part", "k", "n"]), "carried": (carried, ["part", "state", "cost", "mark"]),
    }
    for name, (rows, columns) in tables.items():
        con.register(name, pa.table(dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True))))
    con.execute(f"CREATE OR REPLACE TEMP TABLE edge AS {WALK}")
    out: list[list[tuple[int, int, str]]] = [[] for _ in parts]
    for p, state, cost, audit in con.execute(FOLD).fetchall():
        out[p].append((state, cost, audit))
    return out


def connect() -> Any:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB"})
    con.register("move", pa.table(dict(zip(["state", "need", "next", "cost", "edits"], map(list, zip(*moves(), strict=True)), strict=True))))
    return con


def repair_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, text, absent, later) of whole conversations in order -> a row for each conversation."""
    con = connect()
    parts: list[Conversation] = []
    rows = chars = 0

    def settle(whole: bool) -> list[tuple]:
        """Works out what has been gathered; the last conversation stays unless all rows have come."""
        with_turns = [p for p in parts if p.faults]
        for part, found in zip(with_turns, solve(con, with_turns) if with_turns else [], strict=True):
            part.advance(found, whole or part is not parts[-1])
        done = parts if whole else parts[:-1]
        out = [p.row() for p in done]
        del parts[: len(done)]
        return out

    def batch(done: list[tuple]) -> pa.RecordBatch:
        names = [c.split()[0] for c in OUT.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    for arrived in batches:
        for conv, turn, role, text, absent, later in zip(*(c.to_pylist() for c in arrived.columns), strict=True):
            if not parts or parts[-1].conv != conv:
                parts.append(Conversation(conv))
            if not absent:
                parts[-1].add(turn, role, text, later)
            rows, chars = rows + 1, chars + len(text)
            if rows >= BATCH_ROWS or chars >= BATCH_CHARS:
                if done := settle(False):
                    yield batch(done)
                rows = chars = 0
    if done := settle(True):
        yield batch(done)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, absent: by crc32 of `conv_id:turn` a row is dropped (absent), emptied, robbed of its `.!?`, repeated or made a user's.

    Null counts as one space in all four.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("absent"), F.explode(times).alias("_time")).drop("_time")


def with_later(turns: DataFrame) -> DataFrame:
    """turns with later: the same role and text stand at an earlier turn of the conversation (null is the earliest).

    Rows are combined by a digest before they are shuffled; only texts at several turns go on to a join, whose table is broadcast if it is small and dealt out by salts if not.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    rows = turns.withColumn("digest", F.unhex(F.left(F.sha2(key, 256), F.lit(32))))
    seen = rows.filter("NOT absent").groupBy("digest").agg(F.count_if(F.col("turn").isNull()).alias("nulls"), F.min("turn").alias("first"), F.max("turn").alias("last"))
    several = cut(seen.filter("first < last OR nulls > 0 AND first IS NOT NULL").select("digest", "nulls", "first"))
    later = F.coalesce((F.col("nulls") > 0) & F.col("turn").isNotNull() | (F.col("turn") > F.col("first")), F.lit(False))
    return join_groups(rows, several, "digest", "turn", "left").withColumn("later", later).select("conv_id", "turn", "role", "text", "absent", "later")


def in_order(turns: DataFrame, *more: str) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", *more, F.col("turn").asc_nulls_first(), "role", "text")


def repair(turns: DataFrame) -> DataFrame:
    """A row for each conv_id of (conv_id, turn, role, text, absent): faults, cost, audit and hash of the cheapest repair.

    Turns go by turn, null first, ties by role and text; rows without conv_id are one conversation; a null role or text counts as one space. A
    conversation of absent rows alone has zeros, no edits and the hash of nothing. Very long texts are read whole, a batch at a time; an
    empty table gives an empty one; other columns are left out. The hash goes through a conversation's text in order, so one task streams a
    conversation, however long; it holds a batch and four audits.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), said("role"), said("text"), "absent")
    return in_order(with_later(rows)).mapInArrow(repair_batches, OUT)


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, place from 0, role, text: the turns that the audits of `repairs` leave of the same turns."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = turns.filter("NOT absent").select(F.lit(1).alias("kind"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), said("role"), said("text"))
    heads = repairs.select(F.lit(0).alias("kind"), "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    return in_order(heads.unionByName(rows), "kind").mapInArrow(_replay_batches, "conv_id long, place long, role string, text string")


def _replay_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edits, at, state, place, conv = "", 0, 0, 0, None
    for batch in batches:
        out = []
        for kind, c, _, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if kind == 0:
                edits, at, state, place, conv = text, 0, 0, 0, c
                continue
            stop = at
            while edits[stop] == "I":
                stop += 1
            stop += 1
            if len(edits) - stop <= 2 and not edits[stop:].strip("I"):  # inserts at the end go with the last turn
                stop = len(edits)
            for new_role, new_text in replay(state, edits[at:stop], [(role, text)]):
                out.append((conv, place, new_role, new_text))
                state, place = AFTER[new_role[0]], place + 1
            at = stop
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["conv_id", "place", "role", "text"])


def op12(conversations: DataFrame) -> DataFrame:
    return repair(damaged(conversations))


def brute_force(rows: list[tuple], damage: bool = True) -> list[tuple]:
    """What op12 returns, from (conv_id, turn, role, text), a conversation at a time by a plain table over states."""
    import zlib

    said = lambda x: " " if x is None else str(x)
    convs: dict[int | None, list[tuple]] = {}
    for conv, turn, role, text in rows:
        role, text, kept = said(role), said(text), convs.setdefault(conv, [])
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20 if damage else 9
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        kept += [((turn is not None, turn or 0), "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = []
    for conv, turns in convs.items():
        turns.sort()
        numbers = {t[0][1] for t in turns if t[0][0]}
        seen: set[tuple[str, str]] = set()
        counts = [0, 0, 0]
        best: dict[int, tuple[int, str, tuple]] = {0: (0, "", ())}
        for _, role, text in turns:
            rest = text.strip(GAP)
            fault = 0 if not rest else 1 if (role, text) in seen else 2 if rest[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            ways: dict[int, list[tuple[int, str, tuple]]] = {}
            for state, (cost, audit, lines) in best.items():
                ways.setdefault(state, []).append((cost + 4, audit + "D", lines))
                if fault in (0, 1):
                    continue
                more = 3 if fault == 2 else 0
                other = "assistant" if state == 2 else "user"
                for s, c, a, x in ((state, cost, audit, lines), (3 if state == 2 else 2, cost + 3, audit + "I", (*lines, f"{other}:"))):
                    first = role[:1]
                    if first == "s" and s == 0 or first == "u" and s != 2 or first == "a" and s == 2:
                        ways.setdefault({"s": 1, "u": 2, "a": 3}[first], []).append((c + more, a + "K", (*x, f"{role}:{text}")))
                    new = "assistant" if s == 2 else "user"
                    ways.setdefault(3 if s == 2 else 2, []).append((c + 3 + more, a + "R", (*x, f"{new}:{text}")))
            best = {s: min(w) for s, w in ways.items()}
        ends = {0: (), 1: ("user:", "assistant:"), 2: ("assistant:",), 3: ()}
        cost, audit, lines = min((c + 3 * len(ends[s]), a + "I" * len(ends[s]), x + ends[s]) for s, (c, a, x) in best.items())
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


OP12_SQL = f"""
WITH RECURSIVE move(state, need, next, cost, edits) AS (VALUES {", ".join(map(str, moves()))}),
kind AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kind WHERE kind <> 0
  UNION ALL SELECT conv_id, turn, role, text FROM kind WHERE kind = 3),
row AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
seen AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS unended FROM row),
fault AS (SELECT *, NOT blank AND again AS duplicate, NOT blank AND NOT again AND unended AS truncated, before || initial NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
counted AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM fault GROUP BY conv_id),
walk AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, struct_pack(cost := 0, audit := '', lines := '') AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, w.i + 1, m.next, min(struct_pack(
    cost := w.best.cost + m.cost + CASE WHEN f.truncated AND m.need <> 'D' THEN {TRUNCATED} ELSE 0 END, audit := w.best.audit || m.edits,
    lines := w.best.lines || CASE WHEN m.edits LIKE 'I%' THEN CASE WHEN m.state = 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END ELSE '' END
      || CASE WHEN m.need = 'D' THEN '' ELSE chr(10) || CASE WHEN m.need <> '*' THEN f.role WHEN m.next = 2 THEN 'user' ELSE 'assistant' END || ':' || f.text END))
  FROM walk AS w JOIN fault AS f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
  JOIN move AS m ON m.state = w.state AND (m.need = 'D' OR NOT f.blank AND NOT f.duplicate AND m.need IN ('*', f.initial)) GROUP BY 1, 2, 3),
ending(state, cost, audit, lines) AS (VALUES (0, 0, '', ''), (1, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 3, 'I', chr(10) || 'assistant:'), (3, 0, '', '')),
best AS (
  SELECT w.conv_id, min(struct_pack(cost := w.best.cost + e.cost, audit := w.best.audit || e.audit, lines := w.best.lines || e.lines)) AS b
  FROM walk AS w JOIN ending AS e ON e.state = w.state LEFT JOIN counted AS c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(c.n, 0) GROUP BY w.conv_id)
SELECT best.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(b.cost AS BIGINT) AS cost, b.audit AS audit, sha256(substr(b.lines, 2)) AS repaired_sha256
FROM best LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM best.conv_id
"""
