"""Repair of conversations' structure: the cheapest edits that give roles of the form system? (user assistant)+, or nothing.

Edits and costs: Keep 0, Rerole to user or assistant 2, Delete 3 (blank rows and repeats must go), Insert an empty user or assistant
row 2; a truncated row that stays costs 1 more. Among edits of one cost the ASCII-least string of their initials wins.

One integer weighs a whole way through a conversation. Its high digits are the cost. Each row has a place of fixed width among
the low digits, which holds the letters of its edits (an insertion before the row, then the row's own), padded with zeros at the end. A
row's letters end with its own edit, so no row's letters begin with another's, and the integers' order is that of (cost, letters). So an
ordinary least-sum over a graph of rows and four states decides everything. Insertions stand directly before a row
that is not deleted or at the end: elsewhere they cost as much and their letters come later, and two in a row never pay.

Conversations of any length: rows are dealt by ranges of (conversation, turn, role, text), so that a long one lies in several tasks. A run of
``RUN`` rows, a task's piece of a conversation and a whole one are weighed in the same way, a piece by its least cost
and its order among the ways that begin in the same state: these orders are the digits of the next level. Where a conversation is cut by tasks, its
pieces' tables (16 numbers each) are settled first and its rows pass once more, in order, through one task that keeps nothing but a
hash, counts and the letters, as SHA-256 reads its text from the beginning to the end.

Cases: null ids are one conversation; a null turn comes first; null roles and texts are one space, so a null text is blank, and a
null or empty role, like any that does not begin with s, u or a, can't be kept as it is. Rows of one turn are ordered by role, then text. Equal rows
count each. A conversation without rows has zeros, no letters and the hash of nothing. Empty tables give an empty
result. Further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize, maybe_in, partitions, spread_join

#: Rows of a run, whose letters make one integer.
RUN = 128
_BLANK = " \t\n\x0b\x0c\r"
_LETTERS = "DIKR"  # in ASCII order: digits 1 to 4
#: States: nothing yet, after system, after user, after assistant. Roles' initials lead from one to the next.
_FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_NEXT = (2, 2, 3, 2)  # where an inserted or changed row leads
_NAMES = {1: "system", 2: "user", 3: "assistant"}
_code = lambda letters: sum((_LETTERS.index(x) + 1) << (3 * (1 - i)) for i, x in enumerate(letters))
_CODES = {_code(x): x for x in ("", "D", "K", "R", "ID", "IK", "IR", "I", "II")}
#: Cost and letters of the insertions that end a conversation.
_ENDS = {0: (0, 0), 3: (0, 0), 2: (2, _code("I")), 1: (4, _code("II"))}
#: The same where digits are orders.
_LATE_ENDS = {s: (cost, cost // 2) for s, (cost, _) in _ENDS.items()}

Steps = tuple[tuple[tuple[int, int, int], ...], ...]


@functools.cache
def row_steps(initial: str, forced: bool, cut: bool) -> Steps:
    """For each state, the ways over one row: the state after it, the cost, and the letters as digits."""
    ways: list[tuple[tuple[int, int, int], ...]] = []
    for state in range(4):
        found = []
        for before, s in (("", state), ("I", _NEXT[state])):
            found.append((s, 2 * len(before) + 3, _code(before + "D")))
            if not forced:
                found.append((_NEXT[s], 2 * len(before) + 2 + cut, _code(before + "R")))
                if initial in _FOLLOW[s]:
                    found.append((_FOLLOW[s][initial], 2 * len(before) + cut, _code(before + "K")))
        ways.append(tuple(found))
    return tuple(ways)


def least(steps: list[Steps], ends: dict[int, tuple[int, int]], width: int) -> tuple[list[int | None], list[list]]:
    """The least weight from each state over all steps to ``ends``, and the step taken from each state at each place."""
    n = len(steps)
    high = width * (n + 1)
    weights: list[int | None] = [(ends[s][0] << high) + ends[s][1] if s in ends else None for s in range(4)]
    taken = []
    for i in range(n - 1, -1, -1):
        place, row = width * (n - i), []
        for ways in steps[i]:
            row.append(min(((weights[t] + (cost << high) + (code << place), t, code) for t, cost, code in ways if weights[t] is not None), default=None))
        weights = [x and x[0] for x in row]
        taken.append(row)
    return weights, taken[::-1]


def walk(taken: list[list], state: int) -> tuple[list[int], list[int]]:
    """The codes of the way from a state, and the states after each step."""
    codes, states = [], []
    for row in taken:
        _, state, code = row[state]
        codes.append(code)
        states.append(state)
    return codes, states


def table(steps: list[Steps], width: int) -> tuple[Steps, dict[tuple[int, int], list[int]]]:
    """Many steps as one: the least cost between each two states, with its order among those from the same state; and the codes."""
    high = width * (len(steps) + 1)
    ways: list[list] = [[], [], [], []]
    paths = {}
    for t in range(4):
        weights, taken = least(steps, {t: (0, 0)}, width)
        for s, w in enumerate(weights):
            if w is not None:
                ways[s].append((w & ((1 << high) - 1), t, w >> high))
                paths[s, t] = walk(taken, s)[0]
    return tuple(tuple((t, cost, order + 1) for order, (_, t, cost) in enumerate(sorted(x))) for x in ways), paths


@functools.lru_cache(4096)
def solve(rows: tuple[tuple[str, bool, bool], ...]) -> tuple[int, ...]:
    """The codes of the cheapest edits of a whole conversation, one for each row."""
    runs = [[row_steps(*r) for r in rows[a : a + RUN]] for a in range(0, len(rows), RUN)]
    if len(runs) < 2:
        return tuple(walk(least(runs[0] if runs else [], _ENDS, 6)[1], 0)[0])
    tables = [table(r, 6) for r in runs]
    _, states = walk(least([t[0] for t in tables], _LATE_ENDS, 3)[1], 0)
    return tuple(c for (_, paths), s, t in zip(tables, [0, *states], states, strict=False) for c in paths[s, t])


def piece(rows: list[tuple[str, bool, bool]]) -> tuple[Steps, list[str]]:
    """A part of a conversation as one step, and for each row the codes of all 16 ways as characters."""
    tables = [table([row_steps(*r) for r in rows[a : a + RUN]], 6) for a in range(0, len(rows), RUN)]
    joined = table([t[0] for t in tables], 3)[0]
    columns = []
    for s in range(4):
        for t in range(4):
            if not any(x[0] == t for x in joined[s]):
                columns.append([0] * len(rows))
                continue
            _, states = walk(least([x[0] for x in tables], {t: (0, 0)}, 3)[1], s)
            columns.append([c for (_, paths), a, b in zip(tables, [s, *states], states, strict=False) for c in paths[a, b]])
    return joined, ["".join(chr(40 + c) for c in row) for row in zip(*columns, strict=True)]


def settle(pieces: list[Steps]) -> list[int]:
    """For each piece of a conversation, 4 times the state before it and the state after it."""
    states = walk(least(pieces, _LATE_ENDS, 3)[1], 0)[1]
    return [4 * s + t for s, t in zip([0, *states], states, strict=False)]


class _Conversation:
    """What is told of one conversation while its rows pass with the letters of their edits."""

    def __init__(self, conv_id: object, messages: list | None) -> None:
        self.conv_id, self.messages = conv_id, messages
        self.first = self.last = self.initial = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = self.kept = self.state = 0
        self.letters: list[str] = []
        self.hash = hashlib.sha256()

    def _put(self, role: str, text: str, edit: str) -> None:
        self.hash.update(f"{chr(10) if self.kept else ''}{role}:{text}".encode())
        if self.messages is not None:
            self.messages.append((self.conv_id, self.kept, edit, role, text))
        self.kept += 1

    def add(self, turn: int | None, role: str, text: str, n: int, seen: bool, letters: str) -> None:
        if n == 0:
            return
        if turn is not None and (self.last is None or turn != self.last):
            self.first, self.last, self.turns = (turn if self.first is None else self.first), turn, self.turns + 1
        initial, blank, forced, cut = marks(role, text, seen)
        self.illegal += (self.initial is not None and self.initial + initial not in ("su", "ua", "au")) + n - 1
        self.initial = initial
        if blank:
            self.blank += n
        else:
            self.duplicate += n - 1 + seen
            self.truncated += cut and not seen
        self.cost += 3 * (n - 1)
        self.letters += [letters, "D" * (n - 1)]
        for x in letters:
            if x == "D":
                self.cost += 3
            elif x == "K":
                self.state = _FOLLOW[self.state][initial]
                self._put(role, text, x)
                self.cost += cut
            else:
                self.state = _NEXT[self.state]
                self._put(_NAMES[self.state], "" if x == "I" else text, x)
                self.cost += 2 + (cut if x == "R" else 0)

    def done(self) -> tuple:
        for x in _CODES[_ENDS[self.state][1]]:
            self.add_end(x)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.letters), self.hash.hexdigest())

    def add_end(self, letter: str) -> None:
        self.state = _NEXT[self.state]
        self._put(_NAMES[self.state], "", letter)
        self.cost += 2
        self.letters.append(letter)


def marks(role: str, text: str, seen: bool) -> tuple[str, bool, bool, bool]:
    """A row's initial, and whether it is blank, must go, and is cut off."""
    end = text.rstrip(_BLANK)
    blank = not end
    return role[:1], blank, blank or seen, not blank and end[-1] not in ".!?"


_TOLD = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _schemas(kind: str) -> tuple[str, str, str]:
    told = f"conv_id {kind}, " + ", ".join(f"{x} long" for x in _TOLD) + ", audit string, repaired_sha256 string"
    messages = f"conv_id {kind}, message_no long, edit string, role string, text string"
    rows = "_piece long, _pos long, _turn long, _role string, _text string, _n long, _seen boolean, _codes string, _table array<long>"
    return told, messages, rows


def ordered(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: str | None) -> DataFrame:
    """Distinct rows with their number ``_n`` and ``_seen``, whether an earlier turn says the same, dealt and sorted by conversation and order."""
    n = F.col(copies).cast("long") if copies else F.lit(1).cast("long")
    here = n > 0
    put = lambda c: F.when(here, F.coalesce(F.col(c), F.lit(" ")))
    base = rows.select(F.col(conv_id).alias("conv_id"), F.when(here, F.col(turn)).cast("long").alias("_turn"), put(role).alias("_role"), put(text).alias("_text"), F.when(here, n).otherwise(F.lit(0).cast("long")).alias("_n"))
    base = materialize(base.groupBy("conv_id", "_turn", "_role", "_text").agg(F.sum("_n").alias("_n")))
    said = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("_role"), F.col("_role"), F.col("_text")), 256))
    when = F.struct(F.col("_turn").isNotNull(), F.col("_turn"))
    said_twice = base.filter("_n > 0").groupBy(said.alias("_again")).agg(F.min(when).alias("_first"), F.count("*").alias("n")).filter("n > 1")
    again = materialize(said_twice)
    base = maybe_in(base.withColumn("_said", said), F.col("_said"), again.select("_again"), "_maybe")
    met = spread_join(base.filter("_maybe"), again.drop("n"), "_said", "_again", again.select(F.col("_again").alias("_said"), "n"), F.col("_turn"))
    columns = ["conv_id", "_turn", "_role", "_text", "_n"]
    both = met.select(*columns, ((F.col("_n") > 0) & F.coalesce(when > F.col("_first"), F.lit(False))).alias("_seen")).unionAll(base.filter("NOT _maybe").select(*columns, F.lit(False).alias("_seen")))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "_turn", "_role", "_text")]
    return materialize(both).repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", copies: str | None = None, messages: bool = False) -> DataFrame:
    """What each conversation's repair is and costs, one row for each ``conv_id``; or, with ``messages``, the repaired conversations' rows.

    ``copies`` may name a column of how often a row stands; a row of 0 or null only says that there is such a conversation.
    """
    spark = rows.sparkSession
    dealt = ordered(rows, conv_id, turn, role, text, copies)
    told, said, kept = _schemas(dealt.schema["conv_id"].dataType.simpleString())
    out = said if messages else told
    names = [x.split()[0] for x in out.split(", ")]
    scan = functools.partial(_scan, schema=pa_schema(spark, f"{out}, {kept}"), messages=messages)
    found = materialize(dealt.select("conv_id", "_turn", "_role", "_text", "_n", "_seen", "_part").mapInArrow(scan, f"{out}, {kept}"))
    ways = found.filter("_table IS NOT NULL").select("conv_id", "_piece", "_table").groupBy("conv_id").applyInPandas(_settled, "_of long, _pair int")  # two pieces of a task at most
    rest = found.filter("_codes IS NOT NULL").join(F.broadcast(ways), F.col("_piece") == F.col("_of"))
    rest = rest.select("conv_id", "_turn", "_role", "_text", "_n", "_seen", F.substring("_codes", F.col("_pair") + 1, F.lit(1)).alias("_code"), "_piece", "_pos")
    rest = rest.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "_piece", "_pos")
    tell = functools.partial(_tell, schema=pa_schema(spark, out), messages=messages)
    return found.filter("_piece IS NULL").select(*names).unionAll(rest.mapInArrow(tell, out))


def pa_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _scan(batches: Iterator[pa.RecordBatch], schema: pa.Schema, messages: bool) -> Iterator[pa.RecordBatch]:
    """Repairs conversations that lie in one task, and weighs the pieces at its edges."""
    own = len(schema) - 9
    held: list[tuple] = []
    now, begun, pieces, part, out = None, False, 0, 0, []

    def close(edge: bool) -> None:
        shown = [(r[2][:1], *marks(r[2], r[3], r[5])[2:]) if r[4] else None for r in held]
        rows = tuple(x for x in shown if x is not None)
        empty = (None,) * own
        if edge:
            steps, codes = piece(list(rows))
            flat = [x for ways in steps for t in range(4) for x in next(((c, o) for s, c, o in ways if s == t), (-1, 0))]
            i = 2 * part + pieces
            out.append((now, *empty[1:], i, None, None, None, None, None, None, None, flat))
            told = iter(codes)
            for k, (r, x) in enumerate(zip(held, shown, strict=True)):
                out.append((now, *empty[1:], i, k, r[1], r[2], r[3], r[4], r[5], next(told) if x is not None else "(" * 16, None))
            return
        listed: list | None = [] if messages else None
        c = _Conversation(now, listed)
        codes = iter(solve(rows))
        for r, x in zip(held, shown, strict=True):
            if x is not None:
                c.add(r[1], r[2], r[3], r[4], r[5], _CODES[next(codes)])
        told = c.done()
        out.extend((*x, *(None,) * 9) for x in (listed if listed is not None else [told]))

    for batch in batches:
        for r in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if begun and r[0] != now:
                close(pieces == 0)
                pieces, held = 1, []
            begun, now, part = True, r[0], r[6]
            held.append(r)
        yield _batch(out, schema)
        out.clear()
    if begun:
        close(True)
    yield _batch(out, schema)


def _settled(pieces: pd.DataFrame) -> pd.DataFrame:
    """The states before and after each piece of one conversation: a row of 16 numbers and orders for each task that it lies in."""
    pieces = pieces.sort_values("_piece")
    steps = [tuple(tuple((t, int(f[8 * s + 2 * t]), int(f[8 * s + 2 * t + 1])) for t in range(4) if f[8 * s + 2 * t] >= 0) for s in range(4)) for f in pieces["_table"]]
    return pd.DataFrame({"_of": pieces["_piece"].astype("int64"), "_pair": pd.Series(settle(steps), index=pieces.index, dtype="int32")})


def _tell(batches: Iterator[pa.RecordBatch], schema: pa.Schema, messages: bool) -> Iterator[pa.RecordBatch]:
    """Conversations of several tasks, from their rows in order."""
    c: _Conversation | None = None
    out: list = []
    for batch in batches:
        for conv, turn, role, text, n, seen, code in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
            if c is None or c.conv_id != conv:
                if c is not None:
                    told = c.done()
                    out += [] if messages else [told]
                c = _Conversation(conv, out if messages else None)
            c.add(turn, role, text, n, seen, _CODES[ord(code) - 40])
        yield _batch(out, schema)
        out.clear()
    if c is not None:
        told = c.done()
        out += [] if messages else [told]
    yield _batch(out, schema)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32 of ``conv_id:turn`` and how often each stands; dropped ones stand 0 times."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    return conversations.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), copies="copies")


ORACLE = r"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda a, b: CASE WHEN (a & 1) = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS c FROM range(256) r(i))
), keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::UBIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS f FROM keyed, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), seen AS (
  SELECT *, substr(role, 1, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM numbered
), marked AS MATERIALIZED (
  SELECT *, shown = '' AS blank, shown <> '' AND again AS dup, shown <> '' AND NOT again AND right(shown, 1) NOT IN ('.', '!', '?') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM seen
), follow(s, initial, t) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), ins(s0, s, cost, letters, added) AS (
  SELECT s, s, 0, '', '' FROM range(4) r(s) UNION ALL SELECT * FROM (VALUES (0, 2, 2, 'I', 'user:'), (1, 2, 2, 'I', 'user:'), (2, 3, 2, 'I', 'assistant:'), (3, 2, 2, 'I', 'user:'))
), ways AS (
  SELECT s0 AS s, s AS t, cost + 3 AS cost, letters || 'D' AS letters, added, NULL AS initial, NULL AS role FROM ins
  UNION ALL SELECT s0, t, cost, letters || 'K', added, follow.initial, 'own' FROM ins JOIN follow USING (s)
  UNION ALL SELECT s0, t, cost + 2, letters || 'R', added, NULL, CASE t WHEN 2 THEN 'user' ELSE 'assistant' END FROM ins JOIN follow USING (s) WHERE follow.initial <> 's'
), dp AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': '', 'said': NULL::VARCHAR} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT d.conv_id, m.i, w.t, min({'cost': d.best.cost + w.cost + CASE WHEN m.cut AND w.role IS NOT NULL THEN 1 ELSE 0 END, 'audit': d.best.audit || w.letters,
    'said': nullif(concat_ws(chr(10), d.best.said, nullif(w.added, ''), CASE w.role WHEN 'own' THEN m.role || ':' || m.text ELSE w.role || ':' || m.text END), '')})
  FROM dp d JOIN marked m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.i = d.i + 1 JOIN ways w ON w.s = d.s AND (w.initial IS NULL OR w.initial = m.initial) AND (w.role IS NULL OR NOT (m.blank OR m.dup))
  GROUP BY d.conv_id, m.i, w.t
), told AS (
  SELECT c.conv_id, count(m.i) AS n, coalesce(max(m.turn) - min(m.turn) + 1 - count(DISTINCT m.turn), 0) AS gaps, count(*) FILTER (m.blank) AS blank, count(*) FILTER (m.dup) AS duplicate, count(*) FILTER (m.cut) AS truncated, count(*) FILTER (m.illegal) AS illegal
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id
), last AS (
  SELECT t.conv_id, min({'cost': d.best.cost + e.cost, 'audit': d.best.audit || e.letters, 'said': nullif(concat_ws(chr(10), d.best.said, e.added), '')}) AS best
  FROM told t JOIN dp d ON d.conv_id IS NOT DISTINCT FROM t.conv_id AND d.i = t.n JOIN (VALUES (0, 0, '', NULL), (3, 0, '', NULL), (2, 2, 'I', 'assistant:'), (1, 4, 'II', 'user:' || chr(10) || 'assistant:')) e(s, cost, letters, added) ON e.s = d.s GROUP BY t.conv_id
)
SELECT t.conv_id, gaps::BIGINT AS gaps, blank::BIGINT AS blank, duplicate::BIGINT AS duplicate, truncated::BIGINT AS truncated, illegal::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit, sha256(coalesce(best.said, '')) AS repaired_sha256
FROM told t JOIN last l ON l.conv_id IS NOT DISTINCT FROM t.conv_id
"""
