"""Conversation repair against a plain search over edits, and whole conversations however they are cut into tasks."""

import functools
import hashlib
import random
import re
import zlib

import pytest

pytest.importorskip("quillspan.llm")
from quillspan.llm import op11_repair as m  # noqa: E402

NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NAMES = {"u": "user", "a": "assistant"}


def search(rows):
    """The least (cost, letters, messages) over edits with up to two insertions at any place."""

    @functools.cache
    def go(i, s, inserted):
        found = [(0, "", ())] if i == len(rows) and s in (0, 3) else []

        def add(rest, cost, letter, said):
            if rest:
                found.append((rest[0] + cost, letter + rest[1], (*said, *rest[2])))

        if i < len(rows):
            role, text, forced, cut = rows[i]
            add(go(i + 1, s, 0), 3, "D", ())
            if not forced:
                for r in "ua":
                    if r in NEXT[s]:
                        add(go(i + 1, NEXT[s][r], 0), 2 + cut, "R", (f"{NAMES[r]}:{text}",))
                if role[:1] in NEXT[s]:
                    add(go(i + 1, NEXT[s][role[:1]], 0), cut, "K", (f"{role}:{text}",))
        for r in "ua":
            if inserted < 2 and r in NEXT[s]:
                add(go(i, NEXT[s][r], inserted + 1), 2, "I", (f"{NAMES[r]}:",))
        return min(found, default=None)

    return go(0, 0, 0)


def plain(table):
    """The contract row by row, on (conv_id, turn, role, text)."""
    kept = {r[0]: [] for r in table}
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in table:
        role, text = show(role), show(text)
        fault = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        kept[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    out = set()
    for conv, rows in kept.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, count = set(), [], [0, 0, 0]
        for _, role, text in rows:
            end = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
            fault = 0 if not end else 1 if (role, text) in seen else 2 if end[0] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                count[fault] += 1
            marked.append((role, text, fault < 2, fault == 2))
        turns = {r[0] for r in rows} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, said = search(tuple(marked))
        out.add((conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return out


def case(seed, n):
    r = random.Random(seed)
    roles, texts = ["system", "user", "assistant", "user", "assistant", None, "", "tool"], ["Yes.", "No", "Why?", "", " \t", None, "Well. ", "é!", "ok ok"]
    rows = [(c, r.choice([None, *range(9)]), r.choice(roles), r.choice(texts)) for c in [None, *range(40)] for _ in range(r.randrange(1, n))]
    return rows + r.sample(rows, 20) + [(90, 0, "system", "Be kind."), (91, 5, "user", "Hi."), (91, 5, "user", "Hi.")]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_repair(spark):
    rows = case(3, 12)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{SCHEMA}, n long, _part string")
    got = {tuple(r) for r in m.repair(m.damage(docs), copies="copies").collect()}
    assert got == plain(rows) and len(got) == len({r[0] for r in rows})
    assert m.repair(m.damage(docs.limit(0)), copies="copies").count() == 0


def test_long_conversation_over_tasks(spark, monkeypatch):
    """One conversation holds most rows, and runs are short, so that all three levels decide."""
    monkeypatch.setattr(m, "RUN", 7)
    r = random.Random(5)
    rows = [(1, t, r.choice(["user", "assistant", "system", "tool"]), r.choice(["One.", "Two", "Three?", f"No {t}.", ""])) for t in range(240)] + case(4, 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, SCHEMA)
        got = {tuple(x) for x in m.repair(m.damage(docs), copies="copies").collect()}
        said = m.repair(docs, messages=True).filter("conv_id = 91").orderBy("message_no").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    import sys

    sys.setrecursionlimit(20_000)
    assert got == plain(rows)
    assert [(x.edit, x.role, x.text) for x in said] == [("K", "user", "Hi."), ("I", "assistant", "")]


def test_repeated_rows_need_no_room(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 100_000), (1, 1, "assistant", "Yes.", 1)], f"{SCHEMA}, k long")
    (x,) = m.repair(rows, copies="k").collect()
    assert (x.duplicate, x.illegal, x.cost) == (99_999, 99_999, 3 * 99_999) and x.audit == "K" + "D" * 99_999 + "K"
