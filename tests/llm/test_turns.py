"""Conversation repair against exhaustive search, and on odd tables."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from lexground.llm import turns
from lexground.llm.queries import SQL


def every_repair(rows):
    """(cost, audit) of all ways to edit ``rows`` with at most two insertions in one place, by plain enumeration."""
    best = None
    gaps = ["", "I", "II"]
    for edits in itertools.product("DKR", repeat=len(rows)):
        if any(e != "D" and f in ("blank", "duplicate") for e, (_, f) in zip(edits, rows, strict=True)):
            continue
        for inserted in itertools.product(gaps, repeat=len(rows) + 1):
            audit = "".join(g + e for g, e in itertools.zip_longest(inserted, edits, fillvalue=""))
            if audit.count("I") > 3:
                continue
            # Every role that an edit may leave, tried in all combinations.
            left, i = [], 0
            for e in audit:
                if e == "I":
                    left.append("ua")
                    continue
                if e != "D":
                    left.append(rows[i][0] if e == "K" else "ua")
                i += 1
            if not any(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in itertools.product(*left)):
                continue
            stay = sum(5 for e, (_, f) in zip(edits, rows, strict=True) if e != "D" and f == "truncated")
            cost = 2 * edits.count("D") + 5 * audit.count("I") + edits.count("R") + stay
            best = min(best or (cost, audit), (cost, audit))
    return best


def test_search_by_enumeration():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4):
        for _ in range(12):
            rows = [(rng.choice("ssuuaax"), rng.choice(["", "", "", "", "blank", "duplicate", "truncated"])) for _ in range(n)]
            assert turns.search(rows) == every_repair(rows), rows


def least(rows):
    """(cost, audit) by dynamic programming over whole audits."""
    held = {turns._START: (0, "")}

    def reach(states):
        for _ in range(2):
            for q, (c, a) in list(states.items()):
                to = turns._THEN[q]
                states[to] = min(states.get(to, (10**9, "")), (c + 5, a + "I"))
        return states

    for initial, fault in rows:
        new = {}
        for source, before in ((held, True), (reach(dict(held)), False)):
            for q, (c, a) in source.items():
                for e in "D" if before else "KR":
                    if step := turns._step(q, initial, fault, e):
                        new[step[1]] = min(new.get(step[1], (10**9, "")), (c + step[0], a + e))
        held = new
    return min(v for q, v in reach(held).items() if q in turns._ENDS)


def test_search_of_long_conversations():
    rng = random.Random(5)
    for n in (30, 400, 20_000):
        rows = [("sua"[(i % 2) + 1] if rng.random() < 0.9 else rng.choice("sua"), rng.choice([""] * 12 + ["blank", "duplicate", "truncated"])) for i in range(n)]
        assert turns.search(rows) == least(rows)


def by_hand(rows, line):
    """Audit and repaired digest of one conversation's rows after damage."""
    seen, coded = set(), []
    for _, role, text in line:
        kind = "blank" if not re.search("[^\x20\x09-\x0d]", text) else "duplicate" if (role, text) in seen else "" if re.search(r"[.!?][\x20\x09-\x0d]*\Z", text) else "truncated"
        seen.add((role, text))
        coded.append((role[:1], kind))
    cost, audit = turns.search(coded)
    lines = []
    for row, _, given in turns.roles(coded, audit):
        lines.append(f"{given or line[row][1]}:{'' if row is None else line[row][2]}")
    numbers = [t for t, _, _ in line if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(coded, coded[1:], strict=False))
    count = [sum(k == f for _, k in coded) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def harmed(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        line = out.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", " " if text is None else text) if kind == 2 else " " if text is None else text
            line += [(turn, "user" if kind == 4 else " " if role is None else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())) for c, v in out.items()}


def query(spark, rows):
    from pyspark.sql import functions as F

    found, repaired = turns.repair(turns.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, `role.x` string")))
    done = turns.digests(repaired).withColumnRenamed("conv", "of")
    return found.join(done, F.col("conv").eqNullSafe(F.col("of")), "left").collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_by_hand(spark, seed):
    rng = random.Random(seed)
    words = ["Yes.", "No!", "cut", "", " \t", None, "Really?\n", "Yes.", "x" * 3000 + "."]
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(words), "extra") for _ in range(500)]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"turn {t} " + "long " * 500 + ".", "extra") for t in range(600)]  # one long conversation
    rows += [(98, t, "user", "Same.", "extra") for t in range(300)]
    want = {c: by_hand(rows, line) for c, line in harmed([r[:4] for r in rows]).items()}
    none = hashlib.sha256(b"").hexdigest()
    got = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.sha256 or none) for r in query(spark, rows)}
    assert got == want


def test_texts_come_back_whole(spark):
    rows = [(7, 1, "user", "First.", ""), (7, 2, "user", "Second.", ""), (7, 4, "assistant", "Third.", "")]
    found, repaired = turns.repair(spark.createDataFrame([(*r[:4], False) for r in rows], "conv long, turn long, role string, text string, gone boolean"))
    assert [(r.gaps, r.cost, r.audit) for r in found.collect()] == [(1, 2, "DKK")]
    assert [(r.place, r.turn, r.role, r.text, r.edit) for r in repaired.collect()] == [(0, 2, "user", "Second.", "K"), (1, 4, "assistant", "Third.", "K")]


def test_no_rows(spark):
    assert query(spark, [(1, 1, "user", "a", "")])  # one row
    empty = turns.damage(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    found, repaired = turns.repair(empty)
    assert found.count() == 0 and turns.digests(repaired).count() == 0


def test_sql_twin_on_odd_rows(spark):
    rng = random.Random(9)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", None]), rng.choice(["Yes.", "cut", "", None, "No!", "b."])) for _ in range(120)]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    want = {c: by_hand(rows, line) for c, line in harmed(rows).items()}
    assert {r[0]: r[1:] for r in con.sql(SQL["op11_turns"]).fetchall()} == want
