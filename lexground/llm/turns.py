"""Conversation structure repair by iterative-deepening A*.

The rows of a conversation, in order of their turns, are read against the pattern ``(s?(ua)+)?`` of role initials. Each row is
kept (K, free), given the role that the pattern needs (R, 1) or deleted (D, 2); empty rows are inserted where the pattern needs one
(I, 5). Blank and duplicate rows have to be deleted, and a truncated row that stays costs 5 more. The search is depth-first,
in ASCII order of the edits' initials, under a bound on cost that grows from round to round, so the first accepting path is the
cheapest and, of equally cheap ones, the ASCII-least. What a path still needs at least is the cost of the rest of the rows if the
conversation might end after any of them; states that have failed are held with the least cost they failed at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .common import bound_batches, materialise

#: Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: States of the pattern: nothing yet, after s, after u, after a. The role each needs next, and the state after that role.
_START, _S, _U, _A = range(4)
_NEEDS, _THEN = ("user", "user", "assistant", "user"), (_U, _U, _A, _U)
_ENDS = (_START, _A)
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _step(state: int, initial: str, fault: str, edit: str) -> tuple[int, int] | None:
    """(cost, next state) of an edit that uses up a row; None where it isn't allowed."""
    if edit == "D":
        return DELETE, state
    if fault in ("blank", "duplicate"):
        return None
    more = TRUNCATED if fault == "truncated" else 0
    if edit == "R":
        return REROLE + more, _THEN[state]
    if initial == _NEEDS[state][0]:
        return KEEP + more, _THEN[state]
    return (KEEP + more, _S) if initial == "s" and state == _START else None


def _rest(rows: list[tuple[str, str]]) -> list[list[int]]:
    """For each row and state, what the rows from there on cost at least: the rule about how a conversation ends is left out."""
    out = [[0] * 4]
    for initial, fault in reversed(rows):
        after = out[-1]
        here = [min(c + after[s] for e in "DKR" if (step := _step(q, initial, fault, e)) for c, s in [step]) for q in range(4)]
        for _ in range(2):  # up to two inserted rows lead from any state to any that they can reach
            here = [min(c, INSERT + here[_THEN[q]]) for q, c in enumerate(here)]
        out.append(here)
    return out[::-1]


def search(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of ``rows``, pairs of role initial and fault ('' for none)."""
    rest, n = _rest(rows), len(rows)
    bound = rest[0][_START]
    while True:
        over, failed, audit = None, {}, []
        stack = [(0, _START, 0, iter("DIKR"))]
        while stack:
            i, state, cost, edits = stack[-1]
            if i == n and state in _ENDS:
                return cost, "".join(audit)
            for edit in edits:
                if edit == "I":
                    price, to, at = INSERT, _THEN[state], i
                elif i < n and (step := _step(state, *rows[i], edit)):
                    (price, to), at = step, i + 1
                else:
                    continue
                least = cost + price + rest[at][to]
                if least > bound:
                    over = least if over is None else min(over, least)
                elif failed.get((at, to), bound + 1) > cost + price:
                    audit.append(edit)
                    stack.append((at, to, cost + price, iter("DIKR")))
                    break
            else:
                failed[i, state] = cost
                stack.pop()
                if audit:
                    audit.pop()
        bound = over  # deleting all rows is always allowed, so there is one


def roles(rows: list[tuple[str, str]], audit: str) -> list[tuple[int | None, str, str | None]]:
    """What an audit does, in order: (row or None for an insertion, edit, role that is given or None for the row's own)."""
    state, i, out = _START, 0, []
    for edit in audit:
        if edit == "I":
            out.append((None, edit, _NEEDS[state]))
            state = _THEN[state]
            continue
        if edit != "D":
            out.append((i, edit, _NEEDS[state] if edit == "R" else None))
        state = _step(state, *rows[i], edit)[1]
        i += 1
    return out


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows damaged by crc32 of ``conv:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes
    its role ``user``. Columns ``conv``, ``turn``, ``role``, ``text`` and ``gone``, which is true for dropped rows: these stay in the table, so
    that no conversation is lost. Nulls in id, turn (as text), role and text count as one space."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col))
    named = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)])
    held = rows.select(conv.alias("conv"), turn.alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), (F.crc32(named.cast("binary")) % 20).alias("kind"))
    new = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    once = held.select("conv", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    return once.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("kind", "copy")


def _spaced(pattern: str) -> str:
    return pattern.replace("~", r"\x20\x09-\x0D")


def _coded(rows: DataFrame) -> DataFrame:
    """Rows without their texts: what tells equal texts apart, and the faults that a row has on its own."""
    text: Column = F.coalesce("text", F.lit(" "))
    blank = ~text.rlike(_spaced("[^~]"))
    return rows.select(
        "conv",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.md5(text).alias("digest"),
        F.when(blank, "blank").when(~text.rlike(_spaced(r"[.!?][~]*\z")), "truncated").otherwise("").alias("fault"),
        F.coalesce("gone", F.lit(False)).alias("gone"),
    )


_AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_EDIT = "turn {turn}, role string, digest string, place int, edit string, given string"


def _audited(turns: list, rolled: list[str], digests: list[str], faults: list[str]) -> tuple[dict, list[dict]]:
    """The audit of one conversation, and the edits of the rows that stay or come in."""
    seen, rows = set(), []
    for role, digest, fault in zip(rolled, digests, faults, strict=True):
        again = (role, digest) in seen
        seen.add((role, digest))
        rows.append((role[:1], "duplicate" if again and fault != "blank" else fault))
    cost, audit = search(rows)
    numbers = [t for t in turns if t is not None]
    count = [sum(f == kind for _, f in rows) for kind in ("blank", "duplicate", "truncated")]
    illegal = sum((a[0], b[0]) not in _LEGAL for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    out, place = [], 0
    for row, edit, given in roles(rows, audit):
        if row is None:
            out.append({"place": place, "edit": edit, "given": given})
        else:
            out.append({"turn": turns[row], "role": rolled[row], "digest": digests[row], "place": place, "edit": edit, "given": given})
        place += 1
    return {"gaps": gaps, "blank": count[0], "duplicate": count[1], "truncated": count[2], "illegal": illegal, "cost": cost, "audit": audit}, out


def audits(rows: DataFrame) -> DataFrame:
    """One row for each conversation, and one for each edit of a row that stays or is inserted: see ``repair``. A conversation's rows
    without their texts, some hundred bytes each, are in one task."""
    conv, turn = rows.schema["conv"].dataType.simpleString(), rows.schema["turn"].dataType.simpleString()
    schema = f"conv {conv}, {_EDIT.format(turn=turn)}, {_AUDIT}"
    arrow = rows.sparkSession.createDataFrame([], schema).toArrow().schema
    order = ["conv", F.asc_nulls_first("turn"), "role", "digest"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now, begun, ready = ([], [], [], []), None, False, []

        def close() -> None:
            found, edits = _audited(*held)
            ready.append({"conv": now, **found})
            ready.extend({"conv": now, **e} for e in edits)
            for x in held:
                x.clear()

        for batch in batches:
            for conv, *values, gone in zip(*[batch.column(c).to_pylist() for c in ("conv", "turn", "role", "digest", "fault", "gone")], strict=True):
                if begun and conv != now:
                    close()
                now, begun = conv, True
                if not gone:
                    for x, v in zip(held, values, strict=True):
                        x.append(v)
            if ready:
                yield pa.RecordBatch.from_pylist(ready, schema=arrow)
                ready.clear()
        if begun:
            close()
            yield pa.RecordBatch.from_pylist(ready, schema=arrow)

    return _coded(rows).repartition("conv").sortWithinPartitions(*order).mapInArrow(read, schema)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows) of ``rows(conv, turn, role, text, gone)``, as ``damage`` makes them; rows that are ``gone`` only name their
    conversation.

    Audits: ``conv``, ``gaps`` (turns missing between the first and the last), ``blank``, ``duplicate``, ``truncated`` (rows by their first
    fault), ``illegal`` (neighbours whose role initials are not su, ua or au), ``cost`` and ``audit`` (the edits' initials in order).
    Repaired rows: ``conv``, ``place`` (from 0), ``turn`` (null for inserted ones), ``role``, ``text``, ``edit`` (I, K or R); those of a
    conversation lie in one partition, in order.

    Null ids are one conversation, null turns come first, null roles and texts count as one space, rows of one turn follow by role and
    the MD5 of the text. Rows that repeat are duplicates. Texts may be of any length: they are sorted by Spark, and one batch
    is in memory at a time. Empty tables give empty results; other columns are not read.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    held = materialise(audits(rows), "turns-audits")
    found = held.where("audit IS NOT NULL").select("conv", *[c.split()[0] for c in _AUDIT.split(", ")])
    # Each edit goes right before the first of the rows that it means; insertions follow the edit before them.
    edits = held.where("audit IS NULL").select("conv", "turn", "role", "digest", "place", "edit", "given", F.lit(None).cast("string").alias("text"))
    ahead = edits.where("edit <> 'I'").withColumn("kind", F.lit(0))
    texts = rows.where(~F.coalesce("gone", F.lit(False))).withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    texts = texts.select("conv", "turn", "role", F.md5("text").alias("digest"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("edit"), F.lit(None).cast("string").alias("given"), "text", F.lit(1).alias("kind"))
    # Inserted rows have no place among the turns: a conversation's few are listed once, ahead of its rows.
    added = edits.where("edit = 'I'").withColumn("kind", F.lit(-1))
    stream = added.unionByName(ahead).unionByName(texts).withColumn("first", F.col("kind") >= 0)
    placed = stream.repartition("conv").sortWithinPartitions("conv", "first", F.when(~F.col("first"), F.col("place")), F.asc_nulls_first("turn"), "role", "digest", "kind")
    schema = f"conv {rows.schema['conv'].dataType.simpleString()}, place int, turn {rows.schema['turn'].dataType.simpleString()}, role string, text string, edit string"
    arrow = spark.createDataFrame([], schema).toArrow().schema

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, coming, at, edit, out = None, False, [], 0, None, []

        def insert(place: int | None) -> None:
            nonlocal at
            while at < len(coming) and (place is None or coming[at][0] < place):
                out.append({"conv": now, "place": coming[at][0], "role": coming[at][1], "text": "", "edit": "I"})
                at += 1

        for batch in slices(batches, "text"):
            for row in batch.to_pylist():
                if not begun or row["conv"] != now:
                    insert(None)
                    now, begun, coming, at, edit = row["conv"], True, [], 0, None
                if row["kind"] == -1:
                    coming.append((row["place"], row["given"]))
                elif row["kind"] == 0:
                    insert(row["place"])
                    edit = row
                elif edit and all(row[c] == edit[c] for c in ("turn", "role", "digest")):
                    out.append({"conv": now, "place": edit["place"], "turn": row["turn"], "role": edit["given"] or row["role"], "text": row["text"], "edit": edit["edit"]})
                    edit = None
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
            out.clear()
        insert(None)
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return found, placed.mapInArrow(write, schema)


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, joined by newlines, of rows that lie as ``repair`` returns them. A conversation
    of which no row is left has no digest here."""
    schema = f"conv {repaired.schema['conv'].dataType.simpleString()}, sha256 string"
    arrow = repaired.sparkSession.createDataFrame([], schema).toArrow().schema

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv", "role", "text")], strict=True):
                if state is not None and conv == now:
                    state.update(b"\n")
                else:
                    if state is not None:
                        done.append({"conv": now, "sha256": state.hexdigest()})
                    now, state = conv, hashlib.sha256()
                state.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv": now, "sha256": state.hexdigest()}], schema=arrow)

    return repaired.mapInArrow(read, schema)
