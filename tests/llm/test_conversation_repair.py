"""Conversation repair against a plain dynamic programme over whole audit strings."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from tastemap.llm import conversation_repair as cr

TEXTS = ["Hello there.", "And you?", "cut off", "", " \n", "Hello there.", "x!  ", "é. ", "🙂"]


def plain(rows):
    """``rows`` of one conversation: (turn, role, text)."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows),
                  key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
    turns = {t for known, t, _, _ in rows if known}
    seen, items, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        stripped = text.strip(" \t\n\r\x0b\x0c")
        fault = ("blank" if not stripped else "duplicate" if (role, text) in seen
                 else "truncated" if stripped[-1] not in ".!?" else None)
        seen.add((role, text))
        items.append((role, text, fault))
        if fault:
            faults[fault] += 1
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    takes = {0: "u", 1: "u", 2: "a", 3: "u"}
    names = {"u": "user", "a": "assistant"}
    best = {(len(items), 0): (0, "", ()), (len(items), 1): (4, "II", ("user:", "assistant:")),
            (len(items), 2): (2, "I", ("assistant:",)), (len(items), 3): (0, "", ())}
    for i in range(len(items) - 1, -1, -1):
        role, text, fault = items[i]

        def then(cost, letter, line, state):
            c, audit, lines = best[state]
            return cost + c, letter + audit, line + lines

        eaten = {}
        for q in range(4):
            options = [then(3, "D", (), (i + 1, q))]
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                if role[:1] in follow[q]:
                    options.append(then(extra, "K", (f"{role}:{text}",), (i + 1, follow[q][role[:1]])))
                options.append(then(2 + extra, "R", (f"{names[takes[q]]}:{text}",), (i + 1, follow[q][takes[q]])))
            eaten[q] = min(options)
        best.update({(i, q): eaten[q] for q in range(4)})
        for _ in range(4):
            for q in range(4):
                best[i, q] = min(best[i, q], then(2, "I", (f"{names[takes[q]]}:",), (i, follow[q][takes[q]])))
    cost, audit, lines = best[0, 0]
    initials = [role[:1] for role, _, _ in items]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults["blank"], faults["duplicate"], faults["truncated"],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def compare(spark, rows, **options):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r[1:]) for r in cr.repair_conversations(df, **options).collect()}
    talks = {}
    for conv, *row in rows:
        talks.setdefault(conv, []).append(tuple(row))
    assert got == {conv: plain(talk) for conv, talk in talks.items()}
    return got


def draw_rows(seed, conversations, longest):
    draw = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for k in range(draw.randint(1, longest)):
            rows.append((conv if conv else None, draw.choice([k, k, k, 2 * k, None]),
                         draw.choice(["user", "assistant"] * 4 + ["system", "tool", "", None]),
                         draw.choice([*TEXTS, f"{k}.", f"{k}?", f"{k}", None])))
    return rows


def test_against_whole_strings(spark):
    got = compare(spark, draw_rows(3, 400, 9))
    shape = re.compile(r"[DIKR]*")
    assert all(shape.fullmatch(v[6]) for v in got.values())
    assert {c for v in got.values() for c in v[6]} == set("DIKR")


def test_state_crosses_batches_and_backpointers_spill(spark, monkeypatch):
    monkeypatch.setattr(cr, "READ_BYTES", 16)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        compare(spark, draw_rows(4, 3, 400), spill_bytes=64)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_backpointers_come_back_reversed(monkeypatch):
    monkeypatch.setattr(cr, "READ_BYTES", 8)
    for n in (0, 1, 7, 8, 9, 100):
        kept = cr.Backpointers(20)
        for i in range(n):
            kept.add(i)
        assert list(kept.backwards()) == list(range(n))[::-1]


def test_one_giant_conversation_repeats_and_very_long_texts(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"{k}. " * (20_000 if k == 7 else 1)) for k in range(6000)]
    rows += [(2, 0, "user", "Hi."), (2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")] + [(3, None, None, None)] * 3
    got = compare(spark, rows)
    assert got[1][5] == 0 and got[1][6] == "K" * 6000
    assert got[2][6] == "KDK" and got[3][6] == "DDD"


def test_empty_table_extra_columns_and_rows_that_are_gone(spark):
    empty = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert cr.repair_conversations(empty).collect() == []
    rows = spark.createDataFrame([("a", 1, "user", "Hi.", 0, "x"), ("b", 1, "user", "Hi.", 1, "y")],
                                 "conv_id string, turn int, role string, text string, phase int, _tm_code string")
    got = {r.conv_id: r for r in cr.repair_conversations(rows, live=F.col("phase") == 1).collect()}
    assert tuple(got["a"])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert (got["b"].cost, got["b"].audit) == (2, "KI")


def test_damage(spark):
    rows = [(c, t, "assistant", f"A. B! {t}?") for c in range(30) for t in range(20)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        role, text = (" " if x is None else x for x in (role, text))
        hit = zlib.crc32(key.encode()) % 20
        row = (c, t, "user" if hit == 4 else role, "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text, hit != 0)
        want += [row] * (2 if hit == 3 else 1)
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in cr.damaged(df).collect())
