"""Repairs against trying every sequence of edits."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from gavelworks.llm import conversations
from gavelworks.llm.conversations import cheapest, damaged, repair_conversations, repaired_turns, repairs

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def every_edit(rows):
    """(cost, audit, turns) of all edits of (role, text, fault), with two inserts in a row at most."""

    def go(i, inserts, cost, audit, turns):
        if i == len(rows):
            yield cost, audit, turns
        if inserts < 2:
            for role in ("user", "assistant"):
                yield from go(i, inserts + 1, cost + 2, audit + "I", [*turns, (role, "")])
        if i < len(rows):
            role, text, fault = rows[i]
            yield from go(i + 1, 0, cost + 3, audit + "D", turns)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                yield from go(i + 1, 0, cost + more, audit + "K", [*turns, (role, text)])
                for new in ("user", "assistant"):
                    yield from go(i + 1, 0, cost + 2 + more, audit + "R", [*turns, (new, text)])

    return min(x for x in go(0, 0, 0, "", []) if GRAMMAR.fullmatch("".join(role[:1] or "?" for role, _ in x[2])))


def plain(rows):
    """What the query gives for one conversation's rows (turn, role, text) after damage."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    judged, seen = [], set()
    for _, role, text in rows:
        black = text.rstrip(" \t\n\x0b\x0c\r")
        if not black:
            fault = "blank"
        elif (role, text) in seen:
            fault = "duplicate"
        else:
            fault = "fine" if black[-1] in ".!?" else "truncated"
        seen.add((role, text))
        judged.append((role, text, fault))
    cost, audit, turns = every_edit(judged)
    numbers = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
        **{f: sum(x[2] == f for x in judged) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest(),
    }


def conversations_of(seed, n, most=4):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(draw.randrange(1, most + 1)):
            turn = draw.choice([turn, turn, turn, turn * 2, None])
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = draw.choice(["One.", "Two!", "cut off", "One.", " \t\x0b", "", None, "ünï?\n", f"n {turn}."])
            rows.append((conv if conv else None, turn, role, text))
    return rows


def by_id(frame):
    return {r.conv_id: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in frame.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_every_edit(spark, seed):
    rows = conversations_of(seed, 30, 3)
    got = by_id(repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    assert set(got) == {r[0] for r in rows}
    for conv, values in got.items():
        assert values == plain([r[1:] for r in rows if r[0] == conv]), conv


@pytest.mark.parametrize("block", [1, 3])
def test_blocks_of_any_length_give_the_same(spark, monkeypatch, block):
    rows = conversations_of(3, 40, 12)
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = by_id(repair_conversations(frame))
    monkeypatch.setattr(conversations, "BLOCK", block)
    assert by_id(repair_conversations(frame)) == whole


def plain_search(rows, start, end):
    """The best (cost, audit) to each state, a row at a time, without bounds."""
    inserts = {0: [("", 0), ("I", 2), ("II", 3)], 1: [("", 1), ("I", 2), ("II", 3)], 2: [("", 2), ("I", 3)], 3: [("", 3), ("I", 2)]}
    reached = {start: (0, "")}
    for row in [*rows, None]:
        ahead = [(c + 2 * len(x), a + x, q2) for q, (c, a) in reached.items() for x, q2 in inserts[q]]
        reached = {}
        for c, a, q in ahead:
            if row is None:
                steps = [(c, a, q)]
            else:
                cut = row.isupper() and row != "D"
                steps = [(c + 3, a + "D", q)]
                if row != "D":
                    steps.append((c + 2 + cut, a + "R", 3 if q == 2 else 2))
                    if (row.lower(), q) in {("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)}:
                        steps.append((c + cut, a + "K", {"s": 1, "u": 2, "a": 3}[row.lower()]))
            for c2, a2, q2 in steps:
                if q2 not in reached or (c2, a2) < reached[q2]:
                    reached[q2] = c2, a2
    return reached.get(end)


def test_search_between_all_states():
    draw = random.Random(4)
    for _ in range(300):
        rows = "".join(draw.choice("DsuaxSUAXuauaua") for _ in range(draw.randrange(0, 14)))
        for start in range(4):
            for end in range(4):
                assert cheapest(rows, start, end) == plain_search(rows, start, end), (rows, start, end)


def test_long_conversations():
    draw = random.Random(5)
    rows = "".join(draw.choice("DsuaxSUAXuauaua") for _ in range(conversations.BLOCK))
    for end in range(4):
        assert cheapest(rows, 0, end) == plain_search(rows, 0, end)


def test_system_turn_stays_only_in_front():
    assert cheapest("sua", 0, 3) == (0, "KKK")
    assert cheapest("uasua", 0, 3) == (3, "KKDKK")
    assert cheapest("s", 0, 0) == (3, "D")


def test_damage_by_the_crc(spark):
    rows = [(c, t, r, x) for c in [*range(40), None] for t in [0, 1, None] for r, x in [("system", "A. b! c?")]]
    got = sorted(map(str, map(tuple, damaged(spark.createDataFrame(rows, SCHEMA)).collect())))
    want = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if kind == 4 else role, {1: "", 2: "A b c"}.get(kind, text))
        want += [] if kind == 0 else [row] * (2 if kind == 3 else 1)
    assert got == sorted(map(str, want))
    assert any("'user'" in w for w in map(str, want)) and len(want) != len(rows)


def test_turns_after_repair_and_conversations_without_rows(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hello?")], SCHEMA).withColumn("place", frame_lit())
    turns = repaired_turns(frame, repairs(frame))
    assert [tuple(r)[1:] for r in turns.orderBy("place").collect()] == [
        (0, "user", "Hi."),
        (1, "assistant", "Hello?"),
    ]
    nothing = repair_conversations(frame.filter("false"), frame)
    row = nothing.first().asDict()
    assert row.pop("repaired_sha256") == hashlib.sha256().hexdigest()
    assert row == {"conv_id": 1, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": ""}
    assert repair_conversations(frame.filter("false")).count() == 0


def frame_lit():
    from pyspark.sql import functions as F

    return F.lit("a column of the same name")
