"""Structure repair of conversations: the cheapest edits that give a system turn at most, then user and assistant in turn.

Rows are ``conv_id, turn, role, text``. A conversation is read by turn (null first), rows of one turn by role and then by
the digest of their text. A row's first fault counts: *blank* (no character but white space), *duplicate* (role and text
seen earlier), *truncated* (last such character not ``.``, ``!`` or ``?``). Edits are Keep (cost 0), Rerole to user or
assistant (2), Delete (3; the only one for blank and duplicate rows) and Insert of an empty turn of user or assistant (2);
a truncated row that stays adds 1. What results has role initials ``(s?(ua)+)?``. Of the cheapest edits the ones whose
initials read first in ASCII are taken.

Two prefixes of edits over the same rows that cost the same are never one the beginning of the other, as the initials
alone give the cost. So of prefixes that reach the same row and state only the best (cost, initials) can lead to the best
whole, and a conversation may be cut anywhere: ``BLOCK`` turns of a conversation make a block, blocks are searched apart
from each of the four states to each of the four, and their results are chained. A long conversation is thereby searched by
many tasks. Only its final answer is as long as itself, one letter a row; and texts of one conversation are digested one
after another by a task that streams them, since SHA-256 has no other order. All rows that share one turn of a conversation
lie in one block; rows without a turn are dealt out by role and digest.

Null role and text count as one space, a null ``conv_id`` is a conversation like any other, rows that are there twice are
duplicates of each other, other columns are not read, and no rows give no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelworks.session import written

BLOCK = 128
WHITE = " \t\n\x0b\x0c\r"
# States: nothing yet, after the system turn, after a user, after an assistant. The last is where an answer may end.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
# What an inserted or reroled turn is after each state, and the state it leads to.
NEXT_ROLE = ("user", "user", "assistant", "user")
NEXT_STATE = (USER, USER, ASSISTANT, USER)
_FAR = 1 << 60


# ------------------------------------------------------------------ the search
# A row is one letter: D if it has to go, else its initial (s, u, a, or x for any other), in upper case if truncated.


def _keeps(row: str, state: int) -> int | None:
    """The state after a row that keeps its role, if it can."""
    if row == "s":
        return SYSTEM if state == EMPTY else None
    if row == "u":
        return USER if state != USER else None
    if row == "a":
        return ASSISTANT if state == USER else None
    return None


def _turns_left(rows: str, end: int, system: bool) -> list[tuple[int, int]]:
    """Costs that no edits of the rows from each on can undercut, when a user or an assistant turn is due.

    With ``system`` the bound lets system turns stay anywhere, without it nowhere.
    """
    due = 1 if end == USER else 0
    low = [(0, INSERT) if due == 0 else (INSERT, 0)]
    for row in reversed(rows):
        after = low[-1]
        if row == "D":
            both = [after[0] + DELETE, after[1] + DELETE]
        else:
            more, kind = (TRUNCATED if row.isupper() else 0), row.lower()
            both = [min(after[p] + DELETE, after[1 - p] + REROLE + more) for p in (0, 1)]
            if kind == "s" and system:
                both = [min(both[p], after[p] + more) for p in (0, 1)]
            elif kind == "u":
                both[0] = min(both[0], after[1] + more)
            elif kind == "a":
                both[1] = min(both[1], after[0] + more)
        low.append((min(both[0], both[1] + INSERT), min(both[1], both[0] + INSERT)))
    return low[::-1]


def _bounds(rows: str, end: int) -> list[tuple[int, ...]]:
    """For each row and state, a lower bound of the cost from there to ``end``."""
    n = len(rows)
    if end == EMPTY:  # everything goes
        return [(DELETE * (n - i), _FAR, _FAR, _FAR) for i in range(n + 1)]
    if end == SYSTEM:  # everything goes but one
        return [(DELETE * (n - i - 1) if i < n else _FAR, DELETE * (n - i), _FAR, _FAR) for i in range(n + 1)]
    # Only before the first turn may a system turn still stay.
    first, later = _turns_left(rows, end, "s" in rows.lower()), _turns_left(rows, end, False)
    return [(first[i][0], later[i][0], later[i][1], later[i][0]) for i in range(n + 1)]


def cheapest(rows: str, start: int, end: int) -> tuple[int, str] | None:
    """Cost and initials of the best edits that lead from one state to the other, by depth-first branch and bound.

    The stack holds prefixes, the likeliest on top. A prefix is left when its cost and the bound of what follows exceed the
    incumbent's cost, or equal it with initials that already read later, or when a better prefix was at its node.
    """
    bound = _bounds(rows, end)
    best: tuple[int, str] | None = None
    reached: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, start, 0, "")] if bound[0][start] < _FAR else []
    while stack:
        at, state, cost, audit = stack.pop()
        if best is not None:
            low = cost + bound[at][state]
            if low > best[0] or (low == best[0] and audit > best[1][: len(audit)]):
                continue
        known = reached.get((at, state))
        if known is not None and known <= (cost, audit):
            continue
        reached[at, state] = cost, audit
        if at == len(rows) and state == end and (best is None or (cost, audit) < best):
            best = cost, audit
        moves = [("I", at, NEXT_STATE[state], INSERT)]
        if at < len(rows):
            row = rows[at]
            moves.append(("D", at + 1, state, DELETE))
            if row != "D":
                more, kept = (TRUNCATED if row.isupper() else 0), _keeps(row.lower(), state)
                moves.append(("R", at + 1, NEXT_STATE[state], REROLE + more))
                if kept is not None:
                    moves.append(("K", at + 1, kept, more))
        ahead = [(cost + c + bound[i][q], letter, i, q, cost + c) for letter, i, q, c in moves if bound[i][q] < _FAR]
        for _, letter, i, q, c in sorted(ahead, reverse=True):
            stack.append((i, q, c, audit + letter))
    return best


@lru_cache(1 << 14)
def _between_states(rows: str) -> tuple[list[int], list[str]]:
    """The best edits from each state to each: 16 costs, -1 where there are none, and 16 audits."""
    found = [cheapest(rows, start, end) or (-1, "") for start in STATES for end in STATES]
    return [c for c, _ in found], [a for _, a in found]


def chained(reached: dict[int, tuple[int, str]], costs: list[int], audits: list[str]) -> dict[int, tuple[int, str]]:
    """The best edits up to each state, one block further."""
    out: dict[int, tuple[int, str]] = {}
    for start, (cost, audit) in reached.items():
        for end in STATES:
            more = costs[4 * start + end]
            if more >= 0:
                new = cost + more, audit + audits[4 * start + end]
                if end not in out or new < out[end]:
                    out[end] = new
    return out


# ------------------------------------------------------------------ rows


def _facts(rows: DataFrame) -> DataFrame:
    """Columns that decide on a row, without its text."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    black = F.rtrim(text, F.lit(WHITE))
    initial = F.substring(role, 1, 1)
    return rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.sha2(text, 256).alias("digest"),
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        F.when(black == "", "b").when(~F.right(black, F.lit(1)).isin(".", "!", "?"), "t").otherwise(".").alias("fault"),
    )


def _left(rows: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    """Left join in which missing keys are equal."""
    more = more.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(more, same, "left").drop(*[f"_{k}" for k in keys])


def _blocks(facts: DataFrame) -> DataFrame:
    """A row for each block: initials and faults in order, and what it knows of its turns."""
    seen = (
        facts.filter("fault <> 'b'")
        .groupBy("conv_id", "role", "digest")
        .agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    rows = _left(facts, seen, "conv_id", "role", "digest")
    rows = rows.withColumn("later", F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)))
    no_turn = F.col("turn").isNull()
    rows = rows.withColumns(
        {
            "block": F.expr(f"floor(turn / {BLOCK}D)"),
            "role_part": F.when(no_turn, F.col("role")),
            "digest_part": F.when(no_turn, F.substring("digest", 1, 2)),
        }
    )
    row = F.struct("turn", "role", "digest", "initial", "fault", "later")
    grouped = rows.groupBy("conv_id", "block", "role_part", "digest_part").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    again = (
        "x.later or (i > 0 and x.turn <=> rows[i - 1].turn and x.role = rows[i - 1].role and x.digest = rows[i - 1].digest)"
    )
    turns = "array_distinct(transform(filter(rows, x -> x.turn is not null), x -> x.turn))"
    return grouped.select(
        "conv_id",
        "block",
        "role_part",
        "digest_part",
        F.expr("array_join(transform(rows, x -> x.initial), '')").alias("initials"),
        F.expr(
            f"array_join(transform(rows, (x, i) -> if(x.fault = 'b', 'b', if({again}, 'd', x.fault))), '')"
        ).alias("faults"),
        F.expr(f"cast(size({turns}) as long)").alias("turns"),
        F.expr(f"array_min({turns})").alias("first_turn"),
        F.expr(f"array_max({turns})").alias("last_turn"),
    )


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs, audits = [], []
        for initials, faults in zip(batch.column("initials").to_pylist(), batch.column("faults").to_pylist()):
            rows = "".join(
                "D" if fault in "bd" else (initial.upper() if fault == "t" else initial)
                for initial, fault in zip(initials, faults)
            )
            c, a = _between_states(rows)
            costs.append(c)
            audits.append(a)
        arrays = [*batch.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "costs", "audits"])


LEGAL = ("su", "ua", "au")
STATS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Conversation:
    """What is known of a conversation after some of its blocks."""

    def __init__(self, conv_id):
        self.conv_id, self.reached = conv_id, {EMPTY: (0, "")}
        self.counts = dict.fromkeys(STATS, 0)
        self.last, self.turns, self.span = "", 0, (None, None)

    def add(self, block: dict) -> None:
        self.reached = chained(self.reached, block["costs"], block["audits"])
        initials = self.last + block["initials"]
        self.counts["illegal"] += sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
        self.last = initials[-1:]
        for name, letter in (("blank", "b"), ("duplicate", "d"), ("truncated", "t")):
            self.counts[name] += block["faults"].count(letter)
        self.turns += block["turns"]
        if block["first_turn"] is not None:
            low, high = self.span
            self.span = (
                block["first_turn"] if low is None else min(low, block["first_turn"]),
                block["last_turn"] if high is None else max(high, block["last_turn"]),
            )

    def row(self) -> tuple:
        cost, audit = min(self.reached[q] for q in (EMPTY, ASSISTANT) if q in self.reached)
        low, high = self.span
        gaps = 0 if low is None else high - low + 1 - self.turns
        return (self.conv_id, *(self.counts | {"gaps": gaps, "cost": cost}).values(), audit)


def repairs(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation; the audit tells the edits."""
    facts = written(_facts(rows), "turns")
    blocks = _blocks(facts)
    searched = blocks.mapInArrow(
        _searched,
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema)
        + ", costs array<long>, audits array<string>",
    )
    ordered = searched.repartition("conv_id").sortWithinPartitions("conv_id", "block", "role_part", "digest_part")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Conversation | None = None
        kind_of_id = None
        for batch in batches:
            kind_of_id, done = batch.schema.field("conv_id").type, []
            for block in batch.to_pylist():
                if now is None or now.conv_id != block["conv_id"]:
                    done += [] if now is None else [now.row()]
                    now = _Conversation(block["conv_id"])
                now.add(block)
            yield out(done, kind_of_id)
        if now is not None:
            yield out([now.row()], kind_of_id)

    names = ["conv_id", *STATS, "audit"]

    def out(done: list[tuple], kind_of_id) -> pa.RecordBatch:
        columns = list(zip(*done)) or [[] for _ in names]
        types = [kind_of_id, *[pa.int64()] * len(STATS), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return ordered.mapInArrow(join_blocks, f"conv_id {kind}, {', '.join(f'{c} long' for c in STATS)}, audit string")


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """``conv_id, place, role, text``: the turns after the edits, each conversation's in order and in one partition.

    ``audits`` has the edits of each conversation, from :func:`repairs` over the same rows.
    """
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    turns = rows.select(
        "conv_id",
        F.lit(1).alias("part"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.sha2(text, 256).alias("digest"),
        text.alias("text"),
    )
    blank = F.lit(None)
    edits = audits.select(
        "conv_id",
        F.lit(0).alias("part"),
        blank.cast("long").alias("turn"),
        blank.cast("string").alias("role"),
        blank.cast("string").alias("digest"),
        F.col("audit").alias("text"),
    )
    ordered = (
        edits.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")
    )
    kind = rows.schema["conv_id"].dataType.simpleString()

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, audit, at, state, place = None, "", 0, EMPTY, 0
        for batch in batches:
            done: list[tuple] = []

            def put(role: str, text: str) -> None:
                nonlocal place
                done.append((conv_id, place, role, text))
                place += 1

            def inserts() -> None:
                nonlocal at, state
                while audit[at : at + 1] == "I":
                    put(NEXT_ROLE[state], "")
                    state, at = NEXT_STATE[state], at + 1

            columns = [batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text")]
            for conv, part, role, text in zip(*columns):
                if part == 0:
                    conv_id, audit, at, state, place = conv, text, 0, EMPTY, 0
                    inserts()
                    continue
                letter, at = audit[at], at + 1
                if letter == "K":
                    put(role, text)
                    state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
                elif letter == "R":
                    put(NEXT_ROLE[state], text)
                    state = NEXT_STATE[state]
                inserts()
            out = list(zip(*done)) or [[], [], [], []]
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], names=["conv_id", "place", "role", "text"]
            )

    return ordered.mapInArrow(edit, f"conv_id {kind}, place long, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` over ``role:text``, joined by newlines, of turns as :func:`repaired_turns` deals them."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, sha, kind_of_id = None, None, None
        for batch in batches:
            kind_of_id = batch.schema.field("conv_id").type
            done = []
            for conv, place, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")]):
                if place == 0:
                    done += [] if sha is None else [(conv_id, sha.hexdigest())]
                    conv_id, sha = conv, hashlib.sha256()
                sha.update(f"{'' if place == 0 else chr(10)}{role}:{text}".encode())
            yield out(done, kind_of_id)
        if sha is not None:
            yield out([(conv_id, sha.hexdigest())], kind_of_id)

    def out(done: list[tuple], kind_of_id) -> pa.RecordBatch:
        ids, values = list(zip(*done)) or [[], []]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, kind_of_id), pa.array(values, pa.string())], names=["conv_id", "repaired_sha256"]
        )

    return turns.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")


def repair_conversations(rows: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """Faults, edits and the digest of the repaired text of each conversation.

    ``conv_ids`` may name more conversations than have rows; those get zeros, no edits and the digest of an empty text.
    """
    found = written(repairs(rows), "repairs")
    turns = digests(repaired_turns(rows, found))
    ids = (rows if conv_ids is None else conv_ids).select("conv_id").distinct()
    out = _left(_left(ids, found, "conv_id"), turns, "conv_id")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in STATS]
    nothing = hashlib.sha256().hexdigest()
    return out.select(
        "conv_id",
        *zero,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults by the CRC of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes out its
    sentence ends, 3 repeats it, 4 makes it a user's. Nulls count as one space, in ids for the CRC only."""
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1])) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    hurt = hurt.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return hurt.drop("copy")
