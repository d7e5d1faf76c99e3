"""Repair of the structure of conversations at the least cost.

A conversation's rows become those of `(system? (user assistant)+)?` by keeping, rerolling, deleting and inserting. An automaton of four
states reads the rows from the last to the first, so every (row, state) is a node of a DAG, and its value is one integer: the high digits
are the least cost from there to the end, the low ones the audit letters of that way, in positional digits of fixed width, the first
letter highest and zeros after the last. An edge adds its cost to the high digits, moves the letters behind its own by one digit, and puts its own
letter in front. So the smallest integer is the least cost and, among equals, the ASCII-least audit, and a plain minimum decides everything.

Rows are sorted inside tasks that hold whole conversations. A conversation passes twice in a row: first as flags of a byte each, from which the
audit follows, then as texts, which are hashed one by one; so its texts never lie in memory together. The integers have nine bits a row:
the work on one conversation grows with the square of its rows (400 rows: 20 ms; 20,000 rows: about two seconds).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswind.llm.common import ddl

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"
#: Digits of three bits, in the order of the letters.
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
#: States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: (state before, role initial) -> state after.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state after the next user or assistant turn, by the state before it.
NEXT = (USER, USER, ASSISTANT, USER)
#: Pairs of initials that may stand side by side.
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

REPAIRS = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def least_repair(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and audit for rows of (role initial, fault: blank, duplicate, truncated or empty)."""
    digits = 3 * len(rows) + 2  # two insertions between rows at most: more would come back to the same state
    top = 3 * digits
    ones, none = (1 << top) - 1, 1 << (top + 64)

    def edge(cost: int, letter: str, rest: int) -> int:
        return rest if rest >= none else (((rest >> top) + cost) << top) + (LETTERS[letter] << (top - 3)) + ((rest & ones) >> 3)

    def inserted(value: list[int]) -> list[int]:
        for _ in range(2):
            value = [min(v, edge(INSERT, "I", value[to])) for v, to in zip(value, NEXT, strict=True)]
        return value

    value = inserted([0, none, none, 0])
    for initial, fault in reversed(rows):
        extra, here = TRUNCATED * (fault == "truncated"), []
        for q in range(4):
            ways = [edge(DELETE, "D", value[q])]
            if fault not in ("blank", "duplicate"):
                ways.append(edge(REROLE + extra, "R", value[NEXT[q]]))
                if (q, initial) in STEPS:
                    ways.append(edge(KEEP + extra, "K", value[STEPS[q, initial]]))
            here.append(min(ways))
        value = inserted(here)
    least, audit = value[START], []
    names = dict(zip(LETTERS.values(), LETTERS, strict=True))
    for shift in range(top - 3, -1, -3):
        digit = (least >> shift) & 7
        if not digit:
            break
        audit.append(names[digit])
    return least >> top, "".join(audit)


def damaged(rows: DataFrame) -> DataFrame:
    """The fixed damage of the evaluation: conv_id, turn, role, text, and `there`, false for rows that are dropped.

    By crc32 of `conv_id:turn` modulo 20: 0 drops the row, 1 empties its text, 2 removes its `.`, `!` and `?`, 3 repeats it, 4 makes it
    the user's. Nulls of id and turn count as a space in that key; null roles and texts become a space.
    """
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn"))) % 20
    role, text = named("role"), named("text")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fate != 0).alias("there"),
        F.explode(F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1))).alias("_copy"),
    ).drop("_copy")


def _flags(rows: DataFrame) -> DataFrame:
    """Each row twice, as flags (`part` 0) and as text (`part` 1), in the order in which a task reads them."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    time = "row_number() over (partition by conv_id, there, role, text order by turn nulls first)"
    fault: Column = (
        F.when(trimmed == "", "blank").when(F.col("time") > 1, "duplicate").when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    )
    place = "row_number() over (partition by conv_id order by there, turn nulls first, role, text, time)"
    marked = rows.select("conv_id", "turn", "role", "text", "there").repartition("conv_id").withColumn("time", F.expr(time)).select("*", fault.alias("fault"), F.expr(place).alias("place"))
    first = F.col("part") == 0
    return (
        marked.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
        .select("conv_id", "part", "place", "there", "turn", "role", "fault", F.when(~first, F.col("text")).alias("text"))
        .sortWithinPartitions("conv_id", "part", "place")
    )


_KINDS: dict[tuple[str, str], tuple[str, str]] = {}


class _Conversation:
    """What is known of one conversation while its rows pass."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.turns, self.low, self.high = conv_id, [], 0, None, None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.audit, self.cost, self.edits, self.turn = 0, None, 0, 0, 0
        self.hash, self.some = hashlib.sha256(), False

    def flag(self, turn: int | None, role: str, fault: str) -> None:
        initial = role[:1]
        if self.rows and (self.rows[-1][0], initial) not in LEGAL:
            self.illegal += 1
        self.rows.append(_KINDS.setdefault((initial, fault), (initial, fault)))
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            if turn != self.high:
                self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def decide(self) -> None:
        if self.audit is None:
            self.cost, self.audit = least_repair(self.rows)

    def write(self, role: str, text: str) -> None:
        if self.some:
            self.hash.update(b"\n")
        self.some = True
        self.hash.update(f"{role}:{text}".encode())

    def pairs(self) -> None:
        """Insertions that stand next in the audit."""
        while self.edits < len(self.audit) and self.audit[self.edits] == "I":
            self.write(("user", "assistant")[self.turn % 2], "")
            self.turn, self.edits = self.turn + 1, self.edits + 1

    def text(self, role: str, text: str) -> None:
        self.decide()
        self.pairs()
        letter = self.audit[self.edits]
        self.edits += 1
        if letter == "D":
            return
        system = letter == "K" and role[:1] == "s"
        self.write(role if letter == "K" else ("user", "assistant")[self.turn % 2], text)
        self.turn += not system

    def ended(self) -> "_Conversation":
        self.decide()
        self.pairs()
        return self

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, self.cost, self.audit, self.hash.hexdigest())


def _read(batches, kind: type[_Conversation]) -> Iterator[tuple[_Conversation, bool]]:
    """Each conversation when it has ended (true), and the one under way after each batch (false)."""
    one: _Conversation | None = None
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("conv_id", "part", "there", "turn", "role", "fault", "text")]
        for conv_id, part, there, turn, role, fault, text in zip(*cols, strict=True):
            if one is None or conv_id != one.conv_id:
                if one is not None:
                    yield one.ended(), True
                one = kind(conv_id)
            if there and not part:
                one.flag(turn, role, fault)
            elif there:
                one.text(role, text)
        if one is not None:
            yield one, False
    if one is not None:
        yield one.ended(), True


def _repair(batches) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for one, ended in _read(batches, _Conversation):
        if ended:
            out.append(one.row())
        if len(out) > 4096:
            yield _batch(out, REPAIRS)
            out = []
    if out:
        yield _batch(out, REPAIRS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def repairs(rows: DataFrame) -> DataFrame:
    """One row for each conv_id of `rows` (conv_id, turn, role, text, there): its faults, the least cost, its audit, and the hash of what results.

    Rows with `there` false only name their conversation. Rows go by turn, nulls first, then by role and text. A row without a role
    initial, or with one that is not s, u or a, cannot be kept. A null conv_id is a conversation of its own. Repeated rows are duplicates.
    No rows: an empty result. Other columns do not matter.
    """
    return _flags(rows).mapInArrow(_repair, ddl(REPAIRS))


class _Kept(_Conversation):
    """Keeps the repaired rows until they are sent on."""

    def __init__(self, conv_id: int | None):
        super().__init__(conv_id)
        self.out, self.written = [], 0

    def write(self, role: str, text: str) -> None:
        self.out.append((self.conv_id, self.written, role, text))
        self.written += 1


TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _rewrite(batches) -> Iterator[pa.RecordBatch]:
    for one, _ in _read(batches, _Kept):
        if one.out:
            yield _batch(one.out, TURNS)
            one.out = []


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The conversations after the repair, as rows of conv_id, turn (from 0), role and text; `rows` as for `repairs`."""
    return _flags(rows).mapInArrow(_rewrite, ddl(TURNS))
