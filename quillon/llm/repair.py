"""Conversations damaged by a fixed rule, their faults, and their cheapest repair by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import BLANKS

#: Rows that one search covers; longer conversations are searched part by part.
PART = 64
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
#: States of the roles so far: none, after system, after user (an answer is due), after assistant.
START, SYSTEM, USER, ANSWERED = range(4)
ENDS = (START, ANSWERED)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ANSWERED, "u"): USER, (USER, "a"): ANSWERED}
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, LEFT = 1, 2, 5, 5
NEVER = 1 << 60
Item = tuple[int, str]


def due(state: int) -> str:
    """The one role that the grammar takes next, of those that an edit can give."""
    return "a" if state == USER else "u"


def after(state: int, initial: str) -> int | None:
    """The state after a kept row; a role without letters leaves it as it is."""
    return NEXT.get((state, initial)) if initial else state


def least(item: Item) -> int:
    """What an item costs at least, whatever stands around it."""
    fault, initial = item
    return DELETE if fault else REROLE if initial not in ("", "s", "u", "a") else 0


def search(items: list[Item], state: int, rest: tuple[int, ...]) -> str:
    """The initials of the cheapest edits, ties to the ASCII-least: Delete, Insert, Keep, Rerole.

    state: where the items begin; rest: what follows costs, by the state in which they end.
    Depth first within a bound on cost so far plus what the items left cost at least; a
    place and state that failed with some budget isn't entered again with as much or less.
    The bound grows to the least sum that was over it. Within the first bound that
    suffices the first path found is the answer, for edits are tried in ASCII order.
    """
    n = len(items)
    floor = [min(rest)]
    for item in reversed(items):
        floor.append(floor[-1] + least(item))
    floor.reverse()
    bound = floor[0]
    while bound < NEVER:
        failed: dict[tuple[int, int], int] = {}
        over, path = NEVER, []
        stack: list[tuple[int, int, int, Iterator[tuple[str, int, int, int]]]] = [(0, state, 0, _edits(items, 0, state))]
        while stack:
            i, s, cost, edits = stack[-1]
            for letter, j, t, price in edits:
                total = cost + price
                need = total + (floor[j] if j < n else rest[t])
                if need > bound:
                    over = min(over, need)
                elif j == n:
                    return "".join(path) + letter
                elif failed.get((j, t), -1) < bound - total:
                    stack.append((j, t, total, _edits(items, j, t)))
                    path.append(letter)
                    break
            else:
                failed[i, s] = bound - cost
                stack.pop()
                if path:
                    path.pop()
        bound = over
    raise ValueError("no edits lead to an accepted order of roles")


def _edits(items: list[Item], i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
    """(initial, next place, state, cost) of each edit at a place, in ASCII order."""
    fault, initial = items[i]
    yield "D", i + 1, state, DELETE
    role = due(state)
    yield "I", i, NEXT[state, role], INSERT
    if fault in (BLANK, DUPLICATE):
        return
    extra = LEFT if fault == TRUNCATED else 0
    kept = after(state, initial)
    if kept is not None:
        yield "K", i + 1, kept, extra
    yield "R", i + 1, NEXT[state, role], REROLE + extra


def _back(items: Iterable[Item], rest: tuple[int, ...]) -> tuple[int, ...]:
    """What the items and what follows cost, by the state in which they begin."""
    for item in reversed(list(items)):
        here = [min(t + rest[s] for _, s, t in _taken([item], state)) for state in range(4)]
        for _ in range(2):  # an insert leads to a state from which the row may be cheaper
            here = [min(here[s], INSERT + here[NEXT[s, due(s)]]) for s in range(4)]
        rest = tuple(here)
    return rest


def _taken(items: list[Item], state: int) -> list[tuple[str, int, int]]:
    return [(letter, s, cost) for letter, j, s, cost in _edits(items, 0, state) if j]


#: What is left to insert where a conversation ends, by the state.
END = (0, 2 * INSERT, INSERT, 0)


@dataclass
class Conversation:
    """What is known of one conversation while its rows go by: a byte a row, and running counts."""

    conv_id: int | None
    faults: bytearray = field(default_factory=bytearray)
    initials: list[str] = field(default_factory=list)
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    turns: int = 0
    first: int | None = None
    turn: int | None = None
    row: tuple | None = None
    audit: str | None = None
    cost: int = 0
    at: int = 0
    place: int = 0
    state: int = START
    some: bool = False
    text: "hashlib._Hash" = field(default_factory=hashlib.sha256)

    def add(self, turn: int | None, role: str, mark: str, fault: int) -> None:
        """The next row in order; one that equals the row before it is a duplicate."""
        if fault != BLANK and (turn, role, mark) == self.row:
            fault = DUPLICATE
        initial = role[:1]
        if self.row is not None and self.initials[-1] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        self.row = (turn, role, mark)
        self.faults.append(fault)
        self.initials.append(initial)
        self.counts[fault] += 1

    def repair(self) -> None:
        """Find the edits: costs behind each part first, then the search in one part after the other."""
        parts = [(lo, min(lo + PART, len(self.faults))) for lo in range(0, len(self.faults), PART)]
        items = lambda lo, hi: list(zip(self.faults[lo:hi], self.initials[lo:hi], strict=True))
        rest = [END]
        for lo, hi in reversed(parts[1:]):
            rest.append(_back(items(lo, hi), rest[-1]))
        state, found = START, []
        for lo, hi in parts:
            part = items(lo, hi)
            edits = search(part, state, rest.pop())
            cost, state = _walk(part, edits, state)
            self.cost += cost
            found.append(edits)
        while state not in ENDS:
            found.append("I")
            self.cost += INSERT
            state = NEXT[state, due(state)]
        self.audit = "".join(found)

    def put(self, role: str, text: str) -> None:
        self.text.update((("\n" if self.some else "") + f"{role}:{text}").encode())
        self.some = True

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = due(self.state)
            self.put(ROLES[role], "")
            self.state = NEXT[self.state, role]
            self.at += 1

    def write(self, role: str, text: str) -> None:
        """The next row with its text: what its edit leaves goes into the hash."""
        if self.audit is None:
            self.repair()
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "R":
            given = due(self.state)
            self.put(ROLES[given], text)
            self.state = NEXT[self.state, given]
        elif edit == "K":
            self.put(role, text)
            self.state = after(self.state, role[:1])

    def done(self) -> dict:
        if self.audit is None:
            self.repair()
        self.inserts()
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return {
            "conv_id": self.conv_id, "gaps": gaps, "blank": self.counts[BLANK], "duplicate": self.counts[DUPLICATE], "truncated": self.counts[TRUNCATED],
            "illegal": self.illegal, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.text.hexdigest(),
        }


def _walk(items: list[Item], edits: str, state: int) -> tuple[int, int]:
    """What the edits of the items cost and the state that they lead to."""
    i, cost = 0, 0
    for letter in edits:
        _, i, state, price = next(e for e in _edits(items, i, state) if e[0] == letter)
        cost += price
    return cost, state


SCHEMA = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of conversations after the rule's damage; a dropped row has no copies."""
    blank = F.lit(" ")
    own = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.encode(F.concat(own("conv_id"), F.lit(":"), own("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(own("text"), ".!?", "")).otherwise(own("text"))
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(own("role")).alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def repair_conversations(rows: DataFrame, damage: bool = True) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row for each conv_id.

    rows: conv_id, turn, role, text; other columns don't matter. A null conv_id is a
    conversation, too; null turns come first, null roles and texts are one space. Rows of one
    turn are ordered by role, then by the MD5 of the text, so repeated rows stand together.
    An empty role has no initial and is kept anywhere. An empty table gives no rows; a
    conversation whose rows are all gone has zeros and the hash of nothing.

    Texts are looked at on the JVM; what finds earlier equal rows, and the search, see
    digests and a byte a row. A conversation's rows go by twice in order: once without
    texts, then with them into the hash, which is by nature one sequence. No text is kept.
    """
    every = damaged(rows) if damage else rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(1).alias("copies"),
    )
    every = every.withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("mark", F.md5("text"))
    black = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(black == "", BLANK).when(~F.substring(black, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    light = every.select("conv", "conv_id", F.struct("turn").alias("turn"), "role", "mark", "copies", fault.alias("fault"))
    first = light.where("copies > 0").groupBy("conv", "role", "mark").agg(F.min("turn").alias("first"))
    light = light.join(first, ["conv", "role", "mark"], "left")
    again = (F.col("fault") != BLANK) & (F.col("turn") != F.col("first"))
    light = light.select(
        "conv", F.lit(0).alias("kind"), "conv_id", F.col("turn.turn").alias("turn"), "role", "mark", "copies",
        F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"), F.lit(None).cast("string").alias("text"),
    )
    full = every.where("copies > 0").select("conv", F.lit(1).alias("kind"), "conv_id", "turn", "role", "mark", "copies", F.lit(0).alias("fault"), "text")
    order = ["conv", "kind", F.asc_nulls_first("turn"), "role", "mark"]
    both = light.unionByName(full).repartition("conv").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SCHEMA.split(", ")])
        now, key = None, None
        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in ("conv", "kind", "conv_id", "turn", "role", "mark", "copies", "fault")]
            texts = batch.column("text")
            for i, (conv, kind, conv_id, turn, role, mark, copies, fault) in enumerate(zip(*columns, strict=True)):
                if conv != key:
                    if now is not None:
                        done.append(now.done())
                    now, key = Conversation(conv_id), conv
                for _ in range(copies):
                    if kind == 0:
                        now.add(turn, role, mark, fault)
                    else:
                        now.write(role, texts[i].as_py())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.done()], schema)

    ship(rows.sparkSession)
    return both.mapInArrow(run, SCHEMA)
