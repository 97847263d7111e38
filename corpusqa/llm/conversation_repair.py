"""Conversation structure repair: secondary-sorted streaming with a dynamic program.

Rows are dealt out by conversation and sorted by turn; ``mapInPandas`` reads them as a stream and
carries one conversation's state across Arrow batches.  The program walks an automaton of role
initials, ``(s?(ua)+)?``: for each of its four states the cheapest edits so far, the ASCII-least of
equal ones, and the hash of the text that they leave.  What the program must know of the past is
few enough cases (cost differences and the order of the edits so far) that each step is looked up
once it has been worked out; a step is kept as a number of two bytes, and the numbers of a giant
conversation go to a temporary file, from which the edits are read backwards.

That prefixes are compared at once is right: edits fix the cost, and edits of equal cost for the same
rows are never the beginning of each other, as the longer ones would have further inserts to pay.

A text's earlier occurrence is no state of the stream: counted by conversation and digest beforehand,
the place of each first occurrence is sent along as a row of its own, right ahead of it.

Defined results: rows of one turn are taken in the order of role, then of a digest of the text; a null
role or text is one space, null turns come first, a null conversation is one of its own; a role with
another initial than s, u, a, or none, can only be reroled or deleted; repeated rows are duplicates;
columns other than the four are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row of an initial leads from each state, and the roles that can be inserted or given.
FOLLOWS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ROLES = {USER: ("u", b"user:"), ASSISTANT: ("a", b"assistant:")}
ACCEPTED = (START, ASSISTANT)
REROLE, DELETE, INSERT = 2, 3, 2
#: How much dearer than the state after an assistant a state can be and still end cheapest.
SLACK = {START: 3, SYSTEM: 0}
#: Steps of a conversation that are held in memory.
HELD_STEPS = 1 << 20
#: White space of the contract, and what ends a sentence.
BLANKS = " \t\n\x0b\x0c\r"
STOPS = "[.!?]"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) damaged by crc32 of ``conv_id:turn`` modulo 20; rows that are dropped keep conv_id only (role null)."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", told("conv_id"), told("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(told("text"), STOPS, "")).otherwise(told("text"))
    role = F.when(kind == 0, None).when(kind == 4, "user").otherwise(told("role"))
    copies = F.explode(F.array_repeat(F.struct("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")), F.when(kind == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", "role", "text").select(copies.alias("x")).select("x.*")


class Steps:
    """All steps of the program that have been met: by state before and class of the row."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.steps: list[tuple] = []
        self.begin = self._number(None, self._close({START: (0, "0", None, "", ())}))

    def _close(self, found: dict) -> dict:
        """With inserts after the edit of the row, wherever they are cheaper or first in order."""
        todo = list(found)
        while todo:
            state = todo.pop()
            cost, edits, before, edit, inserts = found[state]
            for to, (initial, _) in ROLES.items():
                if FOLLOWS.get((initial, state)) == to:
                    new = (cost + INSERT, edits + "I")
                    if to not in found or new < found[to][:2]:
                        found[to] = (*new, before, edit, (*inserts, to))
                        todo.append(to)
        return found

    def _number(self, key: tuple | None, found: dict) -> int:
        """Store a step's result: (costs and edits of each state relative to each other, what was added to all costs, ways)."""
        limit = found[ASSISTANT][0]
        found = {q: x for q, x in sorted(found.items()) if x[0] <= limit + SLACK.get(q, INSERT)}
        least = min(x[0] for x in found.values())
        ranks: dict[str, str] = {}
        base, rank = None, -1
        for edits in sorted({x[1] for x in found.values()}):
            if base is None or not edits.startswith(base):
                base, rank = edits, rank + 1
            ranks[edits] = chr(48 + rank) + "I" * (len(edits) - len(base))
        state = tuple((q, x[0] - least, ranks[x[1]]) for q, x in found.items())
        self.steps.append((state, least, {q: x[2:] for q, x in found.items()}))
        number = len(self.steps) - 1
        if key is not None:
            self.numbers[key] = number
        return number

    def __call__(self, number: int, initial: str, fault: str) -> int:
        """The step after step ``number`` for a row of this initial and fault (``bad``: it must go, ``truncated`` or ``ok``)."""
        state = self.steps[number][0]
        key = (state, initial, fault)
        known = self.numbers.get(key)
        if known is not None:
            return known
        found: dict = {}

        def offer(to: int, cost: int, edits: str, before: int, edit: str) -> None:
            if to not in found or (cost, edits) < found[to][:2]:
                found[to] = (cost, edits, before, edit, ())

        for q, cost, edits in state:
            offer(q, cost + DELETE, edits + "D", q, "D")
            if fault != "bad":
                more = cost + (fault == "truncated")
                if (initial, q) in FOLLOWS:
                    offer(FOLLOWS[initial, q], more, edits + "K", q, "K")
                for to, (given, _) in ROLES.items():
                    if FOLLOWS.get((given, q)) == to:
                        offer(to, more + REROLE, edits + "R", q, "R")
        return self._number(key, self._close(found))


class Trail:
    """The steps of a conversation, to be read backwards; beyond a bound they go to a file."""

    def __init__(self, held: int) -> None:
        self.held, self.numbers, self.file = held, array("H"), None

    def append(self, number: int) -> None:
        if len(self.numbers) >= self.held:
            self.file = self.file or tempfile.TemporaryFile()
            self.numbers.tofile(self.file)
            self.numbers = array("H")
        self.numbers.append(number)

    def backwards(self) -> Iterator[int]:
        yield from reversed(self.numbers)
        if self.file:
            size = 2 * self.held
            for at in range(self.file.tell() - size, -1, -size):
                self.file.seek(at)
                part = array("H")
                part.frombytes(self.file.read(size))
                yield from reversed(part)
            self.file.close()


class Conversation:
    """What a stream keeps of the conversation that it is in."""

    def __init__(self, conv_id: str | None, steps: Steps, held: int) -> None:
        self.conv_id, self.steps, self.trail = conv_id, steps, Trail(held)
        self.number, self.cost = steps.begin, 0
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.turns, self.first, self.last, self.initial, self.marked = 0, None, None, None, False
        empty = hashlib.sha256()
        self.hashes = {START: empty}
        self._carry(self.hashes, b"", b"")

    def _carry(self, old: dict, role: bytes, text: bytes) -> None:
        hashes = {}
        for q, (before, edit, inserts) in self.steps.steps[self.number][2].items():
            at = START if before is None else before
            said = []
            if edit in ("K", "R"):
                at = FOLLOWS[role[:1].decode("latin-1"), at] if edit == "K" else USER if at != USER else ASSISTANT
                said.append((role + b":" if edit == "K" else ROLES[at][1]) + text)
            said += [ROLES[to][1] for to in inserts]
            digest = old[START if before is None else before]
            if said:
                digest = digest.copy()
                digest.update((b"" if before in (None, START) else b"\n") + b"\n".join(said))
            hashes[q] = digest
        self.hashes = hashes

    def row(self, turn: str | None, role: str, text: str, blank: bool, stopped: bool) -> None:
        if turn is not None and turn != self.last:
            self.turns, self.first, self.last = self.turns + 1, self.first if self.first is not None else turn, turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = initial
        fault = "blank" if blank else "duplicate" if not self.marked else "ok" if stopped else "truncated"
        self.marked = False
        if fault in self.counts:
            self.counts[fault] += 1
        self.number = self.steps(self.number, initial if initial in ("s", "u", "a") else "", "bad" if fault in ("blank", "duplicate") else fault)
        self.cost += self.steps.steps[self.number][1]
        self.trail.append(self.number)
        self._carry(self.hashes, role.encode(), text.encode())

    def result(self) -> tuple:
        state, _, ways = self.steps.steps[self.number]
        cost, _, end = min((cost, edits, q) for q, cost, edits in state if q in ACCEPTED)
        audit, at = [], end
        for number in self.trail.backwards():
            before, edit, inserts = self.steps.steps[number][2][at]
            audit.append(edit + "I" * len(inserts))
            at = before
        audit.append("I" * len(self.steps.steps[self.steps.begin][2][at][2]))
        gaps = int(self.last) - int(self.first) + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), self.cost + cost, "".join(reversed(audit)), self.hashes[end].hexdigest())


FOUND = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES = [x.split(" ")[0] for x in FOUND.split(", ")]


def repair(rows: DataFrame, held: int = HELD_STEPS) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text): its faults and its cheapest repair.

    Rows with a null role stand for nothing but their conversation.
    """
    solid = F.rtrim("text", F.lit(BLANKS))
    there = F.col("role").isNotNull()
    digest = F.when(there, F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", F.coalesce("text", F.lit("")))))
    marked = rows.select("conv_id", "turn", "role", F.when(there, F.coalesce("text", F.lit(""))).alias("text"), digest.alias("digest")).withColumn("solid", solid)
    marked = marked.withColumns({"kind": F.lit(1), "blank": F.col("solid") == "", "stopped": F.right("solid", F.lit(1)).rlike(STOPS)}).drop("solid")
    first = marked.where(there & ~F.col("blank")).groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "role")).alias("at"))
    firsts = first.select("conv_id", "at.turn", "at.role", F.lit(None).cast("string").alias("text"), "digest", F.lit(0).alias("kind"), F.lit(False).alias("blank"), F.lit(False).alias("stopped"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("digest"), F.asc("kind")]
    stream = marked.unionByName(firsts).repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps, now, done = Steps(), None, []
        for pdf in batches:
            columns = [pdf[c].tolist() for c in ("conv_id", "kind", "turn", "role", "text", "blank", "stopped")]
            for conv_id, kind, turn, role, text, blank, stopped in zip(*columns):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.result())
                    now = Conversation(conv_id, steps, held)
                if kind == 0:
                    now.marked = True
                elif role is not None:
                    now.row(turn, role, text, blank, stopped)
            if done:
                yield pd.DataFrame(done, columns=NAMES)
                done = []
        if now is not None:
            yield pd.DataFrame([now.result()], columns=NAMES)

    found = stream.select(F.col("conv_id").cast("string"), "kind", F.col("turn").cast("string"), "role", "text", "blank", "stopped").mapInPandas(run, FOUND)
    return found.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))
