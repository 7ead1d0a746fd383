"""Repair of conversations whose turns do not alternate, by lazy weighted determinisation.

A conversation is right when the initials of its roles read `(s?(ua)+)?`: perhaps a system turn, then user and assistant in turn. Edits keep,
delete or re-role a turn or insert an empty one, at a cost; blank and repeated turns must go, cut-off ones cost extra if they stay.

The edits make a weighted automaton over four places in the pattern. It is read from the last turn to the first: what the rest of a conversation
costs from each place, less the least of them, is a vector that becomes one state of a deterministic automaton. Differences between places are
bounded by a few edits, so there are finitely many vectors, and those that occur are found and cached as they come: a transition is then a look-up of (vector, turn)
in a table, which gives the next vector and what it adds to the cost. The trace goes the other way, from the first turn on, over arcs that are
tight (the cost before is the edit's plus the cost behind), the ASCII-least first; so the audit is the least of the cheapest ones.

Plan: slim rows without texts are dealt by conversation and sorted; a task streams through them and holds two or three bytes a turn of one conversation at
a time, about as much as the audit it returns. Repaired turns are made from a second stream with texts, one turn at a time, so a conversation of any length fits;
it is read by one task, as its order, audit and digest are sequential.

Defined results. Null turns come first. Turns with the same number are ordered by role, then by the SHA-256 of the text (in hexadecimal), nulls first. A null or empty role, or one with
another initial than s, u and a, cannot be kept. Null texts are blank. A repeated turn (same role and text) is a duplicate from the second on, over the whole conversation.
Null is a conversation id like any other. Texts of any length count whole. Empty tables give no rows. Other columns of the input are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE

EMPTY, SYSTEM, USER, ASSISTANT = range(4)  # places: nothing yet, or after a turn of that role
FINAL = (EMPTY, ASSISTANT)
ARCS = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The turn that an insertion or a new role makes at each place.
MADE = {EMPTY: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
INITIALS = "sua"
OTHER = len(INITIALS)
#: Codes of turns: one that must go, then initial and whether it is cut off; and one that is no longer there.
MUST_GO, ABSENT = 0, 255


@dataclass(frozen=True)
class Costs:
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


class Repairer:
    """The deterministic automaton, built as far as conversations need it."""

    def __init__(self, costs: Costs = Costs()) -> None:
        self.costs = costs
        self.vectors: list[tuple[int, ...]] = []
        self.known: dict[tuple[int, ...], int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end, self.end_cost = self._state([0 if place in FINAL else 1 << 40 for place in range(4)])

    def _state(self, cost: list[int]) -> tuple[int, int]:
        """The state of a vector, and what was taken off it; turns may be inserted before what it stands for."""
        for _ in range(4):
            cost = [min(cost[place], self.costs.insert + cost[MADE[place][1]]) for place in range(4)]
        least = min(cost)
        vector = tuple(c - least for c in cost)
        if vector not in self.known:
            self.known[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.known[vector], least

    def _edits(self, symbol: int, place: int) -> Iterator[tuple[str, int, int]]:
        """(edit, cost, next place) in ASCII order, for edits that use up the turn."""
        yield "D", self.costs.delete, place
        if symbol != MUST_GO:
            initial, cut = (symbol - 1) // 2, self.costs.truncated * ((symbol - 1) % 2)
            if initial != OTHER and (place, INITIALS[initial]) in ARCS:
                yield "K", cut, ARCS[place, INITIALS[initial]]
            yield "R", self.costs.rerole + cut, MADE[place][1]

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        """The state before a turn, given the one behind it, and the cost that it adds."""
        if (known := self.moves.get(state << 8 | symbol)) is None:
            behind = self.vectors[state]
            known = self._state([min(cost + behind[then] for _, cost, then in self._edits(symbol, place)) for place in range(4)])
            self.moves[state << 8 | symbol] = known
        return known

    def trace(self, behind: int, symbol: int, place: int) -> tuple[str, int]:
        """The least edits that lead over a turn on tight arcs, and the place behind it."""
        if (known := self.traces.get((behind, symbol, place))) is None:
            before, added = self.move(behind, symbol)
            edits, now = "", place
            while True:
                due = self.vectors[before][now] + added
                tight = [(edit, then, True) for edit, cost, then in self._edits(symbol, now) if cost + self.vectors[behind][then] == due]
                made = MADE[now][1]
                if self.costs.insert + self.vectors[before][made] + added == due:
                    tight.append(("I", made, False))
                edit, now, done = min(tight)
                edits += edit
                if done:
                    break
            known = self.traces[behind, symbol, place] = edits, now
        return known

    def tail(self, place: int) -> str:
        """Insertions after the last turn."""
        edits = ""
        while not (place in FINAL and self.vectors[self.end][place] + self.end_cost == 0):
            edits, place = edits + "I", MADE[place][1]
        return edits

    def repair(self, symbols: bytes | bytearray) -> tuple[int, str]:
        """(cost, audit) of a conversation."""
        states, state, cost = array("I", [self.end]), self.end, self.end_cost
        for symbol in reversed(symbols):
            state, added = self.move(state, symbol)
            states.append(state)
            cost += added
        place, audit = EMPTY, []
        for i, symbol in enumerate(symbols):
            edits, place = self.trace(states[len(symbols) - 1 - i], symbol, place)
            audit.append(edits)
        return cost + self.vectors[state][EMPTY], "".join(audit) + self.tail(place)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, absent: the workload of the query. By crc32 of `conv_id:turn` modulo 20, turns are dropped (absent), emptied, robbed of their
    full stops, repeated or said by the user. Nulls count as one space in that, and in role and text."""
    said = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    harm = F.crc32(said.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (harm == 0).alias("absent"),
        F.when(harm == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("_times"),
    )
    return rows.withColumn("_time", F.explode("_times")).drop("_times", "_time")


def _ends(text: Column) -> tuple[Column, Column]:
    """(blank, cut off) of a text."""
    shown = F.rtrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return shown == "", ~F.substring(shown, -1, 1).isin(".", "!", "?")


def _order() -> list[Column]:
    return [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest")]


def repairs(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    turns has conv_id, turn, role, text, and perhaps absent (boolean): rows that are not there any more, but whose conversations are asked for.
    """
    absent = F.coalesce(F.col("absent"), F.lit(False)) if "absent" in turns.columns else F.lit(False)
    blank, cut = _ends(F.col("text"))
    initial = F.coalesce(F.substring("role", 1, 1), F.lit(""))
    code = F.coalesce(*(F.when(initial == c, i) for i, c in enumerate(INITIALS)), F.lit(OTHER))
    slim = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.sha2("text", 256).alias("digest"), absent.alias("absent"), blank.alias("blank"), cut.alias("cut"), code.cast("int").alias("initial"))
    same = Window.partitionBy("conv_id", "absent", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    rows = slim.repartition("conv_id").withColumn("nth", F.row_number().over(same))
    fault = F.when(F.col("absent"), ABSENT).when(F.col("blank"), 1).when(F.col("nth") > 1, 2).when(F.col("cut"), 3).otherwise(0)
    rows = rows.withColumn("fault", fault.cast("int")).sortWithinPartitions(*_order(), "nth").select("conv_id", "turn", "initial", "fault")
    id_type = turns.schema["conv_id"].dataType
    return rows.mapInArrow(_Stream(costs).repaired, f"conv_id {id_type.simpleString()}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


class _Stream:
    """Goes through turns that are sorted by conversation."""

    def __init__(self, costs: Costs) -> None:
        self.costs = costs

    def repaired(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repairer, out, now, id_type = Repairer(self.costs), [], None, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        out.append(now.row(repairer))
                    now = _Conversation(conv)
                if fault != ABSENT:
                    now.add(turn, initial, fault)
            yield _batch(out, id_type)
            out = []
        if now is not None:
            yield _batch([now.row(repairer)], id_type)


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, *[pa.int64()] * 6, pa.string()]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


class _Conversation:
    def __init__(self, conv: object) -> None:
        self.conv, self.symbols = conv, bytearray()
        self.faults, self.illegal, self.distinct = [0, 0, 0, 0], 0, 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, initial: int, fault: int) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.distinct = turn, self.distinct + 1
        if self.symbols:
            self.illegal += (self.before, initial) not in ((0, 1), (1, 2), (2, 1))
        self.before = initial
        self.faults[fault] += 1
        self.symbols.append(MUST_GO if fault in (1, 2) else 1 + 2 * initial + (fault == 3))

    def row(self, repairer: Repairer) -> tuple:
        cost, audit = repairer.repair(self.symbols)
        gaps = 0 if self.last is None else self.last - self.first + 1 - self.distinct
        return (self.conv, gaps, *self.faults[1:], self.illegal, cost, audit)


def repaired_turns(turns: DataFrame, repaired: DataFrame) -> DataFrame:
    """conv_id, position, edit, role, text: the turns of every conversation as its audit has them; sorted by conversation and position within partitions.

    Deleted turns are left out; inserted ones have an empty text. repaired is what repairs() returned for turns.
    """
    absent = F.coalesce(F.col("absent"), F.lit(False)) if "absent" in turns.columns else F.lit(False)
    texts = turns.filter(~absent).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.sha2("text", 256).alias("digest"), "text", F.lit(None).cast("string").alias("audit"))
    audits = repaired.select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "string"), ("text", "string"))), "audit")
    rows = texts.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("audit"), *_order()[1:])
    return rows.select("conv_id", "role", "text", "audit").mapInArrow(_rewrite, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, position bigint, edit string, role string, text string")


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, audit, at, place, position = None, "", 0, EMPTY, 0
    out: list[tuple] = []

    def insert() -> None:
        nonlocal at, place, position
        while at < len(audit) and audit[at] == "I":
            role, place = MADE[place]
            out.append((conv, position, "I", role, ""))
            at, position = at + 1, position + 1

    for batch in batches:
        for row_conv, role, text, row_audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row_audit is not None:
                conv, audit, at, place, position = row_conv, row_audit, 0, EMPTY, 0
                insert()
                continue
            edit = audit[at]
            at += 1
            if edit == "K":
                place = ARCS[place, role[0]]
            elif edit == "R":
                role, place = MADE[place]
            if edit != "D":
                out.append((conv, position, edit, role, text))
                position += 1
            insert()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()))], ["conv_id", "position", "edit", "role", "text"])
        out = []


def digests(rewritten: DataFrame) -> DataFrame:
    """conv_id, sha256 of `role:text`, joined by newlines, for the conversations of repaired_turns(); one turn is in memory at a time."""
    rows = rewritten.select("conv_id", "position", "role", "text")
    return rows.mapInArrow(_digest, f"conv_id {rewritten.schema['conv_id'].dataType.simpleString()}, sha256 string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, hashed, id_type = None, None, None
    for batch in batches:
        id_type, out = batch.schema.field(0).type, []
        for conv, position, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if position == 0:
                if hashed is not None:
                    out.append((now, hashed.hexdigest()))
                now, hashed = conv, hashlib.sha256()
            else:
                hashed.update(b"\n")
            hashed.update(f"{role}:{'' if text is None else text}".encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], id_type), pa.array([r[1] for r in out], pa.string())], ["conv_id", "sha256"])
    if hashed is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], id_type), pa.array([hashed.hexdigest()], pa.string())], ["conv_id", "sha256"])
