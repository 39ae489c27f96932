"""Structure repair of conversations by a lazily determinised weighted automaton.

A conversation's rows are symbols: the first letter of the role, and the row's fault. The repaired roles must spell
``(s?(ua)+)?``, a system turn or none, then pairs of user and assistant. A row is kept (0), given the other role (3) or
deleted (4, the only way for a blank or repeated row); empty user or assistant rows may be inserted (3 each); a truncated
row that stays costs 3 more. That is a weighted automaton of four states with a choice in each; the cheapest way through
it is the repair.

The automaton is determinised from the end of a conversation, as far as rows ask for it: a state of the new automaton is
the vector of the costs that are still to come from each of the four states, less the least of them. Differences are
bounded by the costs of a few inserts, so there are few vectors; each gets a number, and its arcs (next number, weight) are
kept in a table. A scan over the table from the last row to the first gives the cost. The trace goes the other way,
from the first row on, along tight arcs (an edit whose cost makes up the whole difference of the costs to come), taking the
least letter of D, I, K, R; what a trace does for a row depends on three small numbers and is kept in a table as well.

Faults are found by Spark: a window over equal rows of a conversation marks the repeated ones, so a conversation's rows
are together in one task only as one byte each, for the scan. Texts are joined in by a stream in the order of the rows; no
task holds a conversation's texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trialframe.llm.workers import bound_batches, trim
from trialframe.scratch import materialize

#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

# States of the role automaton: nothing yet, after s, after u, after a. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 30
#: Where a kept role leads: rows are states, columns are s, u, a and any other role.
KEPT = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
#: Where an inserted row leads, and a row that is given a new role; also the role it gets.
MADE = (USER, USER, ASSISTANT, USER)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: A symbol is 3 * (s, u, a or other) + (whole, truncated, or to be deleted).
WHOLE, CUT, DROP = range(3)
SYMBOLS = 12


class Determinized:
    """The cost vectors met so far, their arcs by symbol, and the traces through them."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.arcs: list[tuple[int, int] | None] = []
        self.traces: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self._number(self._inserted([0, NEVER, NEVER, 0]))[0]

    def _inserted(self, cost: list[int]) -> list[int]:
        """Costs to come where rows may be inserted first."""
        for _ in range(4):
            cost = [min(c, INSERT + cost[MADE[q]]) for q, c in enumerate(cost)]
        return cost

    def _number(self, cost: list[int]) -> tuple[int, int]:
        least = min(cost)
        vector = tuple(c - least for c in cost)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.arcs.extend([None] * SYMBOLS)
        return self.numbers[vector], least

    def edits(self, symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
        """(letter, cost, next state) of what can be done with a row, in the order of the letters."""
        role, fault = divmod(symbol, 3)
        yield "D", DELETE, state
        if fault != DROP:
            more = TRUNCATED if fault == CUT else 0
            if KEPT[state][role] is not None:
                yield "K", KEEP + more, KEPT[state][role]
            yield "R", REROLE + more, MADE[state]

    def arc(self, number: int, symbol: int) -> tuple[int, int]:
        """The state before a row of ``symbol``, given the one behind it, and the weight between them."""
        found = self.arcs[number * SYMBOLS + symbol]
        if found is None:
            after = self.vectors[number]
            found = self._number(self._inserted([min(c + after[to] for _, c, to in self.edits(symbol, q)) for q in range(4)]))
            self.arcs[number * SYMBOLS + symbol] = found
        return found

    def scan(self, symbols: bytes) -> tuple[int, list[int]]:
        """The least cost, and the number of the vector at every row and at the end."""
        arcs, arc, number, total = self.arcs, self.arc, self.end, 0
        along = [number]
        for symbol in reversed(symbols):
            number, weight = arcs[number * SYMBOLS + symbol] or arc(number, symbol)
            total += weight
            along.append(number)
        along.reverse()
        return total + self.vectors[number][START], along

    def _step(self, after: int, symbol: int, state: int) -> tuple[str, int]:
        """What the trace does at one row: its letters, inserts first, and the state behind it."""
        before, weight = self.arc(after, symbol)
        here, there, letters = self.vectors[before], self.vectors[after], ""
        while True:
            options = [(letter, to) for letter, c, to in self.edits(symbol, state) if c + there[to] == here[state] + weight]
            if INSERT + here[MADE[state]] == here[state]:
                options.append(("I", MADE[state]))
            letter, state = min(options)
            letters += letter
            if letter != "I":
                return letters, state

    def trace(self, symbols: bytes, along: list[int]) -> str:
        """The letters of the cheapest edits, of those the least in ASCII."""
        out, state, traces = [], START, self.traces
        for at, symbol in enumerate(symbols):
            key = (along[at + 1], symbol, state)
            if key not in traces:
                traces[key] = self._step(*key)
            letters, state = traces[key]
            out.append(letters)
        out.append({START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state])
        return "".join(out)


def _rows(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    known = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text")))
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), *known)
    return rows.withColumn("digest", F.sha2("text", 256))


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
REPAIRED = "conv_id long, position long, edit string, role string, text string"


def _order() -> list[Column]:
    """The order of a conversation's rows."""
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    kinds = [pa.int64() if kind == "long" else pa.string() for _, kind in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in fields])


def _long(x: int) -> int:
    """``x`` as 64 bits hold it."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


class _Conversation:
    """One conversation's symbols, one byte a row, and what is counted on the way."""

    def __init__(self, key: int | None) -> None:
        self.key, self.symbols, self.faults = key, bytearray(), [0, 0, 0, 0]
        self.first: int | None = None
        self.last: int | None = None
        self.turns = 0

    def add(self, turn: int | None, symbol: int, fault: int) -> None:
        self.symbols.append(symbol)
        self.faults[fault] += 1
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn

    def row(self, automaton: Determinized) -> tuple:
        symbols = bytes(self.symbols)
        cost, along = automaton.scan(symbols)
        roles = np.frombuffer(symbols, np.uint8).astype(int) // 3
        legal = sum(((roles[:-1] == a) & (roles[1:] == b)).sum() for a, b in ((0, 1), (1, 2), (2, 1)))
        gaps = 0 if self.first is None else _long(self.last - self.first + 1 - self.turns)
        return (self.key, gaps, *self.faults[1:], len(roles) - 1 - int(legal), cost, automaton.trace(symbols, along))


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, turn, symbol, fault) in order, to a row for each conversation."""
    automaton, own = Determinized(), None
    for batch in batches:
        out, size = [], 0
        for conv, turn, symbol, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own is None or conv != own.key:
                if own is not None:
                    out.append(own.row(automaton))
                    size += len(own.symbols)
                own = _Conversation(conv)
            own.add(turn, symbol, fault)
            if size > 1 << 20:
                yield _batch(out, REPORT)
                out, size = [], 0
        if out:
            yield _batch(out, REPORT)
        trim()
    if own is not None:
        yield _batch([own.row(automaton)], REPORT)


def report(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation that has rows.

    Rows go by turn, nulls first; rows of one turn by role, then by the text's SHA-256. A row's first fault counts: blank
    (nothing but blanks), duplicate (role and text came earlier in the conversation), truncated (its last character that is no
    blank isn't one of ``.!?``). ``gaps`` are the turns missing between the least and the largest, ``illegal`` the neighbours whose
    roles' first letters aren't su, ua or au. ``audit`` has the letters of the cheapest edits (Keep, Rerole, Delete, Insert), the
    ASCII-least of equally cheap ones.

    A null role or text is one blank, a null conversation is one of its own, null turns make no gap. Very long texts are
    digested whole. An empty table gives no rows; further columns are ignored, whatever their names. A conversation's
    rows are one byte each in the task that scans them, as they are in ``audit``, which is one value.
    """
    rows = _rows(turns, conv_col, turn_col, role_col, text_col)
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    narrow = rows.select("conv", "turn", "role", "digest", blank.alias("blank"), cut.alias("cut"))
    again = F.lag(F.lit(1)).over(Window.partitionBy("conv", "role", "digest").orderBy(F.asc_nulls_first("turn"))).isNotNull()
    fault = F.when(F.col("blank"), 1).when(again, 2).when(F.col("cut"), 3).otherwise(0)
    marked = narrow.select("conv", "turn", "role", "digest", fault.alias("fault"))
    kind = F.when(F.col("fault") == 0, WHOLE).when(F.col("fault") == 3, CUT).otherwise(DROP)
    first = F.substring("role", 1, 1)
    role = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    # of rows alike in all of these the one that is no duplicate comes first
    dealt = marked.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), *_order(), F.col("fault") == 2)
    bound_batches(turns.sparkSession)
    return dealt.select("conv", "turn", (3 * role + kind).alias("symbol"), "fault").mapInArrow(_reported, REPORT)


class _Edits:
    """One conversation's audit as far as its rows have come."""

    def __init__(self, key: int | None, audit: str) -> None:
        self.key, self.audit, self.at, self.state, self.position = key, audit, 0, START, 0

    def _put(self, edit: str, role: str, text: str) -> tuple:
        self.position += 1
        return (self.key, self.position, edit, role, text)

    def inserts(self) -> Iterator[tuple]:
        while self.audit.startswith("I", self.at):
            self.at += 1
            self.state = MADE[self.state]
            yield self._put("I", ROLES[self.state], "")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[self.state]["sua".index(role[0])]
            yield self._put(edit, role, text)
        elif edit == "R":
            self.state = MADE[self.state]
            yield self._put(edit, ROLES[self.state], text)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv, audit, role, text) in order, a conversation's audit before its rows, to the rows that the edits leave."""
    own: _Edits | None = None
    for batch in batches:
        out: list[tuple] = []
        for conv, audit, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if audit is not None:
                if own is not None:
                    out.extend(own.inserts())
                own = _Edits(conv, audit)
            else:
                out.extend(own.row(role, text))
        if out:
            yield _batch(out, REPAIRED)
        trim()
    if own is not None and (out := list(own.inserts())):
        yield _batch(out, REPAIRED)


def repaired(turns: DataFrame, reported: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, position, edit, role, text): the rows of the repaired conversations, numbered from 1, by ``report``'s edits.

    A partition holds conversations one after the other, each in order. Kept rows are as they were (null role and text:
    one blank), inserted ones have empty texts. Conversations of which nothing is left have no rows.
    """
    rows = _rows(turns, conv_col, turn_col, role_col, text_col).withColumn("audit", F.lit(None).cast("string"))
    first = reported.select(F.col("conv_id").alias("conv"), "audit")
    dealt = rows.unionByName(first, allowMissingColumns=True).repartition("conv")
    dealt = dealt.sortWithinPartitions(F.asc_nulls_first("conv"), F.desc_nulls_last("audit"), *_order())
    bound_batches(turns.sparkSession)
    return dealt.select("conv", "audit", "role", "text").mapInArrow(_edited, REPAIRED)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = "conv_id long, sha256 string"
    key, digest = None, None
    for batch in batches:
        out = []
        for conv, position, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if position == 1:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = conv, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if out:
            yield _batch(out, schema)
        trim()
    if digest is not None:
        yield _batch([(key, digest.hexdigest())], schema)


def transcript_hashes(rows: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the lines ``role:text`` of each conversation, joined by newlines, of rows as ``repaired`` gives them."""
    return rows.select("conv_id", "position", "role", "text").mapInArrow(_hashed, "conv_id long, sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of a table like ``conversations`` with faults planted by crc32(conv_id:turn) mod 20, nulls being one blank.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out of it, 3 has it twice, 4 makes it a user's.
    """
    named = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    rows = turns.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(F.concat_ws(":", *named)) % 20).alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("case") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.expr("sequence(1, if(case = 3, 2, 1))"))
    return rows.where("case <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def repaired_conversations(turns: DataFrame) -> DataFrame:
    """Every conversation of ``turns`` once: the report of its damaged rows and the digest of their repair.

    A conversation that has lost all its rows has zeros, an empty audit and the digest of an empty string.
    """
    rows = damaged(turns)
    reported = materialize(report(rows), "repair-report")
    hashes = transcript_hashes(repaired(rows, reported)).select(F.col("conv_id").alias("hashed"), "sha256")
    every = turns.select(F.col("conv_id").cast("long").alias("conv")).distinct()
    out = every.join(reported, F.col("conv").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("conv").eqNullSafe(F.col("hashed")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256().hexdigest())
    return out.select(F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", nothing).alias("repaired_sha256"))
