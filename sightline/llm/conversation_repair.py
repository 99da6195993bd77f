"""Repair of the order of roles in conversations by a min-plus matrix scan.

A conversation is well formed if its role initials read (s?(ua)+)?. Four states follow it: 0 nothing yet, 1 after the
system turn, 2 after a user, 3 after an assistant; 0 and 3 may end it. Each turn is a 4x4 matrix over (cost, audit):
what its edits (keep, rerole, delete) cost from one state to another, with the closure of insertions on both sides. The
product takes the least cost and of equal costs the ASCII-least audit. It is associative, so any run of turns is a matrix
too, and long conversations are runs that are multiplied as a tree, sixteen neighbours at a time.

Rows are dealt by ranges of (conversation, turn, role, beginning of the text), so a conversation of any size is spread
over tasks. One that lies whole within a task and has at most WHOLE turns is finished there. Of the others a task gives
one matrix and its rows; the tree gives their audits, and their rows are then read once more in order to be written out
or hashed (a SHA-256 is a sequence by nature: that last pass streams a conversation through one task, in memory that
holds its audit but not its texts).

Defined results: null roles and texts are one space; turns are ordered with nulls first, equal ones by role and text in
byte order; rows without a conversation are one conversation; turns equal in role and text to an earlier one are
duplicates, repeated rows among them; initials are a role's first character as it is; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, sized, written

#: Turns up to which a conversation within one task is finished there; turns that are folded one by one before trees of matrices.
WHOLE, RUN = 4096, 256
#: Neighbouring matrices that one group of a tree's level multiplies.
FAN = 16
#: Costs of the edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

_WHITE = " \t\n\v\f\r"
_LEGAL = frozenset(("su", "ua", "au"))
_ENDS = (0, 3)
#: State after a turn of an initial, by the state before it; what insertion and reroling give.
_KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_ASKED = {0: 2, 1: 2, 3: 2, 2: 3}
_NAMES = {2: "user", 3: "assistant"}

Cell = tuple[int, str] | None
Matrix = list[list[Cell]]


def _least(a: Cell, b: Cell) -> Cell:
    return b if a is None or (b is not None and b < a) else a


def product(a: Matrix, b: Matrix) -> Matrix:
    """Least (cost, audit) over the state between; audits are only joined where they decide or win."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i, row in enumerate(a):
        for j in range(4):
            cost, ways = None, []
            for k, x in enumerate(row):
                y = b[k][j]
                if x is not None and y is not None:
                    c = x[0] + y[0]
                    if cost is None or c < cost:
                        cost, ways = c, [(x, y)]
                    elif c == cost:
                        ways.append((x, y))
            if ways:
                out[i][j] = (cost, min(x[1] + y[1] for x, y in ways))
    return out


def _closure() -> Matrix:
    out: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for i in range(4):
        j = _ASKED[i]
        out[i][j] = _least(out[i][j], (INSERT, "I"))
        out[i][_ASKED[j]] = _least(out[i][_ASKED[j]], (2 * INSERT, "II"))
    return out


CLOSURE = _closure()


def turn_matrix(initial: str, fault: str) -> Matrix:
    """The matrix of one turn. fault: "", "blank", "duplicate" or "truncated"."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        out[i][i] = (DELETE, "D")
        if fault not in ("blank", "duplicate"):
            stays = TRUNCATED if fault else 0
            out[i][_ASKED[i]] = _least(out[i][_ASKED[i]], (REROLE + stays, "R"))
            j = _KEPT.get(initial, {}).get(i)
            if j is not None:
                out[i][j] = _least(out[i][j], (stays, "K"))
    return product(product(CLOSURE, out), CLOSURE)


_TURNS = {(c, f): turn_matrix(c, f) for c in ("s", "u", "a", "") for f in ("", "blank", "truncated")}
#: The same as lists of (next state, cost, edits) by state, for folding turn by turn.
_STEPS = {key: [[(j, *cell) for j, cell in enumerate(row) if cell is not None] for row in m] for key, m in _TURNS.items()}


def _steps(initial: str, fault: str) -> list[list[tuple[int, int, str]]]:
    return _STEPS[initial if initial in _KEPT else "", "blank" if fault == "duplicate" else fault]


def fold(state: list[Cell], turns: Iterable[tuple[str, str]]) -> list[Cell]:
    """A row of a matrix times the matrices of turns (initial, fault)."""
    for initial, fault in turns:
        steps, after = _steps(initial, fault), [None] * 4
        for i, held in enumerate(state):
            if held is not None:
                cost, audit = held
                for j, c, edits in steps[i]:
                    now = after[j]
                    if now is None or cost + c < now[0]:
                        after[j] = (cost + c, audit + edits)
                    elif cost + c == now[0] and (way := audit + edits) < now[1]:
                        after[j] = (now[0], way)
        state = after
    return state


def run_matrix(turns: list[tuple[str, str]]) -> Matrix:
    """The matrix of a run: stretches of RUN turns folded, then multiplied as a tree."""
    level = [[fold([(0, "") if k == i else None for k in range(4)], turns[at : at + RUN]) for i in range(4)] for at in range(0, len(turns), RUN)]
    while len(level) > 1:
        level = [product(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else CLOSURE


class Part(NamedTuple):
    """A run of a conversation: counts, what its ends need, and its matrix. Without turns: all empty and the closure."""

    blank: int
    duplicate: int
    truncated: int
    illegal: int
    turns: int
    low: int | None
    high: int | None
    first: str | None
    last: str | None
    matrix: Matrix

    def then(self, b: Part) -> Part:
        meet = self.last is not None and b.first is not None and self.last + b.first not in _LEGAL
        same = self.high is not None and self.high == b.low
        return Part(
            self.blank + b.blank, self.duplicate + b.duplicate, self.truncated + b.truncated, self.illegal + b.illegal + meet, self.turns + b.turns - same,
            b.low if self.low is None else self.low, self.high if b.high is None else b.high, b.first if self.first is None else self.first, self.last if b.last is None else b.last, product(self.matrix, b.matrix),
        )

    def counts(self) -> tuple[int, int, int, int, int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal

    def end(self) -> tuple[int, str]:
        return min(cell for j in _ENDS if (cell := self.matrix[0][j]) is not None)


def part_of(rows: list[tuple], whole: bool) -> Part:
    """The part of ordered rows (turn, role, text, fault); whole: only the row of the starting state is needed."""
    initials = [r[1][:1] for r in rows]
    faults = [r[3] for r in rows]
    stamps = sorted({r[0] for r in rows if r[0] is not None})
    turns = list(zip(initials, faults, strict=True))
    matrix = [fold([(0, ""), None, None, None], turns) if turns else CLOSURE[0], *[[None] * 4] * 3] if whole else run_matrix(turns)
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))  # noqa: B905
    ends = (stamps[0], stamps[-1]) if stamps else (None, None)
    return Part(faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, len(stamps), *ends, *((initials[0], initials[-1]) if rows else (None, None)), matrix)


def replay(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of every turn that an audit leaves of ordered rows (role, text)."""
    state, rest = 0, iter(rows)
    for edit in audit:
        if edit == "I":
            state = _ASKED[state]
            yield _NAMES[state], "", edit
            continue
        role, text = next(rest)
        if edit == "K":
            state = _KEPT[role[0]][state]
            yield role, text, edit
        elif edit == "R":
            state = _ASKED[state]
            yield _NAMES[state], text, edit


def digest(turns: Iterable[tuple[str, str, str]]) -> str:
    """SHA-256 of `role:text` lines, fed as they come."""
    out, gap = hashlib.sha256(), b""
    for role, text, _ in turns:
        out.update(gap + f"{role}:{text}".encode())
        gap = b"\n"
    return out.hexdigest()


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_WIDTH = 8


def _fault(text: str, again: bool) -> str:
    held = text.rstrip(_WHITE)
    return "blank" if not held else "duplicate" if again else "" if held[-1] in ".!?" else "truncated"


def _ordered(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, gone: Column | None) -> DataFrame:
    """conv, turn, role, text, later (an earlier turn has the same role and text) and gone, in ranges and in order within."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.lit(False) if gone is None else F.coalesce(gone, F.lit(False))
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), F.when(~gone, space(text_col)).alias("text"), gone.alias("gone"))
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("at", F.struct(F.col("turn").isNotNull().alias("known"), "turn"))
    spread = rows.where(~F.col("gone")).groupBy("conv", "role", "digest").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    spread = sized(written(spread.where("first < last").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")))
    found = rows.join(spread, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    found = found.select("conv", "turn", "role", "text", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("later"), "gone")
    keys = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("role")]
    return found.repartitionByRange(*keys, F.substring("text", 1, 16)).sortWithinPartitions(*keys, "text")


def _rows(source: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, turn, role, text, fault); text null: only names its conversation."""
    before = None
    for conv, turn, role, text, later, gone in source:
        if gone:
            yield conv, turn, role, None, ""
            continue
        same = (conv, turn, role, text) == before
        before = (conv, turn, role, text)
        yield conv, turn, role, text, _fault(text, later or same)


def _parts(df: DataFrame, kind: str) -> DataFrame:
    """Of every task: finished conversations (kind 0), and of the others its part (1) and its rows (2)."""
    empty = (None,) * _WIDTH

    def finished(conv, rows: list[tuple]) -> tuple:
        part = part_of(rows, whole=True)
        cost, audit = part.end()
        return 0, conv, None, None, None, None, None, *part.counts(), cost, audit, digest(replay(audit, ((r[1], r[2]) for r in rows)))

    def open_part(conv, task: int, number: int, rows: list[tuple]) -> Iterator[tuple]:
        for i, r in enumerate(rows):
            yield 2, conv, task, number + i, r[1], r[2], None, *empty

    def out(source):
        task, first, waiting = TaskContext.get().partitionId(), True, None
        for conv, group in groupby(_rows(source), itemgetter(0)):
            if waiting is not None:
                yield finished(*waiting)
                waiting = None
            rows, part, number = [], None, 0
            for row in group:
                if row[3] is not None:
                    rows.append(row[1:])
                if len(rows) > WHOLE:
                    yield from open_part(conv, task, number, rows)
                    now = part_of(rows, whole=False)
                    part, number, rows = now if part is None else part.then(now), number + len(rows), []
            if part is None and not first:
                waiting = conv, rows  # not the task's first; it may be its last
            else:
                yield from open_part(conv, task, number, rows)
                now = part_of(rows, whole=False)
                yield 1, conv, task, None, None, None, pickle.dumps(now if part is None else part.then(now)), *empty
            first = False
        if waiting is not None:
            conv, rows = waiting
            yield from open_part(conv, task, 0, rows)
            yield 1, conv, task, None, None, None, pickle.dumps(part_of(rows, whole=False)), *empty

    return map_rows(df, df.columns, f"kind int, conv {kind}, task bigint, number bigint, role string, text string, part binary, {_RESULT}", out)


def _tree(parts: DataFrame, kind: str) -> DataFrame:
    """conv and part: each conversation's parts (conv, task, part) multiplied, FAN neighbours at a level."""

    def out(source):
        for (conv, task), group in groupby(source, lambda r: (r[0], r[1] // FAN)):
            part = None
            for _, _, raw in group:
                now = pickle.loads(raw)
                part = now if part is None else part.then(now)
            yield conv, task, pickle.dumps(part)

    last = parts.agg(F.max("task")).first()[0] or 0
    while True:
        group = (F.col("task") / FAN).cast("long")
        parts = map_rows(parts.repartition("conv", group).sortWithinPartitions("conv", "task"), ["conv", "task", "part"], f"conv {kind}, task bigint, part binary", out)
        if last < FAN:
            return parts.select("conv", "part")
        parts, last = written(parts), last // FAN


def _streamed(table: DataFrame, audits: DataFrame, schema: str, each) -> DataFrame:
    """each(conv, head, rows) over conversations in order: head from audits (conv, head binary), rows (role, text) streamed."""

    def out(source):
        for conv, group in groupby(source, itemgetter(0)):
            head = next(group)[4]
            yield from each(conv, pickle.loads(head), ((r[2], r[3]) for r in group))

    heads = audits.select("conv", F.lit(-1).cast("long").alias("task"), F.lit(-1).cast("long").alias("number"), F.lit("").alias("role"), F.lit("").alias("text"), F.col("head"))
    both = heads.union(table.select("conv", "task", "number", "role", "text", F.lit(None).cast("binary")))
    return map_rows(both.repartition("conv").sortWithinPartitions("conv", "task", "number"), ["conv", "number", "role", "text", "head"], schema, out)


def _solved(df: DataFrame, columns: tuple[str, str, str, str], gone: Column | None) -> tuple[DataFrame, DataFrame, str]:
    kind = df.schema[columns[0]].dataType.simpleString()
    table = written(_parts(_ordered(df, *columns, gone), kind))
    return table, _tree(table.where("kind = 1").select("conv", "task", "part"), kind), kind


def repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """Of every conversation: its id, gaps, blank, duplicate, truncated and illegal turns, the least cost of a repair, its audit and the hash of the repaired text. gone: rows that only name their conversation."""
    table, tree, kind = _solved(df, (conv_col, turn_col, role_col, text_col), gone)

    def each(conv, part: Part, rows):
        cost, audit = part.end()
        yield conv, *part.counts(), cost, audit, digest(replay(audit, rows))

    rest = _streamed(table.where("kind = 2"), tree.withColumnRenamed("part", "head"), f"conv {kind}, {_RESULT}", each)
    done = table.where("kind = 0").select(rest.columns)
    return done.union(rest).withColumnRenamed("conv", conv_col)


def repaired_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone: Column | None = None) -> DataFrame:
    """The repaired conversations as rows: their id, position (from 0), role, text and edit (K, R or I)."""
    kind = df.schema[conv_col].dataType.simpleString()
    ordered = _ordered(df, conv_col, turn_col, role_col, text_col, gone)

    def every(source):
        task = TaskContext.get().partitionId()
        for conv, group in groupby(_rows(source), itemgetter(0)):
            part, rows, number = None, [], 0
            for row in group:
                if row[3] is not None:
                    rows.append(row[1:])
                    yield conv, task, number, row[2], row[3], None
                    number += 1
                if len(rows) > WHOLE:
                    now, rows = part_of(rows, whole=False), []
                    part = now if part is None else part.then(now)
            now = part_of(rows, whole=False)
            yield conv, task, None, None, None, pickle.dumps(now if part is None else part.then(now))

    table = written(map_rows(ordered, ordered.columns, f"conv {kind}, task bigint, number bigint, role string, text string, part binary", every))
    tree = _tree(table.where("part IS NOT NULL").select("conv", "task", "part"), kind)

    def each(conv, part: Part, rows):
        for i, turn in enumerate(replay(part.end()[1], rows)):
            yield conv, i, *turn

    out = _streamed(table.where("part IS NULL"), tree.withColumnRenamed("part", "head"), f"conv {kind}, position bigint, role string, text string, edit string", each)
    return out.withColumnRenamed("conv", conv_col)


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The four columns damaged by a hash of conversation and turn, and gone: rows that were dropped. For trying a repair on data whose faults are known."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    times = F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    damaged = df.select(F.col(conv_col), F.col(turn_col), F.when(code == 4, "user").otherwise(space(role_col)).alias(role_col), text.alias(text_col), (code == 0).alias("gone"), times.alias("time"))
    return damaged.drop("time")
