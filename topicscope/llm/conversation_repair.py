"""Conversation structure repair as lightest derivations (Knuth's agenda).

A conversation is well formed if its roles' initials read ``(s?(ua)+)?``.  The
cheapest edits that make it so are the lightest derivation in a weighted
deduction system.  An item (i, q) says: the first i rows are edited and the
output is in state q (0 nothing yet, 1 after a system turn, 2 after a user
turn, 3 after an assistant turn).  It derives, together with the axiom of the
next row's class, (i + 1, q') by Keep, Rerole or Delete, and (i, q') by Insert.
A derivation weighs (cost, audit), the audit being the edits' initials in
order; weights are compared by cost, then audit (ASCII).  Appending an edit
never lightens a derivation and keeps the order of two derivations of an item
(of equal cost none is a prefix of the other, as they edit the same rows and
every insertion costs), so the functions are superior and monotone: an item is
final when the agenda pops it first, and the search ends when the goal does.

Plan, for conversations of any length:

1. Light rows without texts: equal rows of a turn are counted before the
   shuffle, the first occurrence of a (role, text) comes from a minimum per
   text digest and a join on keys that are unique on both sides.
2. These are sorted over all tasks by range of (conversation, turn), so that a
   conversation with a third of all rows is spread.  A short conversation that
   lies in one task is solved by one agenda run (equal class strings once per
   worker); longer ones, and those that meet a task's ends, become blocks of
   ``block`` rows, each a 4 x 4 table of lightest derivations from state to
   state, which compose by associativity, in a task and then over tasks.
3. Texts are shuffled once, by conversation, each behind its audit, and walked
   in order: a conversation's repaired turns are never held together.  One
   SHA-256 digest is sequential, so one task streams one conversation's bytes.

Memory: a block's agenda; 16 characters a row of the conversation whose blocks
are being composed; one batch of texts.

Defined results: a null role or text is one space.  Rows stand by turn (nulls
first), then role, then a digest of the text; equal rows stand together.  An
empty role has no initial and can't be kept as it is.  A null conversation id
is a conversation.  No rows give no conversations; other columns are ignored,
whatever their names.  (role, text) pairs are told apart by 128 hash bits
within their conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from heapq import heappop, heappush
from operator import and_

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table

#: ASCII white space.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows of a conversation that one agenda run covers.
BLOCK = 64
STATES, ACCEPTING = range(4), (0, 3)
ORDER = ["conv_id", "turn", "role", "h1", "h2"]

Weight = tuple[int, str]


# ---------------------------------------------------------------- the deduction system

def deductions(classes: str, i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
    """(edit, its cost, i', q') of the items that (i, q) derives.

    A class is the role's initial (s, u, a, or o for any other), in upper case
    for a truncated row, or d for a row that must go.
    """
    turn = 3 if q == 2 else 2   # the state after a turn of the role that may come next, user or assistant
    yield "I", INSERT, i, turn
    if i == len(classes):
        return
    c = classes[i]
    yield "D", DELETE, i + 1, q
    if c == "d":
        return
    cut = TRUNCATED if c.isupper() else 0
    yield "R", REROLE + cut, i + 1, turn
    kept = {"s": 1 if q == 0 else None, "u": 2, "a": 3}.get(c.lower())
    if kept is not None and (kept == 1 or kept == turn):
        yield "K", KEEP + cut, i + 1, kept


def lightest(classes: str, start: int, goal: tuple[int, ...] | None = None) -> dict[int, Weight]:
    """Lightest derivation of (all rows, q) from (0, start): of every reachable q, or of the first of ``goal`` that is final."""
    end, final, agenda = len(classes), set(), [(0, "", 0, start)]
    found: dict[int, Weight] = {}
    while agenda:
        cost, audit, i, q = heappop(agenda)
        if (i, q) in final:
            continue
        final.add((i, q))
        if i == end:
            found[q] = cost, audit
            if goal is not None and q in goal:
                return {q: (cost, audit)}
        for edit, weight, j, r in deductions(classes, i, q):
            if (j, r) not in final:
                heappush(agenda, (cost + weight, audit + edit, j, r))
    return found


@lru_cache(maxsize=1 << 16)
def solve(classes: str) -> Weight:
    """Cost and audit of a whole conversation."""
    return next(iter(lightest(classes, 0, ACCEPTING).values()))


Table = list[list[Weight | None]]


@lru_cache(maxsize=1 << 12)
def table(classes: str) -> Table:
    """Lightest derivations of a block from each state to each state."""
    return [[found.get(r) for r in STATES] for found in (lightest(classes, q) for q in STATES)]


def compose(a: Table, b: Table) -> Table:
    return [[min(((a[q][m][0] + b[m][r][0], a[q][m][1] + b[m][r][1]) for m in STATES if a[q][m] and b[m][r]), default=None) for r in STATES]
            for q in STATES]


class Piece:
    """A conversation's rows within a task: counts, and blocks composed in pairs of equal size."""

    def __init__(self, conv, block: int):
        self.conv, self.size = conv, block
        self.classes: list[str] = []
        self.stack: list[tuple[int, Table]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.head = self.tail = self.low = self.high = None

    def add(self, turn, initial: str, kind: str, blank: bool, n: int) -> None:
        """``n`` equal rows; the first one's class is ``kind``, the others must go."""
        if blank:
            self.blank += n
        else:
            self.duplicate += n - (kind != "d")
            self.truncated += kind.isupper()
        pair = None if self.tail is None else self.tail + initial
        self.illegal += (pair is not None and pair not in ("su", "ua", "au")) + n - 1   # an initial beside itself is never legal
        if self.head is None:
            self.head = initial
        self.tail = initial
        if turn is not None and turn != self.high:   # in order
            self.turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn
        self.classes.append(kind)
        self._blocks()
        for at in range(1, n, self.size):
            self.classes.extend("d" * min(self.size, n - at))
            self._blocks()

    def _blocks(self) -> None:
        while len(self.classes) >= self.size and (len(self.classes) > self.size or self.stack):
            self._push(table("".join(self.classes[:self.size])))
            del self.classes[:self.size]

    def _push(self, t: Table, size: int = 1) -> None:
        while self.stack and self.stack[-1][0] == size:
            _, left = self.stack.pop()
            size, t = 2 * size, compose(left, t)
        self.stack.append((size, t))

    def whole(self) -> Weight | None:
        """The solution, if one agenda run covers the piece."""
        return None if self.stack else solve("".join(self.classes))

    def table(self) -> Table:
        out = table("".join(self.classes))
        for _, left in reversed(self.stack):
            out = compose(left, out)
        return out


# ---------------------------------------------------------------- plans

def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit(" ")).alias("text"))
    return rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})


def _light_rows(rows: DataFrame) -> DataFrame:
    """One row per distinct (conversation, turn, role, text), without the text: initial, class, blank, number of rows."""
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    light = rows.select(*ORDER, (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("cut")).groupBy(*ORDER, "blank", "cut").agg(F.count("*").alias("n"))
    light = stage_table(light, "repair-rows")
    first = light.groupBy("conv_id", "role", "h1", "h2").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn"))["turn"].alias("turn"))
    first = first.select(*[F.col(c).alias(f"first_{c}") for c in ORDER], F.lit(True).alias("is_first"))
    both = light.join(first, reduce(and_, [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in ORDER]), "left")
    initial = F.left("role", F.lit(1))
    plain = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    kind = F.when(F.col("blank") | F.col("is_first").isNull(), "d").when(F.col("cut"), F.upper(plain)).otherwise(plain)
    return both.select(*ORDER, initial.alias("initial"), kind.alias("kind"), "blank", "n")


_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def plan_repairs(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation."""
    return _plans(_rows(turns, conv_col, turn_col, role_col, text_col), block)


def _plans(rows: DataFrame, block: int) -> DataFrame:
    light = stage_table(_light_rows(rows), "repair-classes")
    conv = light.schema["conv_id"].dataType.simpleString()
    ordered = light.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    cell = pa.struct([("cost", pa.int64()), ("audit", pa.string())])
    names = ["conv_id", "task", "done", "cost", "audit", "cells", "head", "tail", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal"]
    kinds = [None, pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.list_(cell), pa.string(), pa.string(), *[pa.int64()] * 7]

    def out(pieces: list[tuple[Piece, bool]]) -> pa.RecordBatch:
        task, rows = TaskContext.get().partitionId(), []
        for p, inner in pieces:
            whole = p.whole() if inner else None
            if inner and whole is None:
                t = p.table()
                whole = min(t[0][q] for q in ACCEPTING if t[0][q])
            cells = None if inner else [c and {"cost": c[0], "audit": c[1]} for line in p.table() for c in line]
            rows.append((p.conv, task, inner, *(whole or (None, None)), cells, p.head, p.tail, p.low, p.high, p.turns, p.blank, p.duplicate, p.truncated, p.illegal))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, first, ready = None, True, []
        for b in batches:
            kinds[0] = b.schema.field("conv_id").type
            for conv, turn, *row in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "kind", "blank", "n")]):
                if piece is None or conv != piece.conv:
                    if piece is not None:
                        ready.append((piece, not first))   # the first and the last may go on in other tasks
                        first = False
                    piece = Piece(conv, block)
                piece.add(turn, *row)
            if ready:
                yield out(ready)
                ready = []
        if piece is not None:
            yield out([(piece, False)])

    counts = "low bigint, high bigint, turns bigint, " + _COUNTS
    pieces = stage_table(ordered.mapInArrow(run, f"conv_id {conv}, task int, done boolean, cost bigint, audit string, "
                                                 f"cells array<struct<cost: bigint, audit: string>>, head string, tail string, {counts}"), "repair-pieces")
    totals = ["conv_id", "cost", "audit", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal"]

    def join(t: pa.Table) -> pa.Table:
        parts = sorted(t.to_pylist(), key=lambda p: p["task"])
        total, whole = None, dict(parts[0])
        for p in parts:
            cells = [c and (c["cost"], c["audit"]) for c in p["cells"]]
            part = [cells[4 * q:4 * q + 4] for q in STATES]
            if total is None:
                total = part
                continue
            total = compose(total, part)
            for c in ("blank", "duplicate", "truncated", "illegal"):
                whole[c] += p[c]
            whole["illegal"] += whole["tail"] + p["head"] not in ("su", "ua", "au")
            whole["turns"] += p["turns"] - (p["low"] is not None and p["low"] == whole["high"])
            whole["tail"] = p["tail"]
            whole["low"] = p["low"] if whole["low"] is None else whole["low"]
            whole["high"] = whole["high"] if p["high"] is None else p["high"]
        whole["cost"], whole["audit"] = min(total[0][q] for q in ACCEPTING if total[0][q])
        kinds = {f.name: f.type for f in t.schema}
        return pa.table([pa.array([whole[c]], kinds[c]) for c in totals], names=totals)

    open_ones = pieces.where("NOT done").groupBy("conv_id").applyInArrow(join, f"conv_id {conv}, cost bigint, audit string, {counts}")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long")).alias("gaps")
    return (pieces.where("done").select(*totals).unionByName(open_ones)
            .select("conv_id", gaps, "blank", "duplicate", "truncated", "illegal", "cost", "audit"))


# ---------------------------------------------------------------- repaired texts

class Walk:
    """Applies an audit to a conversation's rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.user_spoke = audit, 0, False

    def _next_role(self) -> str:
        self.user_spoke = not self.user_spoke
        return "user" if self.user_spoke else "assistant"

    def inserts(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._next_role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the turns that take the row's place."""
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, self._next_role(), text
        elif edit == "K":
            self.user_spoke = role.startswith("u")
            yield edit, role, text


def _behind_plans(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's audit and then its rows in order, in one task."""
    none = F.lit(None)
    heads = plans.select("conv_id", F.lit(0).alias("kind"), none.cast("bigint").alias("turn"), none.cast("string").alias("role"),
                         F.col("audit").alias("text"), none.cast("bigint").alias("h1"), none.cast("bigint").alias("h2"))
    both = heads.unionByName(rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "h1", "h2"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "h1", "h2").select("conv_id", "kind", "role", "text")


def _digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    conv = plans.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = sha = None
        conv_now, empty, kind_of_id = None, True, None

        def feed(turns):
            nonlocal empty
            for _, role, text in turns:
                sha.update(f"{role}:{text}".encode() if empty else f"\n{role}:{text}".encode())
                empty = False

        for b in batches:
            done, kind_of_id = [], b.schema.field("conv_id").type
            for conv_id, kind, role, text in zip(*[c.to_pylist() for c in b.columns]):
                if kind:
                    feed(walk.row(role, text))
                    continue
                if walk is not None:
                    feed(walk.inserts())
                    done.append((conv_now, sha.hexdigest()))
                conv_now, walk, sha, empty = conv_id, Walk(text), hashlib.sha256(), True
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind_of_id), pa.array([d for _, d in done])], names=["conv_id", "sha"])
        if walk is not None:
            feed(walk.inserts())
            yield pa.RecordBatch.from_arrays([pa.array([conv_now], kind_of_id), pa.array([sha.hexdigest()])], names=["conv_id", "sha"])

    return _behind_plans(rows, plans).mapInArrow(run, f"conv_id {conv}, sha string")


def repair_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                 block: int = BLOCK) -> DataFrame:
    """conv_id, place (from 0), edit (K, R or I), role, text: the repaired conversations."""
    rows = _rows(turns, conv_col, turn_col, role_col, text_col)
    plans = stage_table(_plans(rows, block), "repair-plans")
    conv = plans.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, conv_now, place, kind_of_id = None, None, 0, None
        for b in batches:
            out, kind_of_id = [], b.schema.field("conv_id").type
            for conv_id, kind, role, text in zip(*[c.to_pylist() for c in b.columns]):
                for turn in (walk.row(role, text) if kind else walk.inserts() if walk else ()):
                    out.append((conv_now, place, *turn))
                    place += 1
                if not kind:
                    walk, conv_now, place = Walk(text), conv_id, 0
            if out:
                yield _batch(out, kind_of_id)
        out = [(conv_now, place + i, *turn) for i, turn in enumerate(walk.inserts() if walk else ())]
        if out:
            yield _batch(out, kind_of_id)

    def _batch(out: list[tuple], kind_of_id) -> pa.RecordBatch:
        kinds = (kind_of_id, pa.int64(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["conv_id", "place", "edit", "role", "text"])

    return _behind_plans(rows, plans).mapInArrow(run, f"conv_id {conv}, place bigint, edit string, role string, text string")


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           block: int = BLOCK) -> DataFrame:
    """The plans with ``repaired_sha256``, the digest of the repaired ``role:text`` joined by newlines."""
    rows = _rows(turns, conv_col, turn_col, role_col, text_col)
    plans = stage_table(_plans(rows, block), "repair-plans")
    digests = _digests(rows, plans).withColumnRenamed("conv_id", "id")
    return plans.join(digests, plans["conv_id"].eqNullSafe(F.col("id"))).select(*plans.columns, F.col("sha").alias("repaired_sha256"))
