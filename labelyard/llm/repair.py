"""Repair of conversations: the cheapest edits that make turns alternate.

A conversation is right if its rows' role initials are an optional s and then one or more pairs ua,
or if it is empty. Rows are kept (K), get another role (R), are deleted (D), or empty rows are
inserted (I). ``cheapest`` finds the edits by dynamic programming over rows and four states: what
may stand next after nothing, s, u, a. From each state only one of u and a may follow, so a string
of edits stands for one result, and the ASCII-least of all cheapest strings comes from walking
forward and taking the least letter whose cost is tight. That needs the costs from each row to the
end: these are computed backwards, but kept only at every root-of-n-th row; the walk computes those
of the block that it enters anew. So costs take the root of a conversation's rows in memory.

Spark orders the rows, finds duplicates and writes each row as one character; these strings are as
long as the strings of edits that are asked for. Texts pass by once more, in order, for the digest
of the repaired conversation, and are never held.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.manifest import positions

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, S, U, A = range(4)
#: Rows that are written as one string in a first step.
BLOCK = 4096
#: The first character of a row's code.
FIRST = 65
SPACE = " \t\n\x0b\x0c\r"
NEVER = 1 << 60

Costs = tuple[int, int, int, int]


def code(fault: int, initial: int) -> str:
    """fault: 0 none, 1 truncated, 2 blank, 3 duplicate; initial: 0 s, 1 u, 2 a, 3 another."""
    return chr(FIRST + 4 * fault + initial)


def _before(c: int, after: Costs) -> Costs:
    """Costs to the end from in front of a row with code ``c``, given those behind it."""
    a0, a1, a2, a3 = after
    b0, b1, b2, b3 = a0 + DELETE, a1 + DELETE, a2 + DELETE, a3 + DELETE
    fault, initial = divmod(c, 4)
    if fault < 2:
        more = TRUNCATED * fault
        to_u, to_a = a2 + more + (KEEP if initial == 1 else REROLE), a3 + more + (KEEP if initial == 2 else REROLE)
        b0, b1, b2, b3 = min(b0, to_u), min(b1, to_u), min(b2, to_a), min(b3, to_u)
        if initial == 0:
            b0 = min(b0, a1 + more + KEEP)
    return _inserted(b0, b1, b2, b3)


def _inserted(b0: int, b1: int, b2: int, b3: int) -> Costs:
    b2 = min(b2, b3 + INSERT)
    u = b2 + INSERT
    return min(b0, u), min(b1, u), b2, min(b3, u)


#: Behind the last row: nothing or a may stand at the end.
LAST = _inserted(0, NEVER, NEVER, 0)


def cheapest(codes: str) -> tuple[int, str]:
    """The least cost and the ASCII-least string of edits that has it."""
    rows = [ord(c) - FIRST for c in codes]
    n = len(rows)
    step = max(1, math.isqrt(n))
    kept, costs = {n: LAST}, LAST
    for i in range(n - 1, -1, -1):
        costs = _before(rows[i], costs)
        if i % step == 0:
            kept[i] = costs
    total, state, edits, block = costs[START], START, [], []
    low = high = -1
    i = 0
    while True:
        if i < n and not low <= i < high:
            low, high = i - i % step, min(n, i - i % step + step)
            block = [kept[high]]
            for j in range(high - 1, low - 1, -1):
                block.append(_before(rows[j], block[-1]))
            block.reverse()
        here = block[i - low] if i < n else LAST
        left = here[state]
        if i == n and left == 0:
            return total, "".join(edits)
        after = block[i + 1 - low] if i < n else None
        target = A if state == U else U
        if after and after[state] + DELETE == left:
            edits.append("D")
        elif here[target] + INSERT == left:
            edits.append("I")
            state = target
            continue
        else:
            fault, initial = divmod(rows[i], 4)
            more = TRUNCATED * fault
            if initial == 0 and state == START and after[S] + more + KEEP == left:
                edits.append("K")
                state = S
            elif initial == target - 1 and after[target] + more + KEEP == left:
                edits.append("K")
                state = target
            else:
                edits.append("R")
                state = target
        i += 1


def counts(codes: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours that mustn't follow each other."""
    faults, initials = [(ord(c) - FIRST) // 4 for c in codes], ["suax"[(ord(c) - FIRST) % 4] for c in codes]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return faults.count(2), faults.count(3), faults.count(1), illegal


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with planted damage: by the hash of id and turn a row goes
    (``gone``, kept as a mark of its conversation), loses its text or its sentence marks, stands
    twice, or becomes the user's. Nulls count as one space, in the hash too."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("_h") == 1, "").when(F.col("_h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    some = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), space("role").alias("role"), space("text").alias("text"), h.alias("_h"))
    some = some.select("conv_id", "turn", F.when(F.col("_h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("_h") == 0).alias("gone"), "_h")
    return some.withColumn("_copy", F.explode(F.when(F.col("_h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_h", "_copy")


def _code(first: Column) -> Column:
    initial = F.position(F.substring("role", 1, 1), F.lit("sua"))
    initial = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1)
    said = F.rtrim("text", F.lit(SPACE))
    fault = F.when(said == "", 2).when(~first, 3).when(~F.substring(said, -1, 1).isin(".", "!", "?"), 1).otherwise(0)
    return F.when(F.col("gone"), "").otherwise(F.char(FIRST + 4 * fault + initial))


def ordered(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text, gone) with ``at``, their place by conversation, turn
    (nulls first), role and text, and ``code``. A conversation may lie in several partitions."""
    placed = positions(rows, "conv_id", "turn", "role", "text", name="at")
    own = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    firsts = placed.filter("not gone").groupBy("conv_id", own.alias("_d")).agg(F.min("at").alias("at"))
    # by place, which is unique, so that many equal rows don't meet in one task
    known = placed.join(firsts.select("at", F.lit(True).alias("_first")), "at", "left")
    return known.withColumn("code", _code(F.coalesce("_first", F.lit(False)))).drop("_first")


def edits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of ``ordered`` rows."""
    turn = F.when(~F.col("gone"), F.col("turn"))
    said = F.array_sort(F.collect_list(F.struct("at", "code")))
    turns = F.collect_set(turn)
    block = rows.groupBy("conv_id", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.array_join(F.transform(said, lambda x: x["code"]), "").alias("codes"), F.min(turn).alias("low"), F.max(turn).alias("high"), F.size(turns).cast("long").alias("n"))
    whole = block.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "codes", "low", "high", "n"))).alias("b"))
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            cols: list[list] = [[] for _ in (*names, "audit")]
            for blocks in batch.column(1).to_pylist():
                codes = "".join(b["codes"] for b in blocks)
                some = [b for b in blocks if b["n"]]
                distinct = sum(b["n"] for b in some) - sum(a["high"] == b["low"] for a, b in zip(some, some[1:], strict=False))
                gaps = some[-1]["high"] - some[0]["low"] + 1 - distinct if some else 0
                for col, v in zip(cols, (gaps, *counts(codes), *cheapest(codes)), strict=True):
                    col.append(v)
            kinds = [pa.int64()] * len(names) + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["conv_id", *names, "audit"])

    return whole.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in names) + ", audit string")


class Walk:
    """The repaired rows of one conversation: ``take`` gives each of its rows in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _emit(self, kept: str | None = None, text: str = "") -> tuple[str, str]:
        if self.state == START and kept and kept[0] == "s":
            self.state = S
            return kept, text
        self.state = A if self.state == U else U
        return kept if kept is not None else ("assistant" if self.state == A else "user"), text

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._emit()

    def take(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield self._emit(role if edit == "K" else None, text)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the rows of the repaired conversations, ``place`` from 0.

    A conversation's edits stand in front of its rows, and its rows pass in order, so a task holds
    one row and one string of edits. One conversation lies in one task.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, conv, place, out = None, None, 0, []

        def add(items: Iterator[tuple[str, str]]) -> None:
            nonlocal place
            for role, text in items:
                out.append((conv, place, role, text))
                place += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[]] * 4
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "role", "text"])

        for batch in it:
            for c, at, role, text in zip(*(x.to_pylist() for x in batch.columns[:4]), strict=True):
                if at < 0:
                    if walk:
                        add(walk.inserts())
                    walk, conv, place = Walk(text), c, 0
                else:
                    add(walk.take(role, text))
            yield flush()
        if walk:
            add(walk.inserts())
        yield flush()

    return _streamed(rows, found).mapInArrow(run, "conv_id long, place long, role string, text string")


def _streamed(rows: DataFrame, found: DataFrame) -> DataFrame:
    own = rows.filter("not gone").select("conv_id", "at", "role", "text")
    marks = found.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), *[c for c in found.columns if c not in ("conv_id", "audit")])
    return own.unionByName(marks, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "at")


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def report(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (conv_id, turn, role, text, gone): faults, the
    cheapest edits and the digest of the repaired `role:text` lines.

    Null ids are a conversation of their own; null turns come first; roles and texts mustn't be
    null (``damaged`` gives a space). Equal rows are duplicates. A conversation all of whose rows
    are gone has zeros, no edits and the digest of the empty string. An empty table gives no rows;
    other columns don't matter.
    """
    placed = ordered(rows)
    found = edits(placed)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, head, out, digest, empty = None, None, [], None, True

        def add(items: Iterator[tuple[str, str]]) -> None:
            nonlocal empty
            for role, text in items:
                digest.update((f"{role}:{text}" if empty else f"\n{role}:{text}").encode())
                empty = False

        def finish() -> None:
            if walk:
                add(walk.inserts())
                out.append({**head, "repaired_sha256": digest.hexdigest()})

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_pylist(out, schema)
            out.clear()
            return done

        schema = pa.schema([(c, pa.string() if k == "string" else pa.int64()) for c, k in (x.split() for x in REPORT.split(", "))])
        for batch in it:
            names = batch.schema.names
            counted = [c for c in names if c not in ("at", "role", "text")]
            for i, (at, role, text) in enumerate(zip(*(batch.column(names.index(c)).to_pylist() for c in ("at", "role", "text")), strict=True)):
                if at < 0:
                    finish()
                    head = {c: batch.column(names.index(c))[i].as_py() for c in counted} | {"audit": text}
                    walk, digest, empty = Walk(text), hashlib.sha256(), True
                else:
                    add(walk.take(role, text))
            yield flush()
        finish()
        yield flush()

    return _streamed(placed, found).mapInArrow(run, REPORT)
