"""Repair of conversations at least cost, by layers of reachable grammar states.

A conversation should be nothing, or an optional system turn and then user and
assistant by turns, judged by the first letters of roles: ``(s?(ua)+)?``.  Turns
can be kept, given another role, deleted, and turns can be inserted.  For each
cost 0, 1, 2 ... a layer holds, for each turn, the set of grammar states (four
bits) from which the rest can be accepted at that cost or less.  A layer follows
from the layers 3, 4 and 6 below it; the first one that accepts from the start
gives the cost, and a walk along the bits the least list of edits.

Sets only grow with the cost, and beyond a few units all bits are set.  A layer
thus stores the stretch between the turns that nothing reaches yet and those
that all states reach: some ten bytes a turn over all layers, whatever the cost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, saved, slices

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Grammar states, one bit each: nothing yet, after system, after user, after assistant.
NOTHING, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
ALL = 15
ACCEPTING = NOTHING | ASSISTANT
#: What follows each state when a turn of the fitting role is put there, and that role.
NEXT = {NOTHING: (USER, "user"), SYSTEM: (USER, "user"), USER: (ASSISTANT, "assistant"), ASSISTANT: (USER, "user")}
#: Where a kept turn leads, by the first letter of its role.
KEPT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}

#: Codes of first letters, and of what may be done with a turn.
LETTERS = "?sua"
PLAIN, CUT, GONE = 0, 1, 2

#: White space of a blank text.
SPACES = " \t\n\x0b\x0c\r"


def _before(steps: dict[int, int]) -> bytes:
    """For each set of states those from which a step leads into it."""
    return bytes(sum(a for a, b in steps.items() if b & reached) for reached in range(16))


_BEFORE_NEXT = _before({a: b for a, (b, _) in NEXT.items()})
_BEFORE_KEPT = [_before(KEPT.get(letter, {})) for letter in LETTERS]


class Layers:
    """The layers of one conversation: the code of each turn's first letter, and what may be done with it."""

    def __init__(self, letters: bytes, kinds: bytes):
        self.letters, self.kinds, self.made = letters, kinds, []
        while not self.at(len(self.made) - 1, 0) & NOTHING:
            self._grow()
        self.cost = len(self.made) - 1

    def at(self, cost: int, turn: int) -> int:
        """States from which the turns from this one on are accepted at the cost or less."""
        if cost < 0:
            return 0
        low, high, bits = self.made[cost]
        return 0 if turn < low else ALL if turn > high else bits[turn - low]

    def _grow(self) -> None:
        cost, n = len(self.made), len(self.letters)
        high = self.made[-1][1] if self.made else n
        found, after, turn = bytearray(), ALL, high  # beyond high all states are reached
        while turn >= 0:
            bits = _BEFORE_NEXT[self.at(cost - INSERT, turn)]
            if turn == n:
                bits |= ACCEPTING
            else:
                bits |= self.at(cost - DELETE, turn + 1)
                kind = self.kinds[turn]
                if kind != GONE:
                    more = TRUNCATED if kind == CUT else 0
                    bits |= _BEFORE_KEPT[self.letters[turn]][self.at(cost - more, turn + 1) if more else after]
                    bits |= _BEFORE_NEXT[self.at(cost - more - REROLE, turn + 1)]
            if not bits:
                break
            found.append(bits)
            after, turn = bits, turn - 1
        low = turn + 1
        found.reverse()
        full = len(found)
        while full and found[full - 1] == ALL:
            full -= 1
        self.made.append((low, low + full - 1, bytes(found[:full])))

    def edits(self) -> Iterator[tuple[int, str, str | None]]:
        """``(turn, letter, new role)`` of the cheapest edits, ASCII-least where several are as cheap."""
        turn, state, left, n = 0, NOTHING, self.cost, len(self.letters)
        while turn < n or not state & ACCEPTING:
            after, role = NEXT[state]
            if turn < n and self.at(left - DELETE, turn + 1) & state:
                yield turn, "D", None
                turn, left = turn + 1, left - DELETE
                continue
            if self.at(left - INSERT, turn) & after:
                yield turn, "I", role
                state, left = after, left - INSERT
                continue
            more = TRUNCATED if self.kinds[turn] == CUT else 0
            kept = KEPT.get(LETTERS[self.letters[turn]], {}).get(state, 0)
            if self.at(left - more, turn + 1) & kept:
                yield turn, "K", None
                turn, state, left = turn + 1, kept, left - more
            else:
                yield turn, "R", role
                turn, state, left = turn + 1, after, left - more - REROLE


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Conversation:
    """The codes of one conversation's turns as they come in order: a few bytes a turn."""

    def __init__(self):
        self.letters, self.kinds = bytearray(), bytearray()
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = None
        self.distinct = 0

    def add(self, turn, letter: str, fault: str) -> None:
        if self.letters and LETTERS[self.letters[-1]] + letter not in LEGAL:
            self.counts["illegal"] += 1
        self.letters.append(LETTERS.index(letter))
        self.kinds.append(GONE if fault in ("blank", "duplicate") else CUT if fault == "truncated" else PLAIN)
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            if self.first is None:
                self.first = turn
            if turn != self.last:
                self.distinct += 1
            self.last = turn

    def plan(self) -> Iterator[tuple]:
        """Rows of the plan: each edit, and at last the report at place -1."""
        layers = Layers(bytes(self.letters), bytes(self.kinds))
        audit = bytearray()
        for turn, letter, role in layers.edits():
            yield turn, len(audit), letter, role, None, None
            audit += letter.encode()
        self.counts["cost"] = layers.cost
        if self.first is not None:
            self.counts["gaps"] = self.last - self.first + 1 - self.distinct
        yield -1, -1, None, None, self.counts, audit.decode()


def _plan(codes: DataFrame) -> DataFrame:
    """``conv_id, place, step, edit, new_role`` for each edit, and a report row at place -1, from codes sorted by conv_id and place."""
    conv = codes.schema["conv_id"].dataType
    names = ["conv_id", "place", "step", "edit", "new_role", *_COUNTS, "audit"]
    kinds = [to_arrow_type(conv), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * len(_COUNTS), pa.string()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches):
        now, last, rows = None, None, []

        def ended():
            for place, step, edit, role, counts, audit in now.plan():
                rows.append((last, place, step, edit, role, *(counts[c] if counts else None for c in _COUNTS), audit))
                if len(rows) >= 4096:
                    yield table(rows)
                    rows.clear()

        for batch in slices(batches, 4096):
            for conv_id, turn, letter, fault in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "letter", "fault")), strict=True):
                if now is None or conv_id != last:
                    if now is not None:
                        yield from ended()
                    now, last = _Conversation(), conv_id
                now.add(turn, letter, fault)
        if now is not None:
            yield from ended()
        if rows:
            yield table(rows)

    fields = f"conv_id {conv.simpleString()}, place bigint, step bigint, edit string, new_role string, {', '.join(f'{c} bigint' for c in _COUNTS)}, audit string"
    return codes.mapInArrow(run, fields)


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report of each conversation, and the repaired turns.

    turns: ``conv_id, turn, role, text``; other columns are ignored.  A null role
    or text is one space.  Rows are taken by turn (nulls first), equal turns by
    role and text.  A turn's first fault counts: blank (white space alone),
    duplicate (role and text of an earlier row), truncated (the last other
    character is none of ``.!?``).  Blank and duplicate turns must be deleted;
    keeping a truncated one costs 3.  Other edits: new role 3, deletion 4,
    insertion of an empty turn 3.

    report: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``,
    a row for each conv_id, a null one too; none for an empty table.
    repaired: ``conv_id, step, edit, role, text`` with edit K, R or I; in order
    of step they are the conversation.  A conversation of which all is deleted has none.

    A task reads the turns of a conversation as codes of a few bytes, never its
    texts; the list of edits, which is part of the report, is as long.  Both
    tables are read from written ones.
    """
    source = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    spaces = "".join(f"\\u{ord(c):04x}" for c in SPACES)
    filled = F.expr(f"trim(TRAILING '{spaces}' FROM text)")
    alone = F.when(filled == "", "blank").when(~F.substring(filled, -1, 1).isin(".", "!", "?"), "truncated").otherwise("")
    letter = F.substring("role", 1, 1)
    placed = saved(
        source.select("*", (F.row_number().over(in_order) - 1).cast("bigint").alias("place")).select(
            "conv_id", "turn", "place", "role", "text", alone.alias("alone"), F.when(letter.isin(*LETTERS[1:]), letter).otherwise(LETTERS[0]).alias("letter"), F.unhex(F.sha2("text", 256)).alias("digest")
        )
    )
    codes = placed.select("conv_id", "turn", "place", "role", "alone", "letter", "digest")
    first = F.min("place").over(Window.partitionBy("conv_id", "role", "digest"))
    fault = F.when(F.col("alone") == "blank", "blank").when(F.col("place") > first, "duplicate").otherwise(F.col("alone"))
    codes = codes.select("conv_id", "turn", "place", "letter", fault.alias("fault"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plan = saved(_plan(codes.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "turn", "letter", "fault")))
    report = plan.where("place = -1").select("conv_id", *_COUNTS, "audit")

    edits = plan.where("edit <> 'D'").select(F.col("conv_id").alias("c"), F.col("place").alias("p"), "step", "edit", "new_role")
    texts = placed.select("conv_id", "place", "role", "text")
    joined = edits.join(texts, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("place")) & (F.col("edit") != "I"), "left")
    repaired = joined.select(F.col("c").alias("conv_id"), "step", "edit", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    report._tidemark_tables = [placed, plan]
    return report, repaired


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults by ``crc32("conv_id:turn") % 20``; nulls are one space.

    0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it,
    4 makes its role user.  A null conv_id or turn stays null, and is a space in the hash.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", part("conv_id"), part("turn")).cast("binary")) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    marked = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return marked.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of ``role:text`` of the rows by step, joined by line ends.

    Rows may come in any order; each conversation streams through a task, which keeps its running digest.
    """
    import hashlib

    conv = repaired.schema["conv_id"].dataType
    parts = int(repaired.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = repaired.select("conv_id", "step", F.concat_ws(":", "role", "text").alias("line"))

    def run(batches):
        kind = to_arrow_type(conv)
        now, last = None, None

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], names=["conv_id", "repaired_sha256"])

        for batch in slices(batches, 1024):
            rows = []
            for conv_id, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if now is None or conv_id != last:
                    if now is not None:
                        rows.append((last, now.hexdigest()))
                    now, last = hashlib.sha256(line.encode()), conv_id
                else:
                    now.update(f"\n{line}".encode())
            if rows:
                yield table(rows)
        if now is not None:
            yield table([(last, now.hexdigest())])

    ordered = lines.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "step")
    return ordered.mapInArrow(run, f"conv_id {conv.simpleString()}, repaired_sha256 string")


def repair_damaged(turns: DataFrame) -> DataFrame:
    """Every conv_id of turns with the report of its damaged rows, and the digest of what repair makes of them.

    A conversation without rows after the damage has zeros, an empty audit and the digest of an empty text.
    """
    report, repaired = repair(damaged(turns))
    found = report.join(digests(repaired).withColumnRenamed("conv_id", "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left").drop("d")
    found = found.withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in _COUNTS]
    nothing = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"  # of no bytes
    out = saved(every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")))
    for step in report._tidemark_tables:
        discard(step)
    return out
