"""Repair of conversation structure by A* on an edit lattice.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Its rows, in
order, are kept (0), reroled to user or assistant (2) or deleted (3); empty
user or assistant turns may be inserted anywhere (2); a truncated row that
stays adds 1.  Blank rows and duplicates have to be deleted.  Of the cheapest
edits the one with the ASCII-least audit (the initials K, R, D, I in order) is
taken.

A node of the lattice is (rows consumed, state), where the state is what has
been put out last: nothing, s, u or a.  The heuristic sums, over the rows that
are left, 3 for each mandatory deletion and 1 for each truncated row, which
costs at least 1 whether it stays or goes.  It is admissible and consistent,
and the queue is keyed (cost + heuristic, audit), so the first goal that comes
out is the cheapest and least.

A conversation may hold any share of the rows.  Rows are range-partitioned by
conversation and order, so a long conversation is spread over tasks, and cut
into segments of at most 256 rows.  A* runs in each segment from each state
that it may begin with to each that it may end with; a segment that begins
its conversation has one such state.  Paths between the same two nodes never
have audits of which one begins the other at equal cost (the rest would be
inserts, which cost), so the best audit of two joined segments joins the best
audits of both, and a fold over the segments' small tables of costs and orders
finds the whole path.

Defined results: rows are ordered by turn (nulls first), then role, the first 64
characters of the text and its MD5; equal rows need no order.
Null roles and texts count as one space.  A role's initial is its first
character; a role of another initial (also an empty one) can't be kept.  Rows
with a null conv_id are one conversation.  More columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._shared import Scratch

#: Rows of a segment at most: 2 to this power.
SEGMENT_BITS = 8
WHITE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: The state after the only user or assistant turn that may follow each state.
FOLLOWS = (USER, USER, ASSISTANT, USER)
#: Inserts that make a conversation end well from each state.
TAIL = (0, 2, 1, 0)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
RULED_OUT = 1 << 40


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with the faults that crc32(conv_id:turn) % 20 picks.

    0 drops the row, 1 empties its text, 2 removes ``.``, ``!`` and ``?``, 3
    repeats the row, 4 sets the role user.  Nulls are one space each, but
    conv_id and turn stay null.
    """
    shown = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    hurt = rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"))
    return hurt.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "copy")


def state_after(state: int, initial: str) -> int | None:
    """The state after a kept row, or None if it can't follow."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    if initial == "u":
        return USER if state != USER else None
    return ASSISTANT if initial == "a" and state == USER else None


def search(rows: list[tuple[int, str]], start: int) -> dict[int, tuple[int, str]]:
    """A* over a segment's (fault, initial): each reachable last state's (cost, audit).

    Inserts come before a row, never after the last, so that joined segments
    have one way to place them.
    """
    n = len(rows)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault = rows[i][0]
        ahead[i] = ahead[i + 1] + (3 if fault >= BLANK else 1 if fault == TRUNCATED else 0)
    queue = [(ahead[0], "", 0, start)]
    done: set[tuple[int, int]] = set()
    found: dict[int, tuple[int, str]] = {}
    while queue and len(found) < len(STATES):
        key, audit, i, state = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            found[state] = (key, audit)
            continue
        cost = key - ahead[i]
        fault, initial = rows[i]
        steps = [(3, "D", i + 1, state), (2, "I", i, FOLLOWS[state])]
        if fault < BLANK:
            own = 1 if fault == TRUNCATED else 0
            kept = state_after(state, initial)
            if kept is not None:
                steps.append((own, "K", i + 1, kept))
            if kept != FOLLOWS[state]:
                steps.append((own + 2, "R", i + 1, FOLLOWS[state]))
        for more, op, j, then in steps:
            if (j, then) not in done:
                heapq.heappush(queue, (cost + more + ahead[j], audit + op, j, then))
    return found


def _segments(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """For each segment its costs, orders and audits by first and last state, and what it adds to the report."""
    for batch in batches:
        out = []
        for conv, block, rows in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "block", "rows")), strict=True):
            costs, orders, audits = [RULED_OUT] * 16, [0] * 16, [""] * 16
            faults, initials = [r["fault"] for r in rows], [r["initial"] for r in rows]
            inside = rows[0]["at"] & ((1 << SEGMENT_BITS) - 1)  # then nothing of the conversation comes before
            for first in (NOTHING,) if inside else STATES:
                best = search(list(zip(faults, initials, strict=True)), first)
                for order, last in enumerate(sorted(best, key=lambda s: best[s][1])):
                    costs[4 * first + last], audits[4 * first + last] = best[last]
                    orders[4 * first + last] = order
            turns = [r["turn"] for r in rows if r["turn"] is not None]
            out.append(
                {"conv_id": conv, "block": block, "first_at": rows[0]["at"], "initials": initials, "costs": costs, "orders": orders, "audits": audits, "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED)}
                | {"illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "first_initial": initials[0], "last_initial": initials[-1], "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns))}
            )
        if out:
            types = {"conv_id": kind, "block": pa.int64(), "first_at": pa.int64(), "initials": pa.list_(pa.string()), "costs": pa.list_(pa.int64()), "orders": pa.list_(pa.int64()), "audits": pa.list_(pa.string())} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), pa.int64())
            types |= {"first_initial": pa.string(), "last_initial": pa.string(), "low": pa.int64(), "high": pa.int64(), "turns": pa.int64()}
            yield pa.RecordBatch.from_pylist(out, pa.schema(types))


class Fold:
    """The cheapest path through a conversation's segments, taken one by one."""

    def __init__(self) -> None:
        self.best = [(0, 0), None, None, None]  # (cost, order of the audit) of each state
        self.back: list[list[int]] = []
        self.blocks: list[int] = []
        self.count = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.last_initial = self.low = self.high = None
        self.turns = 0

    def add(self, r: dict) -> None:
        ways: list[tuple | None] = [None] * 4
        for last in STATES:
            own = [(b[0] + r["costs"][4 * s + last], b[1], r["orders"][4 * s + last], s) for s, b in enumerate(self.best) if b and r["costs"][4 * s + last] < RULED_OUT]
            ways[last] = min(own, default=None)  # equal costs: the order of what came before decides
        ranks = {w[1:3]: i for i, w in enumerate(sorted((w for w in ways if w), key=lambda w: w[1:3]))}
        self.best = [w and (w[0], ranks[w[1:3]]) for w in ways]
        self.back.append([w[3] if w else -1 for w in ways])
        self.blocks.append(r["block"])
        for name in self.count:
            self.count[name] += r[name]
        if self.last_initial is not None:
            self.count["illegal"] += self.last_initial + r["first_initial"] not in ("su", "ua", "au")
        self.last_initial = r["last_initial"]
        if r["low"] is not None:
            self.turns += r["turns"] - (r["low"] == self.high)
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]

    def rows(self, conv) -> list[dict]:
        """A row for each segment with the states it passes; the last carries the report."""
        cost, _, last = min((b[0] + 2 * TAIL[s], b[1], s) for s, b in enumerate(self.best) if b)
        tail, out = TAIL[last], []
        for block, back in zip(reversed(self.blocks), reversed(self.back), strict=True):
            out.append({"conv_id": conv, "block": block, "cell": 4 * back[last] + last, "tail": 0, "report": None})
            last = back[last]
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        out[0] |= {"tail": tail, "report": {"gaps": gaps, **self.count, "cost": cost}}
        return out


_REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _paths(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Folds segments that come sorted by conversation and block."""
    schema = pa.schema({"conv_id": kind, "block": pa.int64(), "cell": pa.int64(), "tail": pa.int64(), "report": pa.struct({name: pa.int64() for name in _REPORT})})
    own, conv, out = None, None, []
    for batch in batches:
        for r in batch.to_pylist():
            if own is None or r["conv_id"] != conv:
                out += own.rows(conv) if own else []
                own, conv = Fold(), r["conv_id"]
            own.add(r)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    out += own.rows(conv) if own else []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _steps(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The turns that a segment's edits leave: a row's place (null if inserted) and its new role (null if kept)."""
    schema = pa.schema({"conv_id": kind, "block": pa.int64(), "step": pa.int64(), "at": pa.int64(), "new_role": pa.string()})
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            state, at = r["cell"] // 4, r["first_at"]
            rest = iter(r["initials"])
            for step, op in enumerate(r["piece"]):
                initial = None if op == "I" else next(rest)
                made = {"conv_id": r["conv_id"], "block": r["block"], "step": step, "at": None if op == "I" else at, "new_role": None}
                if op in "RI":
                    state = FOLLOWS[state]
                    made["new_role"] = ROLES[state]
                elif op == "K":
                    state = state_after(state, initial)
                at += op != "I"
                if op != "D":
                    out.append(made)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


def _kinds(df: DataFrame) -> tuple[str, pa.DataType]:
    """The type of conv_id in Spark and in Arrow."""
    kind = df.schema["conv_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def _ends_well(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(WHITE)), -1, 1).isin(".", "!", "?")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The report and the repaired turns of conversations (conv_id, turn, role, text).

    The report has one row for each conversation that has rows: conv_id, gaps
    (turns missing between the first and the last), blank, duplicate,
    truncated and illegal (neighbours that can't follow each other), cost and
    audit.  The turns are (conv_id, block, step, role, text); their order in
    a conversation is (block, step), which need not be without gaps.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "repair")
    known = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")))
    known = known.withColumn("digest", F.unhex(F.md5("text"))).withColumn("made", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("digest"), F.col("made")]
    placed = known.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("at"))
    placed = scratch.table(placed, "placed")

    seen = placed.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    slim = placed.select("conv_id", "turn", "role", "digest", "at", (F.rtrim("text", F.lit(WHITE)) == "").alias("blank"), _ends_well(F.col("text")).alias("ends"))
    slim = slim.join(seen, slim.conv_id.eqNullSafe(seen.c) & (slim.role == seen.r) & (slim.digest == seen.d), "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("at") > F.col("first"), DUPLICATE).when(~F.col("ends"), TRUNCATED).otherwise(FINE)
    one = F.struct("at", fault.alias("fault"), F.substring("role", 1, 1).alias("initial"), "turn")
    segments = slim.groupBy("conv_id", F.shiftright("at", SEGMENT_BITS).alias("block")).agg(F.sort_array(F.collect_list(one)).alias("rows"))

    kind, arrow = _kinds(placed)
    report_type = f"struct<{', '.join(f'{name}: bigint' for name in _REPORT)}>"
    made = segments.mapInArrow(
        lambda batches: _segments(batches, arrow), f"conv_id {kind}, block bigint, first_at bigint, initials array<string>, costs array<bigint>, orders array<bigint>, audits array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, last_initial string, low bigint, high bigint, turns bigint"
    )
    made = scratch.table(made, "segments")
    ordered = made.drop("audits", "first_at", "initials").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    paths = ordered.mapInArrow(lambda batches: _paths(batches, arrow), f"conv_id {kind}, block bigint, cell bigint, tail bigint, report {report_type}")
    paths = paths.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "cell", "tail", "report")
    pieces = made.join(paths, made.conv_id.eqNullSafe(paths.c) & (made.block == paths.b))
    pieces = pieces.select("conv_id", "block", "first_at", "initials", "cell", F.concat(F.get("audits", F.col("cell")), F.repeat(F.lit("I"), F.col("tail").cast("int"))).alias("piece"), "report")
    pieces = scratch.table(pieces, "pieces")

    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("p"), F.first("report", ignorenulls=True).alias("report"))
    report = whole.select("conv_id", "report.*", F.array_join(F.transform("p", lambda x: x.piece), "").alias("audit"))

    steps = pieces.drop("report").mapInArrow(lambda batches: _steps(batches, arrow), f"conv_id {kind}, block bigint, step bigint, at bigint, new_role string")
    turns = steps.join(placed.select("at", "role", "text"), "at", "left")
    return report, turns.select("conv_id", "block", "step", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _hashes(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    own, conv, out = None, None, []
    schema = pa.schema({"conv_id": kind, "repaired_sha256": pa.string()})
    for batch in batches:
        for c, role, text in zip(*(batch.column(name).to_pylist() for name in ("conv_id", "role", "text")), strict=True):
            if own is None or c != conv:
                out += [{"conv_id": conv, "repaired_sha256": own.hexdigest()}] if own else []
                own, conv = hashlib.sha256(), c
            else:
                own.update(b"\n")
            own.update(f"{role}:{text}".encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    out += [{"conv_id": conv, "repaired_sha256": own.hexdigest()}] if own else []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines; texts stream past, a turn at a time."""
    kind, arrow = _kinds(turns)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "block", "step")
    return ordered.mapInArrow(lambda batches: _hashes(batches, arrow), f"conv_id {kind}, repaired_sha256 string")
