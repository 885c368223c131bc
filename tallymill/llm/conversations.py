"""Conversation structure repair by rank-convergence parallel Viterbi.

A conversation's rows, in the order of their turns, are edited at least cost until the role initials read
``(s?(ua)+)?``: Keep costs 0, Rerole (to user or assistant) 1, Delete 2, Insert (an empty user or assistant turn) 5;
blank and duplicate rows must go, and a truncated row that stays costs 5 more. Of the cheapest edits the audit, their
initials in order, is the ASCII-least.

Rows are sorted by one range shuffle on (conversation, turn, role, text), so that a long conversation spreads over
tasks, and cut into chunks. The cost to finish from each state of the role automaton is a vector; a chunk maps the
vector behind it to the one before it. All chunks start from a speculative vector at once; then each takes over what
its successor found, and passes repeat for the chunks whose vector changed by more than a constant. Chunks forget
what lies far behind them, so few passes are needed. The stitched vectors drive a forward trace that picks the least
edit on a cheapest path; it streams rows in order and holds one chunk's costs at a time. The hash of a repaired
conversation is one sequential digest, so that last stream of one conversation is one task's.

Defined cases: a null role or text is one space; null turns come first; of equal turns the order is by role, then text;
rows without a conversation id are one conversation with a null id; a role with another initial than s, u or a cannot
be kept; a conversation without rows has zeros, an empty audit and the hash of nothing; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.frames import pieces
from tallymill.sources.work import settle

KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Rows of a chunk.
CHUNK = 4096
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
_FILLED = re.compile(r"[^\x20\x09-\x0D]")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
#: States: at the start, after system, after user, after assistant. What each initial leads to; None where it may not stand.
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "x": (None, None, None, None)}
#: What a rerole or an insertion writes in each state.
FORCED = ("user", "user", "assistant", "user")
AFTER = (2, 2, 3, 2)
LAWFUL = {"su", "ua", "au"}
_FAR = 1 << 40
KEY = ["no_id", "conv_id"]


# ---- the costs of one chunk -------------------------------------------------


def _with_inserts(costs: list[int]) -> list[int]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[AFTER[s]]) for s, c in enumerate(costs)]
    return costs


END = _with_inserts([0, _FAR, _FAR, 0])


@lru_cache(maxsize=4096)
def _choices(symbol: str, state: int) -> tuple[tuple[str, int, int], ...]:
    """Edit, cost and next state of a row's edits in a state, in ASCII order (without insertions)."""
    initial, kind = "suax"[(ord(symbol) - 97) // 3], (ord(symbol) - 97) % 3
    found = [("D", DELETE, state)]
    extra = CUT if kind == 2 else 0
    if kind != 1:
        if NEXT[initial][state] is not None:
            found.append(("K", KEEP + extra, NEXT[initial][state]))
        found.append(("R", REROLE + extra, AFTER[state]))
    return tuple(found)


def backward(codes: str, right: list[int]) -> list[list[int]]:
    """Costs to finish before each row of a chunk and behind the last, given those behind it."""
    costs = [right]
    for symbol in reversed(codes):
        after = costs[-1]
        costs.append(_with_inserts([min(c + after[n] for _, c, n in _choices(symbol, s)) for s in range(4)]))
    return costs[::-1]


def steps(symbol: str, state: int, before: list[int], after: list[int]) -> Iterator[tuple[str, int, int]]:
    """The least edits on a cheapest path up to and with one row: edit, cost, next state."""
    while True:
        found = next(
            (x for x in _choices(symbol, state) if x[1] + after[x[2]] == before[state] and (x[0] < "I" or not _inserts(before, state))),
            None,
        )
        if found is not None:
            yield found
            return
        state = AFTER[state]
        yield "I", INSERT, state


def _inserts(before: list[int], state: int) -> bool:
    return INSERT + before[AFTER[state]] == before[state]


def endings(state: int) -> Iterator[int]:
    """States that insertions reach behind the last row."""
    while state in (1, 2):
        state = AFTER[state]
        yield state


# ---- rows in order ----------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (it stays as not ``present``),
    1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes its role user. Nulls are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text_of("text"), "[.!?]", "")).otherwise(text_of("text"))
    rows = conversations.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(text_of("role")).alias("role"),
        text.alias("text"),
        (fate != 0).alias("present"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


_ROW = "no_id boolean, conv_id long, part int, place long, present boolean, turn long, role string, text string, initial int, fault int"


def _marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place, role class and first fault of sorted rows; duplicates as far as this task's rows of a conversation show."""
    part, place, own, seen = TaskContext.get().partitionId(), 0, None, set()
    for batch in pieces(batches, rows=5000):
        rows = batch.to_pydict()
        initials, faults = [], []
        for no_id, conv_id, present, role, text in zip(*[rows[c] for c in ("no_id", "conv_id", "present", "role", "text")]):
            if own != (no_id, conv_id):
                own, seen = (no_id, conv_id), set()
            initials.append(max(0, "suax".find(role[:1])) if role[:1] in ("s", "u", "a") else 3)
            fault = NONE
            if present:
                words = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
                last = text.rstrip(_SPACE)[-1:]
                fault = BLANK if not last else DUPLICATE if words in seen else NONE if last in ".!?" else TRUNCATED
                seen.add(words)
            faults.append(fault)
        n = batch.num_rows
        yield pa.RecordBatch.from_pydict(
            {
                "no_id": batch.column("no_id"),
                "conv_id": batch.column("conv_id"),
                "part": pa.array([part] * n, type=pa.int32()),
                "place": pa.array(range(place, place + n), type=pa.int64()),
                "present": batch.column("present"),
                "turn": batch.column("turn"),
                "role": batch.column("role"),
                "text": batch.column("text"),
                "initial": pa.array(initials, type=pa.int32()),
                "fault": pa.array(faults, type=pa.int32()),
            }
        )
        place += n


def marked(rows: DataFrame) -> DataFrame:
    """The rows with their order (``part``, ``place``), role class and first fault, as stored files."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    present = F.coalesce("present", F.lit(True)) if "present" in rows.columns else F.lit(True)
    slim = rows.select(
        F.col("conv_id").isNull().alias("no_id"),
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"),
        F.col("turn").cast("long"),
        space("role"),
        space("text"),
        present.alias("present"),
    )
    ranged = slim.repartitionByRange(*KEY, "turn", "role", F.substring("text", 1, 16))
    stored = settle(ranged.sortWithinPartitions(*KEY, "turn", "role", "text").mapInArrow(_marked, _ROW), "turns")
    # only conversations that range over several parts can have copies that one task did not see together
    spread = stored.groupBy(*KEY).agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    spread = settle(spread.select(*KEY), "spread")
    wide = stored.where("present").join(spread, KEY, "left_semi")
    first = settle(wide.groupBy(*KEY, "role", "text").agg(F.min("part").alias("first_part")), "first-parts")
    copies = wide.join(first, [*KEY, "role", "text"]).where("part > first_part").select("part", "place", F.lit(True).alias("copy"))
    late = F.col("copy") & (F.col("fault") != BLANK)
    joined = stored.join(settle(copies, "copies"), ["part", "place"], "left")
    return joined.withColumn("fault", F.when(late, DUPLICATE).otherwise(F.col("fault"))).drop("copy")


# ---- chunks and their costs -------------------------------------------------


def _level(costs: list[int]) -> list[int]:
    """The vector less its least cost: vectors that differ by a constant become equal."""
    return [c - min(costs) for c in costs]


def _left(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reruns the chunks that are due and leaves the others."""
    for batch in pieces(batches):
        left = batch.column("left").to_pylist()
        for k, (due, codes, right) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("due", "codes", "right")])):
            if due:
                left[k] = _level(backward(codes, right)[0])
        columns = [pa.array(left, type=pa.list_(pa.int64())) if n == "left" else batch.column(n) for n in batch.schema.names]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


_CHUNK = "no_id boolean, conv_id long, part int, chunk long, codes string, right array<long>, left array<long>, due boolean"


def chunk_costs(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """``codes`` (a symbol per present row) and ``right`` (costs behind the chunk, up to a constant) of every chunk."""
    kind = F.when(F.col("fault").isin(BLANK, DUPLICATE), 1).when(F.col("fault") == TRUNCATED, 2).otherwise(0)
    symbol = F.char(F.lit(97) + F.col("initial") * 3 + kind)
    chunk = F.floor(F.col("place") / size).alias("chunk")
    lists = rows.where("present").groupBy(*KEY, "part", chunk).agg(F.sort_array(F.collect_list(F.struct("place", symbol.alias("c")))).alias("l"))
    order = Window.partitionBy(*KEY).orderBy("part", "chunk")
    last = F.lead("part").over(order).isNull()
    end, any_end = (F.array(*[F.lit(c).cast("long") for c in v]) for v in (_level(END), [0, 0, 0, 0]))
    nothing = F.lit(None).cast("array<long>")
    now = lists.select(*KEY, "part", "chunk", F.array_join(F.col("l.c"), "").alias("codes")).select(
        "*", F.when(last, end).otherwise(any_end).alias("right"), nothing.alias("left"), F.lit(True).alias("due")
    )
    now = settle(now.mapInArrow(_left, _CHUNK), "costs")
    while True:
        behind = F.coalesce(F.lead("left").over(order), F.col("right"))
        fixed = now.withColumn("behind", behind).select(
            *KEY, "part", "chunk", "codes", F.col("behind").alias("right"), "left", (F.col("behind") != F.col("right")).alias("due")
        )
        fixed = settle(fixed.mapInArrow(_left, _CHUNK), "costs")
        if fixed.where("due").isEmpty():
            return fixed.select(*KEY, "part", "chunk", "codes", "right")
        now = fixed


# ---- the trace --------------------------------------------------------------


class _Trace:
    """One conversation's edits and counts while its rows stream by."""

    def __init__(self):
        self.state, self.cost, self.audit, self.digest, self.written = 0, 0, [], hashlib.sha256(), 0
        self.faults, self.illegal, self.before = [0, 0, 0, 0], 0, None
        self.turns, self.low, self.high = 0, None, None

    def see(self, turn, role, fault):
        if turn is not None and turn != self.high:
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        self.faults[fault] += 1
        if self.before is not None and self.before + role[:1] not in LAWFUL:
            self.illegal += 1
        self.before = role[:1]

    def edit(self, name, cost, role, text):
        self.audit.append(name)
        self.cost += cost
        if role is None:
            return []
        line = f"{role}:{text}".encode("utf-8", "surrogatepass")
        self.digest.update(b"\n" + line if self.written else line)
        self.written += 1
        return [(name, role, text)]

    def row(self, symbol, before, after, role, text):
        kept = []
        for name, cost, state in steps(symbol, self.state, before, after):
            new_role = {"D": None, "K": role}.get(name, FORCED[self.state])
            kept += self.edit(name, cost, new_role, "" if name == "I" else text)
            self.state = state
        return kept

    def finish(self):
        kept = []
        for state in endings(self.state):
            kept += self.edit("I", INSERT, FORCED[self.state], "")
            self.state = state
        return kept

    def summary(self):
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "conv_id long, place long, edit string, role string, text string"


def _traced(batches: Iterable[pa.RecordBatch], rows_too: bool) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string()}
    named = [c.split() for c in (ROWS if rows_too else SUMMARY).split(", ")]
    schema = pa.schema([(name, kinds[kind]) for name, kind in named])
    own, trace, out, costs, codes, at, written = None, None, [], [], "", 0, 0

    def ended():
        nonlocal written
        kept = trace.finish()
        conv_id = None if own[0] else own[1]
        if rows_too:
            out.extend((conv_id, written + k, *x) for k, x in enumerate(kept))
            written = 0
        else:
            out.append((conv_id, *trace.summary()))

    def batch_of():
        columns = list(zip(*out)) if out else [[] for _ in schema]
        made = pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
        out.clear()
        return made

    for batch in pieces(batches, rows=5000):
        names = ["no_id", "conv_id", "head", "present", "turn", "role", "text", "fault", "codes", "right"]
        for no_id, conv_id, head, present, turn, role, text, fault, new_codes, right in zip(*[batch.column(c).to_pylist() for c in names]):
            if own != (no_id, conv_id):
                if own is not None:
                    ended()
                own, trace = (no_id, conv_id), _Trace()
            if head:
                codes, costs, at = new_codes, backward(new_codes, right), 0
            elif present:
                trace.see(turn, role, fault)
                kept = trace.row(codes[at], costs[at], costs[at + 1], role, text)
                at += 1
                if rows_too:
                    out.extend((conv_id if not no_id else None, written + k, *x) for k, x in enumerate(kept))
                    written += len(kept)
        yield batch_of()
    if own is not None:
        ended()
        yield batch_of()


def _streamed(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows and the head of each chunk before them, in order within a conversation."""
    stored = marked(rows)
    costs = chunk_costs(stored, chunk)
    body = stored.select(
        *KEY, "part", F.floor(F.col("place") / chunk).alias("chunk"), "place", F.lit(False).alias("head"), "present", "turn", "role", "text",
        "fault", F.lit(None).cast("string").alias("codes"), F.lit(None).cast("array<long>").alias("right"),
    )
    nothing = {"place": "long", "present": "boolean", "turn": "long", "role": "string", "text": "string", "fault": "int"}
    heads = costs.select(
        *KEY, "part", "chunk", F.lit(True).alias("head"), "codes", "right", *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()]
    )
    both = body.unionByName(heads)
    return both.repartition(*KEY).sortWithinPartitions(*KEY, "part", "chunk", F.desc("head"), "place")


def repair(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per conversation its faults before the repair, the cost and audit of the repair and the hash of the result.

    ``rows`` has conv_id, turn, role, text and perhaps ``present``: rows that are not only name their conversation.
    """
    return _streamed(rows, chunk).mapInArrow(lambda b: _traced(b, False), SUMMARY)


def repaired_rows(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The repaired conversations: ``place`` from 0, the ``edit`` that left the row (K, R or I), role and text."""
    return _streamed(rows, chunk).mapInArrow(lambda b: _traced(b, True), ROWS)
