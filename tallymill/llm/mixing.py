"""Mixing sources to target weights by proportionate-fair scheduling.

Each source's documents are cut into blocks of ``block`` documents. Block ``i`` (from 0) of a source with weight ``w``
may run from slot ``floor(i / w)`` on and has to by ``ceil((i + 1) / w)``; in every slot the released block with the
earliest deadline runs. Weights are exact fractions of their sum, never rounded, so every block meets its deadline and
at any slot each source has got its share of the slots so far up to less than one block. When a source has no more
blocks, a new *phase* begins: the others go on with their weights scaled up and slots counted from there.

The schedule is one row per block. Blocks hold ``block`` documents or, in larger tables, so many that about
``MOST_BLOCKS`` of them hold all; so the schedule stays small while documents are counted, numbered and placed by
Spark, and deviations stay below one block of that size. Any number of sources may take part; working the schedule out
takes time with the number of blocks and with sources times phases (at most one phase per source). No document is left
out.

Defined cases: a null source is a source of its own; sources without a target weight get none while others last and
follow in the last phases; weights may be any finite numbers, those below zero count as zero; repeated rows each get a
place; ties are settled by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16
#: About so many blocks at most, besides one that each source has; larger tables get larger blocks.
MOST_BLOCKS = 1 << 20
#: Schedules of at most so many rows are broadcast; longer ones are joined like any table.
BROADCAST_ROWS = 1 << 18
#: Hash cells of each source, numbered by themselves.
CELLS = 4096


def whole_weights(weights: dict) -> dict:
    """Weights as whole numbers in exactly the same proportions."""
    exact = {s: max(Fraction(w), Fraction(0)) for s, w in weights.items()}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * unit) for s, w in exact.items()}


def schedule(blocks: dict, weights: dict) -> list[tuple]:
    """(source, block, slot, phase) of every block. ``blocks``: how many each source has.

    Sources of weight zero wait until all others have ended, and then share alike.
    """
    left = {s: n for s, n in blocks.items() if n}
    units = whole_weights({s: weights.get(s, 0) for s in left})
    done = dict.fromkeys(left, 0)
    slots: list[tuple] = []
    phase = 0
    while left:
        active = {s: units[s] for s in left if units[s]} or dict.fromkeys(left, 1)
        total, at = sum(active.values()), len(slots)
        waiting = sorted((0, -(-total // u), str(s), s, 0) for s, u in active.items())
        ready: list = []
        ended = False
        while not ended:
            while waiting and waiting[0][0] <= len(slots) - at:
                _, deadline, name, source, k = heapq.heappop(waiting)
                heapq.heappush(ready, (deadline, name, source, k))
            _, name, source, k = heapq.heappop(ready)
            slots.append((source, done[source], len(slots), phase))
            done[source] += 1
            ended = done[source] == left[source]
            u = active[source]
            heapq.heappush(waiting, ((k + 1) * total // u, -(-(k + 2) * total // u), name, source, k + 1))
        left = {s: n for s, n in left.items() if n > done[s]}
        phase += 1
    return slots


def block_rows(documents: int, block: int = BLOCK, most: int = MOST_BLOCKS) -> int:
    """Documents per block."""
    return max(block, -(-documents // most))


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, carry: list[str] | None = None, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """``row`` (the columns ``carry`` of ``docs``, all if None; ``doc_id`` among them), ``source_name``, ``block`` (of its source), ``slot`` (of all blocks),
    ``place`` (in the block) and ``phase`` of every document. ``weights``: target weights by source (the square roots
    of the sources' sizes, if None: large sources are held back, small ones brought forward)."""
    sizes = _sizes(docs)
    weights = {s: n**0.5 for s, n in sizes.items()} if weights is None else weights
    rows = block_rows(sum(sizes.values()), block, most_blocks)
    slots = schedule({s: -(-n // rows) for s, n in sizes.items()}, weights)
    names = [_name(s) for s, _, _, _ in slots]
    numbers = [pa.array([r[k] for r in slots], kind) for k, kind in ((1, pa.int64()), (2, pa.int64()), (3, pa.int32()))]
    columns = pa.Table.from_arrays([pa.array(names, pa.string()), *numbers], names=["of", "of_block", "slot", "phase"])
    plan = docs.sparkSession.createDataFrame(columns)
    if len(slots) <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    numbered = _numbered(docs, carry or docs.columns)
    blocks = numbered.withColumn("block", F.floor(F.col("number") / rows)).withColumn("place", (F.col("number") % rows).cast("int"))
    # at most one block of documents has each key
    placed = blocks.join(plan, (F.col("source_name") == F.col("of")) & (F.col("block") == F.col("of_block")))
    return placed.select("row", "source_name", "block", "slot", "place", "phase")


def in_mixed_order(docs: DataFrame, weights: dict | None = None, block: int = BLOCK) -> DataFrame:
    """All rows and columns of ``docs``, laid out in the mixed order: written files hold it, in the order of their
    names and rows (``stored_order`` reads it back)."""
    placed = mix(docs, weights, block)
    return placed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def stored_order() -> tuple[Column, ...]:
    """The order of rows as their files hold them."""
    return F.col("_metadata.file_name"), F.col("_metadata.row_index")


def _name(source: str | None) -> str:
    return "" if source is None else f"={source}"


def _sizes(docs: DataFrame) -> dict:
    """Documents per source: one row per source, as many as a table of target weights has."""
    rows = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n")).collect()
    return {r["source"]: r["n"] for r in sorted(rows, key=lambda r: _name(r["source"]))}


def _numbered(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Numbers each source's documents in the order of a hash, without gathering a source in one task.

    Cells of hash values are counted first; a document's number is its cell's start plus its rank in the cell.
    """
    source = F.concat(F.lit("="), F.col("source").cast("string"))
    rows = docs.select(
        F.struct(*carry).alias("row"),
        F.coalesce(source, F.lit("")).alias("source_name"),
        F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))).alias("spread"),
    ).withColumn("cell", F.pmod("spread", F.lit(CELLS)))
    counts = rows.groupBy("source_name", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("source_name", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("source_name", "cell").orderBy("spread", "row.doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(own))
    return ranked.join(starts, ["source_name", "cell"]).select("row", "source_name", (F.col("start") + F.col("rank") - 1).alias("number"))
