"""Interval joins by equality: dyadic covers.

A day range is cut into at most two aligned blocks per power of two, and a day lies in exactly one block of each size.
A day therefore meets exactly one block of each cover that holds it: the join's output is its matches, no month is
listed and no range filter runs behind the join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days from 0001-01-01 to 9999-12-31 fit into this many bits.
LEVELS = 22
_FIRST, _LAST = "0001-01-01", "9999-12-31"


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(_FIRST).cast("date"))


def cover(start: Column, end: Column) -> Column:
    """The blocks ``(level, block)`` of the days from start to end; the greatest date means no end.

    At each level the blocks inside the range form a run; those whose parent is not inside too belong to the cover:
    an odd first and an even last one. A null bound or an end before the start gives no block.
    """
    low = day_number(start)
    high = F.when(end >= F.lit(_LAST).cast("date"), (1 << LEVELS) - 1).otherwise(day_number(end))

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2), level)
        first = F.ceil(low / size).cast("int")
        last = F.floor((high + 1) / size).cast("int") - 1
        block = lambda wanted, b: F.when(wanted & (first <= last), F.struct(level.cast("int").alias("level"), b.alias("block")))
        return F.array(block(first % 2 == 1, first), block(last % 2 == 0, last))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))
    return F.when(low <= high, F.filter(every, lambda b: b.isNotNull()))


def blocks_of(day: Column) -> Column:
    """The block of every level that holds a day."""
    number = day_number(day)
    return F.transform(
        F.sequence(F.lit(0), F.lit(LEVELS)),
        lambda level: F.struct(level.cast("int").alias("level"), F.floor(number / F.pow(F.lit(2), level)).cast("int").alias("block")),
    )


def _spread(rows: DataFrame, blocks: Column) -> DataFrame:
    return rows.select("*", F.explode(blocks).alias("_b")).select(*rows.columns, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))


def stab(ranges: DataFrame, points: DataFrame, keys: list[str], start: Column, end: Column, day: Column) -> DataFrame:
    """Pairs of a range and a point of the same keys whose day lies in it. Other columns have different names."""
    return _spread(points, blocks_of(day)).join(_spread(ranges, cover(start, end)), [*keys, "_level", "_block"]).drop("_level", "_block")


def overlaps(ranges: DataFrame, periods: DataFrame, keys: list[str], of: tuple[str, str], period: tuple[str, str]) -> DataFrame:
    """Pairs of a range and a period of the same keys that share a day, each pair once.

    Either the range holds the period's first day, or it starts later inside the period; both are stabs.
    """
    start, end = (F.col(c) for c in of)
    first, last = (F.col(c) for c in period)
    inside = ranges.filter(start <= end)
    whole = periods.filter(first <= last)
    holds = stab(inside, whole, keys, start, end, first)
    starts = stab(whole, inside, keys, F.date_add(first, 1), last, start)
    return holds.unionByName(starts)
