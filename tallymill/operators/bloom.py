"""A Bloom filter of keys, built by aggregates and read as one value by the scan that it thins out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES = 3


def _positions(columns: list[Column], bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), *columns), F.lit(bits)) for k in range(HASHES)]


def bloom_words(keys: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """One row with ``words``: the filter's bits in 64-bit integers. ``bits`` is a multiple of 64 and bounds its size."""
    places = F.explode(F.array(*_positions([F.col(c) for c in columns], bits)))
    word, bit = F.shiftright("p", 6), F.expr("shiftleft(1L, cast(p & 63 AS int))")
    some = keys.select(places.alias("p")).groupBy(word.alias("id")).agg(F.bit_or(bit).alias("set"))
    every = keys.sparkSession.range(bits // 64).join(some, "id", "left").select("id", F.coalesce("set", F.lit(0).cast("long")).alias("set"))
    return every.agg(F.sort_array(F.collect_list(F.struct("id", "set")))["set"].alias("words"))


def might_hold(keys: DataFrame, columns: list[str], bits: int = 1 << 20) -> Column:
    """Condition that is true for every row whose columns are among the keys, and for few others.

    With far more keys than bits it thins nothing out; what it lets through is checked by the join behind it.
    """
    words = bloom_words(keys, columns, bits).scalar()
    found = F.lit(True)
    for p in _positions([F.col(c) for c in columns], bits):
        word = F.get(words, F.shiftright(p, 6).cast("int"))
        bit = F.call_function("shiftright", word, p.bitwiseAND(F.lit(63)).cast("int"))
        found &= bit.bitwiseAND(F.lit(1)) == 1
    return found
