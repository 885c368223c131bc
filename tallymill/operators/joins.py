"""Joins of facts with configuration and derived tables.

``lookup`` and ``attach`` are plain joins, so that statistics decide: a small side is broadcast under the session's
threshold, and otherwise the adaptive skew join splits the partitions of a hot key where both sides are plain or written
tables. ``spread`` deals the rows of hot keys itself where one side is an aggregate on the key. Nothing is counted while
a query is built, and no key is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a configuration table that has few rows per key."""
    return facts.join(dim, on, how)


def attach(facts: DataFrame, dim: DataFrame, on: list[str], how: str = "left", extra: Column | None = None) -> DataFrame:
    """Join a derived table; ``extra`` is a further condition over the columns of both sides."""
    if extra is None:
        return facts.join(dim, on, how)
    right = dim.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in dim.columns])
    condition = extra
    for c in on:
        condition = condition & (F.col(c) == F.col(f"_r_{c}"))
    return facts.join(right, condition, how).drop(*[f"_r_{c}" for c in on])


#: A key with more than one of so many parts of all rows is dealt over several tasks; there are at most as many such keys.
PARTS = 200


def spread(facts: DataFrame, dim: DataFrame, on: list[str], counts: DataFrame, n: str, by: list[str], parts: int = PARTS) -> DataFrame:
    """Inner join with a side that has one row per key and comes out of an aggregate on the key.

    The adaptive skew join cannot split such a side. ``counts`` has the rows of ``facts`` per key in ``n``: a key with
    more than a ``parts``-th of all gets a share of numbers, its facts are dealt over them by ``by`` (columns that tell
    its rows apart) and its one row is repeated for each. Every fact meets its key's row once.
    """
    most = F.ceil(counts.agg(F.sum(n).alias("n")).scalar() / parts)
    hot = counts.filter(F.col(n) > most).select(*on, F.ceil(F.col(n) / most).cast("int").alias("_salts"))
    # at most `parts` keys hold more than a `parts`-th of all rows
    hot = F.broadcast(hot)
    salted = facts.join(hot, on, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_salts")), F.lit(0).cast("bigint")))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.coalesce(F.col("_salts"), F.lit(1)).cast("bigint") - 1)
    repeated = dim.join(hot, on, "left").withColumn("_salt", F.explode(numbers)).drop("_salts")
    return salted.drop("_salts").join(repeated, [*on, "_salt"]).drop("_salt")
