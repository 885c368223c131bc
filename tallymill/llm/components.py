"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.sources.work import settle


def _stars(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour (edges in both directions)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("a"))
    return moved.select(F.col("m").alias("a"), "b").distinct()


def _hang(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them (``a`` is the smaller end)."""
    least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    joined = edges.join(least, F.col("b") == F.col("u"))
    handed = joined.where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b"))
    return handed.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) of every node that has a link.

    Columns ``a`` and ``b`` hold two different ends. Rounds are written to the shared folder, so each reads only
    the links that the one before left; their number grows with the logarithm of a component's length.
    """
    now = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    mark = None
    while True:
        now = settle(_hang(_stars(now)), "stars")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == (seen["n"], seen["h"]):
            break
        mark = seen["n"], seen["h"]
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
