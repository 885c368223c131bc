"""One row per key by an order.

A row number that is filtered to 1 lets Spark limit each key to one row before the shuffle
(window group limit), so a key that holds a large part of the rows sends one row per map task;
and, unlike an aggregate over whole rows, it leaves unused columns prunable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key; rows that tie must be equal."""
    numbered = rows.withColumn("_number", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.filter(F.col("_number") == 1).drop("_number")
