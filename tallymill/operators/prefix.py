"""Ordered computations over groups that may be large.

A window over a whole group would put a hot group into one task. Here rows are first
handled inside chunks of consecutive positions, then the few chunk summaries are combined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.schemas import SUM

CHUNK = 100_000


def _chunk(position: str, size: int) -> Column:
    return F.floor(F.col(position) / size).cast("bigint")


def running_sum(
    rows: DataFrame, keys: list[str], position: str, value: str, out: str, size: int = CHUNK
) -> DataFrame:
    """Adds ``out``, the sum of ``value`` over the rows of the group before this one.

    ``position`` is a whole number, unique within a group.
    """
    marked = rows.withColumn("_chunk", _chunk(position, size))
    inside = W.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    chunk_sums = (
        marked.groupBy(*keys, "_chunk")
        .agg(F.sum(value).cast(SUM).alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(across), F.lit(0)).cast(SUM))
        .drop("_sum")
    )
    return (
        marked.withColumn("_within", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast(SUM))
        .join(chunk_sums, keys + ["_chunk"])
        .withColumn(out, (F.col("_before") + F.col("_within")).cast(SUM))
        .drop("_chunk", "_before", "_within")
    )


def prefix_totals(rows: DataFrame, keys: list[str], position: str, value: str, size: int = CHUNK) -> DataFrame:
    """Per group the total of ``value`` and the greatest running sum (``total``, ``peak``)."""
    marked = rows.withColumn("_chunk", _chunk(position, size))
    inside = W.partitionBy(*keys, "_chunk").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = (
        marked.withColumn("_running", F.sum(value).over(inside).cast(SUM))
        .groupBy(*keys, "_chunk")
        .agg(F.sum(value).cast(SUM).alias("_sum"), F.max("_running").alias("_peak"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(across), F.lit(0)).cast(SUM))
    )
    return chunks.groupBy(*keys).agg(
        F.sum("_sum").cast(SUM).alias("total"), F.max(F.col("_before") + F.col("_peak")).cast(SUM).alias("peak")
    )


def previous_by_value(
    rows: DataFrame, keys: list[str], order: str, carried: list[str], parts: int = 64
) -> DataFrame:
    """Adds ``previous_<column>`` of the row before in the order of a numeric column, unique within the group.

    Each group is cut at its own approximate quantiles into ``parts`` ranges of about as many rows; the first row of a
    range looks at the last row of the nearest earlier range.
    """
    shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    cuts = rows.groupBy(*keys).agg(F.percentile_approx(F.col(order).cast("double"), shares, 10 * parts).alias("_cuts"))
    place = F.size(F.filter("_cuts", lambda c: c < F.col(order).cast("double")))
    marked = rows.join(cuts, keys).withColumn("_chunk", place).drop("_cuts")
    inside = W.partitionBy(*keys, "_chunk").orderBy(order)
    across = W.partitionBy(*keys).orderBy("_chunk")
    ends = marked.groupBy(*keys, "_chunk").agg(
        F.max_by(F.struct(*carried), F.col(order)).alias("_end")
    )
    ends = ends.withColumn("_earlier", F.lag("_end").over(across)).drop("_end")
    joined = marked.withColumn("_near", F.lag(F.struct(*carried)).over(inside)).join(ends, keys + ["_chunk"])
    for c in carried:
        joined = joined.withColumn(
            f"previous_{c}",
            F.when(F.col("_near").isNotNull(), F.col("_near")[c]).otherwise(F.col("_earlier")[c]),
        )
    return joined.drop("_chunk", "_near", "_earlier")
