"""Distinct items over any range of months from small sketches, one per metric and month.

The reports are read once; a range of months is a union of sketches, items of two months are an intersection. Counts are
exact up to ``2**SIZE`` distinct items of a metric and off by about ``2**(-SIZE / 2)`` of them beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 14


def item_sketches(found: DataFrame, size: int = SIZE) -> DataFrame:
    """``items`` and ``drifting``, the sketches of all reported items and of those to investigate, per tenant, metric and month."""
    item = F.struct("tenant_id", "subscription_item_id")
    drifting = F.when(F.col("status") == "investigate", F.xxhash64(item))
    return found.groupBy("tenant_id", "metric", "period_start").agg(
        F.theta_sketch_agg(F.xxhash64(item), size).alias("items"), F.theta_sketch_agg(drifting, size).alias("drifting")
    )


def _between(first: str, last: str) -> Column:
    return F.col("period_start").between(F.lit(f"{first}-01").cast("date"), F.lit(f"{last}-01").cast("date"))


def items_over(sketches: DataFrame, first: str, last: str, size: int = SIZE) -> DataFrame:
    """Distinct items and drifting items per metric over the months ``first`` to ``last`` (``YYYY-MM``)."""
    merged = sketches.filter(_between(first, last)).groupBy("metric").agg(
        F.theta_union_agg("items", size).alias("items"), F.theta_union_agg("drifting", size).alias("drifting")
    )
    return merged.select("metric", *[F.theta_sketch_estimate(c).alias(c) for c in ("items", "drifting")])


def drifting_in_both(sketches: DataFrame, one: tuple[str, str], other: tuple[str, str], size: int = SIZE) -> DataFrame:
    """Per metric, the distinct items that drifted in both ranges of months; metrics without any in either range give 0."""
    part = lambda months: F.theta_union_agg(F.when(_between(*months), F.col("drifting")), size)
    merged = sketches.filter(_between(*one) | _between(*other)).groupBy("metric").agg(part(one).alias("_a"), part(other).alias("_b"))
    return merged.select("metric", F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).alias("items"))
