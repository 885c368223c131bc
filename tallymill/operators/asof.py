"""As-of join: the newest fact at or before a time, with a hot key spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.sources.work import settle


def _usable(facts: DataFrame, keys: list[str], fact_at: str) -> DataFrame:
    return facts.dropna(subset=[*keys, fact_at])


def _by_slices(points: DataFrame, facts: DataFrame, keys: list[str], at: str, fact_at: str, carried: list[str], unit: str) -> DataFrame:
    place = [*keys, "_slice"]
    fact = F.struct(F.col(fact_at).alias("at"), F.struct(*carried).alias("values"))
    own = _usable(facts, keys, fact_at).groupBy(*keys, F.date_trunc(unit, fact_at).alias("_slice")).agg(
        F.sort_array(F.collect_list(fact)).alias("_own")
    )
    wanted = points.select(*keys, F.date_trunc(unit, at).alias("_slice")).dropna().distinct()
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    grid = wanted.join(own, place, "full_outer")
    before = F.last(F.try_element_at("_own", F.lit(-1)), ignorenulls=True).over(earlier)
    grid = grid.select(*place, F.array_compact(F.concat(F.array(before), F.coalesce("_own", F.array()))).alias("_known"))
    known = points.withColumn("_slice", F.date_trunc(unit, at)).join(grid.filter(F.size("_known") > 0), place, "left")
    found = F.try_element_at(F.filter("_known", lambda f: f["at"] <= F.col(at)), F.lit(-1))["values"]
    return known.withColumn("_found", found).select(*points.columns, *[F.col("_found")[c].alias(c) for c in carried])


def as_of(
    points: DataFrame, facts: DataFrame, keys: list[str], at: str, fact_at: str, carried: list[str], slices: str | None = None
) -> DataFrame:
    """``points`` with the columns ``carried`` of the newest fact of their keys at or before ``at``; null without one.

    Points and facts are dealt to ranges of (keys, time), so one key's history is in several ranges if it is long.
    Inside a range the newest fact is a running value; a range's first points take it from the nearest earlier range
    of their key, of which there is one row per key and range. Of facts at one time the greatest values count.
    Facts with a null key or time are no facts; a point with a null key or time finds none.

    ``slices`` (a unit of ``date_trunc``) serves facts that are few per key and slice: each key and slice gets one
    row with its facts and the one before them, and points meet that row by an equality join, unsorted.
    """
    if slices is not None:
        return _by_slices(points, facts, keys, at, fact_at, carried, slices)
    fact = F.struct(*carried)
    # which of equal times comes first does not matter among points: their hash spreads them over ranges
    rows = points.select(
        *keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.xxhash64(*points.columns).alias("_spread"),
        F.lit(None).cast(facts.select(fact.alias("f")).schema["f"].dataType).alias("_fact"), F.struct(*points.columns).alias("_row"),
    )
    history = _usable(facts, keys, fact_at).select(
        *keys, F.col(fact_at).alias("_at"), F.lit(0).alias("_side"), F.lit(0).cast("long").alias("_spread"),
        fact.alias("_fact"), F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"),
    )
    order = [*keys, "_at", "_side", "_spread"]
    dealt = history.unionByName(rows).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    dealt = settle(dealt, "as-of")
    place = ["_part", *keys]
    so_far = W.partitionBy(*place).orderBy("_at", "_side", "_fact").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = dealt.withColumn("_near", F.last("_fact", ignorenulls=True).over(so_far)).filter("_side = 1")
    newest = F.max(F.when(F.col("_side") == 0, F.struct("_at", "_fact")))["_fact"]
    ends = dealt.groupBy(*place).agg(newest.alias("_end"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    handed = ends.withColumn("_handed", F.last("_end", ignorenulls=True).over(before)).filter(F.col("_handed").isNotNull())
    joined = near.join(handed.select(*place, "_handed"), place, "left").withColumn("_found", F.coalesce("_near", "_handed"))
    return joined.select("_row.*", *[F.col("_found")[c].alias(c) for c in carried])
