"""Counters per (tenant, metric, customer, period), lateness and the keyed upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.functions.period import hours, period_end, period_start, seconds, too_late
from tallymill.operators.bloom import might_hold
from tallymill.operators.joins import attach, lookup
from tallymill.schemas import CKEY, KEY, QTY, SUM
from tallymill.sources.work import settle


# Two quantities differ by less than this many millionths, so it separates event times.
_STEP = "decimal(21,0)"


def _step() -> Column:
    return F.lit("200000000000000000000").cast(_STEP)


def newest(ts: str = "ts", quantity: str = "quantity") -> Column:
    """Aggregate that holds the newest event and its quantity as one number: microseconds x step + millionths.

    A struct or string in the state would turn the whole aggregate into a sort; a number keeps it a
    hash aggregate, and the wide key column is not read. Equal times: the greatest quantity wins.
    """
    moment = F.unix_micros(F.col(ts)).cast("decimal(18,0)") * _step()
    return F.max((moment + (F.col(quantity) * 1000000).cast("decimal(20,0)")).cast("decimal(38,0)"))


def newest_quantity(code: str = "_newest", ts: str = "watermark_ts") -> Column:
    """The quantity in the number, given the newest event time."""
    millionths = F.col(code) - F.unix_micros(F.col(ts)).cast("decimal(18,0)") * _step()
    return (millionths.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(6,6)")).cast(QTY)


def aggregates() -> list[Column]:
    """Sum, maximum, newest event (see ``newest``) and newest event time."""
    return [
        F.sum("quantity").cast(SUM).alias("agg_sum"),
        F.max("quantity").cast(QTY).alias("agg_max"),
        newest().alias("_newest"),
        F.max("ts").alias("watermark_ts"),
    ]


def fold(events: DataFrame, keys: list[str]) -> DataFrame:
    """agg_sum, agg_max, agg_last and watermark_ts per key."""
    return (
        events.groupBy(*keys)
        .agg(*aggregates())
        .select(*keys, "agg_sum", "agg_max", newest_quantity().alias("agg_last"), "watermark_ts")
    )


def period_totals(events: DataFrame) -> DataFrame:
    """One row over all given events: sum and max are 0, last is null when there are none."""
    zero = F.lit(0)
    return fold(events, []).select(
        F.coalesce("agg_sum", zero).cast(SUM).alias("agg_sum"),
        F.coalesce("agg_max", zero).cast(QTY).alias("agg_max"),
        "agg_last",
    )


def build_counters(events: DataFrame, kind: str | Column = "monthly") -> DataFrame:
    """One row per key and period, by one partial-then-final aggregate."""
    extra = [] if isinstance(kind, str) else [kind.alias("period_kind")]
    slim = events.select(
        *KEY, "quantity", "ts", period_start(F.col("ts"), kind).alias("period_start"), *extra
    )
    built = fold(slim, CKEY + (["period_kind"] if extra else []))
    end = period_end(F.col("period_start"), F.col("period_kind") if extra else kind)
    return built.withColumn("period_end", end)


def with_settings(events: DataFrame, settings: DataFrame, lateness_hours: int = 48) -> DataFrame:
    """Attaches per-metric settings: the tenant's own row, else the row of tenant ``*``, else defaults."""
    columns = ["counter_name", "key_fields", "lateness_seconds", "period_kind"]
    own = settings.filter(F.col("tenant_id") != "*").select(
        "tenant_id", "metric", *[F.col(c).alias(f"_own_{c}") for c in columns]
    )
    shared = settings.filter(F.col("tenant_id") == "*").select(
        "metric", *[F.col(c).alias(f"_all_{c}") for c in columns]
    )
    joined = lookup(lookup(events, own, ["tenant_id", "metric"], "left"), shared, ["metric"], "left")
    defaults = {
        "counter_name": F.col("metric"),
        "key_fields": F.array(F.lit("tenant_id"), F.lit("metric"), F.lit("customer_ref"), F.lit("resource_id"), F.lit("ts")),
        "lateness_seconds": F.lit(lateness_hours * 3600).cast("bigint"),
        "period_kind": F.lit("monthly"),
    }
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(F.col(f"_own_{c}"), F.col(f"_all_{c}"), defaults[c]))
    return joined.drop(*[f"_{w}_{c}" for w in ("own", "all") for c in columns])


def affected_keys(batch: DataFrame) -> DataFrame:
    return batch.select(*KEY, period_start(F.col("ts")).alias("period_start")).distinct()


def reaggregate(ledger: DataFrame, affected: DataFrame) -> DataFrame:
    """Counters of the affected keys only, folded over the whole ledger slice of each period.

    The affected periods are one row per billing period, few enough to send to every task: on a ledger stored by
    period they prune its folders while the query runs. A Bloom filter of the affected keys then drops most other
    rows before the fold, and the exact semi join meets one row per key and task.
    """
    events = ledger if "period_start" in ledger.columns else ledger.withColumn("period_start", period_start(F.col("ts")))
    # written once: three uses below
    affected = settle(affected.select(*CKEY).distinct(), "affected-keys")
    # the comparison, true for any date, tells the optimizer that the periods are a selection worth pruning by
    periods = affected.filter(F.col("period_start") >= F.lit("0001-01-01").cast("date")).select("period_start").distinct()
    inside = events.join(F.broadcast(periods), "period_start", "left_semi").filter(might_hold(affected, CKEY))
    built = fold(inside.select(*CKEY, "quantity", "ts"), CKEY).join(affected, CKEY, "left_semi")
    return built.withColumn("period_end", period_end(F.col("period_start")))


def classify_lateness(events: DataFrame, lateness: Column | None = None) -> DataFrame:
    """Adds ``prior_watermark`` and ``lateness_class`` to arrivals that carry a ``batch_id``.

    The watermark that counts is the newest event time of the key over all earlier batches.
    """
    lateness = hours(48) if lateness is None else lateness
    keys = CKEY + ["batch_id"]
    per_batch = events.groupBy(*keys).agg(F.max("ts").alias("_newest"))
    earlier = W.partitionBy(*CKEY).orderBy("batch_id").rowsBetween(W.unboundedPreceding, -1)
    marks = per_batch.select(*keys, F.max("_newest").over(earlier).alias("prior_watermark"))
    joined = attach(events, marks, keys, "left")
    return joined.withColumn(
        "lateness_class",
        F.when(F.col("prior_watermark").isNull(), "first")
        .when(too_late(F.col("ts"), F.col("prior_watermark"), lateness), "very_late")
        .otherwise("accepted"),
    )


def settings_lateness() -> Column:
    return seconds(F.col("lateness_seconds"))


def late_adjustments(classified: DataFrame, late_status: str = "approved") -> DataFrame:
    """One adjustment per very late arrival, in the period of the event."""
    return classified.filter(F.col("lateness_class") == "very_late").select(
        F.concat(F.lit("late:"), F.col("idempotency_key")).alias("id"),
        *CKEY,
        F.col("quantity").cast(QTY).alias("delta"),
        F.lit("backfill").alias("reason"),
        F.lit("system:late-event").alias("actor"),
        F.lit(late_status).alias("status"),
        F.lit(None).cast("string").alias("parent_adjustment_id"),
        F.col("inserted_at").alias("created_at"),
    )


def fold_adjustments(adjustments: DataFrame) -> DataFrame:
    """Sum of the approved deltas per counter key, without the reversal of a reverted row.

    A reverted original is out already, so its reversal must not count a second time.
    """
    reverted = adjustments.filter(F.col("status") == "reverted").select(F.col("id").alias("parent_adjustment_id"))
    # rows without a parent get a key of their own that no id equals; as nulls they would all meet in one task
    parent = F.coalesce("parent_adjustment_id", F.concat(F.lit("\0"), F.col("id")))
    approved = adjustments.filter(F.col("status") == "approved").withColumn("parent_adjustment_id", parent)
    return (
        approved.join(reverted, "parent_adjustment_id", "left_anti")
        .groupBy(*CKEY)
        .agg(F.sum("delta").cast(SUM).alias("adjusted"))
    )


def apply_adjustments(counters: DataFrame, folded: DataFrame) -> DataFrame:
    """Adds the folded deltas to the sums; maximum and last stay. Both sides have one row per key."""
    zero = F.lit(0).cast(SUM)
    return counters.join(folded, CKEY, "full_outer").select(
        *CKEY,
        F.coalesce("period_end", period_end(F.col("period_start"))).alias("period_end"),
        (F.coalesce("agg_sum", zero) + F.coalesce("adjusted", zero)).cast(SUM).alias("agg_sum"),
        F.coalesce("agg_max", F.lit(0)).cast(QTY).alias("agg_max"),
        "agg_last",
        "watermark_ts",
    )


def counters_after_lateness(classified: DataFrame, late_status: str = "approved", other: DataFrame | None = None):
    """Counters over the arrivals that were in time, plus all approved adjustments.

    In-time and late quantities are told apart inside one aggregate. Late rows have no parent, so no reversal of
    ``other`` concerns them.
    """
    late = F.col("lateness_class") == "very_late"
    split = classified.select(
        *KEY,
        period_start(F.col("ts")).alias("period_start"),
        F.when(~late, F.col("quantity")).alias("quantity"),
        F.when(~late, F.col("ts")).alias("ts"),
        F.when(late & F.lit(late_status == "approved"), F.col("quantity")).alias("_late"),
    )
    folded = split.groupBy(*CKEY).agg(*aggregates(), F.sum("_late").cast(SUM).alias("_late"))
    zero = F.lit(0).cast(SUM)
    counted = folded.filter(F.col("watermark_ts").isNotNull() | F.col("_late").isNotNull()).select(
        *CKEY,
        period_end(F.col("period_start")).alias("period_end"),
        (F.coalesce("agg_sum", zero) + F.coalesce("_late", zero)).cast(SUM).alias("agg_sum"),
        F.coalesce("agg_max", F.lit(0)).cast(QTY).alias("agg_max"),
        newest_quantity().alias("agg_last"),
        "watermark_ts",
    )
    return counted if other is None else apply_adjustments(counted, fold_adjustments(other))


def reaggregation_reasons(events: DataFrame, lateness_hours: int = 48) -> DataFrame:
    """Per batch and affected key: initial, late_event (watermark - L is past the period start) or on_time."""
    per_batch = events.groupBy(*CKEY, "batch_id").agg(F.max("ts").alias("_newest"))
    earlier = W.partitionBy(*CKEY).orderBy("batch_id").rowsBetween(W.unboundedPreceding, -1)
    marked = per_batch.withColumn("_mark", F.max("_newest").over(earlier))
    return marked.select(
        *CKEY,
        "batch_id",
        F.when(F.col("_mark").isNull(), "initial")
        .when(F.col("_mark") - hours(lateness_hours) > F.col("period_start").cast("timestamp"), "late_event")
        .otherwise("on_time")
        .alias("reason"),
    )


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], keep_greatest: tuple[str, ...] = ()) -> DataFrame:
    """New version of a keyed table: updated rows replace old ones, new keys are added.

    Both sides must have one row per key. Columns in ``keep_greatest`` never move back.
    """
    columns = [c for c in base.columns if c not in keys]
    old = base.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in columns], F.lit(True).alias("_in_base"))
    new = updates.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_in_updates"))

    def pick(c):
        if c in keep_greatest:
            return F.greatest(f"_old_{c}", f"_new_{c}").alias(c)
        return F.when(F.col("_in_updates"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c)

    return old.join(new, keys, "full_outer").select(*keys, *[pick(c) for c in columns])


def measure(aggregation: Column) -> Column:
    """The counter value that an aggregation bills; an unknown word means sum, a missing last means 0."""
    return (
        F.when(aggregation == "max", F.col("agg_max"))
        .when(aggregation == "last", F.coalesce("agg_last", F.lit(0).cast(QTY)))
        .otherwise(F.col("agg_sum"))
        .cast(SUM)
    )
