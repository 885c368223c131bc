"""Bulk imports, their accounting and status, and replays."""

from __future__ import annotations

from datetime import datetime
from typing import Callable, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions import identity
from tallymill.functions.period import hours, in_period, period_start
from tallymill.operators.adjustments import latest_version
from tallymill.operators.counters import affected_keys, build_counters, upsert
from tallymill.operators.dedup import insert_if_absent
from tallymill.operators.joins import attach
from tallymill.schemas import CKEY, OPERATION_STATUSES, SUM
from tallymill.sources.work import settle

TIMED_OUT = "Operation timed out"
# rows of an import have no arrival number; equal rows are interchangeable, others are ordered by content
CONTENT_ORDER = ["ts", "tenant_id", "metric", "customer_ref", "resource_id", "quantity", "meta", "source"]


class Import(NamedTuple):
    inserted: DataFrame
    quarantined: DataFrame
    affected: DataFrame
    accounting: DataFrame


def filter_backfill(events: DataFrame, customer: str | None, first_day: str, last_day: str | None = None) -> DataFrame:
    """Events of the customer (all without one) and of the days, both ends included."""
    days = in_period(F.col("ts"), F.lit(first_day).cast("date"), F.lit(last_day or first_day).cast("date"))
    kept = events.filter(days)
    return kept if customer is None else kept.filter(F.col("customer_ref") == customer)


def flagged(loaded: DataFrame, first_day: str, last_day: str | None = None, customer: str | None = None) -> DataFrame:
    """Loaded rows (with ``errors``) and ``wanted``: without errors, of the customer and of the days; keys resolved."""
    days = in_period(F.col("ts"), F.lit(first_day).cast("date"), F.lit(last_day or first_day).cast("date"))
    own = F.lit(True) if customer is None else F.col("customer_ref") == customer
    key = F.coalesce(identity.blank_to_null(F.col("idempotency_key")), identity.idempotency_key())
    return loaded.withColumn("wanted", F.coalesce((F.size("errors") == 0) & days & own, F.lit(False))).withColumn(
        "idempotency_key", F.when(F.col("wanted"), key).otherwise(F.col("idempotency_key"))
    )


def backfill(
    loaded: DataFrame, ledger: DataFrame | None, first_day: str, last_day: str | None = None, customer: str | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows,
) -> Import:
    """Valid rows that pass the filter and are new enter the ledger.

    ``loaded`` has ``errors`` per row. Accounting: total rows, processed (inserted), failed (with errors),
    duplicates (passed the filter, but were there already); filtered rows count in the total only.
    ``keep`` may write a step and read it back: the flagged rows serve all results, the inserted ones two.
    """
    rows = keep(flagged(loaded, first_day, last_day, customer), "import-rows")
    wanted = rows.filter("wanted").drop("errors", "wanted")
    new = insert_if_absent(wanted, ledger, CONTENT_ORDER).withColumn("period_start", period_start(F.col("ts")))
    inserted = keep(new, "import-new")
    processed = inserted.agg(F.count("*").alias("n")).scalar()
    accounting = rows.agg(
        F.count("*").alias("total_events"),
        F.count_if(F.size("errors") > 0).alias("failed_events"),
        F.count_if("wanted").alias("_considered"),
    ).select(
        "total_events",
        processed.alias("processed_events"),
        "failed_events",
        (F.col("_considered") - processed).alias("duplicate_events"),
    )
    quarantined = rows.filter(F.size("errors") > 0).drop("wanted")
    return Import(inserted, quarantined, affected_keys(inserted), accounting)


def run_backfill(
    spark: SparkSession,
    load: Callable[[], DataFrame],
    operation: dict,
    ledger: DataFrame | None,
    started: datetime,
    completed: Callable[[], datetime] | None = None,
) -> tuple[Import | None, DataFrame]:
    """Loads and imports; returns the import and its operation row, written from what happened.

    The import runs here: its rows are written to the work folder, and the counts are those of the written rows.
    A source that cannot be found, read or parsed gives a failed row with the message and no import.
    ``completed`` gives the time of the end (the start, if it is left out).
    """
    counts = ["total_events", "processed_events", "failed_events", "duplicate_events"]
    done, numbers, status, message = None, [0] * len(counts), "completed", None
    try:
        done = backfill(
            load(), ledger, str(operation["period_start"]),
            str(operation.get("period_end") or operation["period_start"]), operation.get("customer_ref"), settle,
        )
        numbers = list(done.accounting.select(*counts).first())
    except (PySparkException, Py4JJavaError) as problem:
        done, status, message = None, "failed", _first_line(problem)
    row = (
        operation["id"], operation["tenant_id"], operation["metric"], operation["period_start"],
        operation.get("period_end") or operation["period_start"], started, completed() if completed else started,
        *numbers, status, message,
    )
    kinds = (
        "id string, tenant_id string, metric string, period_start date, period_end date, started_at timestamp, "
        f"completed_at timestamp, {', '.join(f'{c} bigint' for c in counts)}, status string, error_message string"
    )
    return done, spark.createDataFrame([row], kinds)


def _first_line(problem: Exception) -> str:
    """What went wrong, without the trace; a failed task names its cause last."""
    java = getattr(problem, "java_exception", None)
    while java is not None and java.getCause() is not None:
        java = java.getCause()
    return str(problem if java is None else java.toString()).strip().splitlines()[0]


def operations_by_status(operations: DataFrame) -> DataFrame:
    """Number of operations in total and per status; statuses without any give 0."""
    return operations.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in OPERATION_STATUSES]
    )


def current_operations(versions: DataFrame) -> DataFrame:
    """Latest status row per operation."""
    return latest_version(versions, "id", "updated_at")


def stuck_operations(operations: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    limit = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    return operations.filter((F.col("status") == "processing") & (F.col("started_at") <= limit))


def cancel_stuck(operations: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    """New versions of the stuck operations."""
    return (
        stuck_operations(operations, now, minutes)
        .withColumn("status", F.lit("cancelled"))
        .withColumn("error_message", F.lit(TIMED_OUT))
        .withColumn("completed_at", now)
    )


# ---- replay -----------------------------------------------------------------


def filter_window(events: DataFrame, now: Column, window_hours: int = 24) -> DataFrame:
    return events.filter(F.col("ts") >= now - hours(window_hours))


def replay_file(loaded: DataFrame, ledger: DataFrame | None, now: Column, window_hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """Sends file rows of the window to the ledger: (inserted rows, one row of counts)."""
    in_window = filter_window(loaded, now, window_hours)
    done = backfill(in_window, ledger, "0001-01-01", "9999-12-30")
    counts = done.accounting.select(
        loaded.agg(F.count("*").alias("n")).scalar().alias("total"),
        F.col("total_events").alias("considered"),
        F.col("processed_events").alias("sent"),
        F.col("duplicate_events").alias("duplicates"),
        F.col("failed_events").alias("errors"),
    )
    return done.inserted, counts


class Replay(NamedTuple):
    counters: DataFrame
    customers: DataFrame
    changes: DataFrame
    summary: DataFrame


def replay(
    ledger: DataFrame,
    counters: DataFrame,
    tenant: str,
    metrics: list[str],
    since: datetime,
    until: datetime,
    apply: bool = False,
    lateness_hours: int = 48,
) -> Replay:
    """Recounts the keys that have events in a time range, and compares with the stored counters.

    ``late_events`` are events of the range older than the stored watermark less the lateness window.
    ``changes`` has one row per metric; the affected customers are rows of ``customers``, since their
    number has no bound. With ``apply``, ``counters`` is the new counter table, else the stored one.
    """
    own = ledger.filter((F.col("tenant_id") == tenant) & F.col("metric").isin(metrics))
    moment = lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp")
    keyed = own if "period_start" in own.columns else own.withColumn("period_start", period_start(F.col("ts")))
    found = keyed.filter((F.col("ts") >= moment(since)) & (F.col("ts") <= moment(until)))
    counts = found.groupBy(*CKEY).agg(F.count("*").alias("_found"))
    stored = counters.select(*CKEY, "watermark_ts", "agg_sum")
    late = (
        attach(found.select(*CKEY, "ts", "idempotency_key"), stored.select(*CKEY, "watermark_ts"), CKEY, "left")
        .filter(F.col("ts") < F.col("watermark_ts") - hours(lateness_hours))
        .groupBy(*CKEY)
        .agg(F.count("*").alias("late_events"))
    )
    months = keyed.filter(F.col("period_start") <= period_start(moment(until))).filter(
        F.col("period_start") >= period_start(moment(since))
    )
    fresh = build_counters(months.drop("period_start")).join(counts.select(*CKEY), CKEY, "left_semi")
    customers = (
        fresh.select(*CKEY, F.col("agg_sum").alias("_new"))
        .join(counts, CKEY)
        .join(stored.drop("watermark_ts"), CKEY, "left")
        .join(late, CKEY, "left")
        .select(
            *CKEY,
            F.col("_found").alias("events_found"),
            F.coalesce("late_events", F.lit(0)).cast("bigint").alias("late_events"),
            (F.col("_new") - F.coalesce("agg_sum", F.lit(0).cast(SUM))).cast(SUM).alias("counter_delta"),
        )
    )
    changes = customers.groupBy("metric").agg(
        F.sum("events_found").alias("events_found"),
        F.sum("late_events").alias("late_events"),
        F.sum("counter_delta").cast(SUM).alias("counter_delta"),
        F.count_distinct("customer_ref").alias("affected_customers"),
    )
    verb = "Updated" if apply else "Would update"
    total = customers.agg(F.count_if(F.col("counter_delta") != 0).alias("n"), F.coalesce(F.sum("counter_delta"), F.lit(0)).cast("decimal(38,2)").alias("d"))
    summary = total.select(
        F.concat(
            F.lit(f"{verb} "), F.col("n").cast("string"), F.lit(" counters with "),
            F.when(F.col("d") >= 0, "+").otherwise(""), F.col("d").cast("string"), F.lit(" total delta"),
        ).alias("summary")
    )
    merged = upsert(counters, fresh.select(*counters.columns), CKEY, ("watermark_ts",)) if apply else counters
    return Replay(merged, customers, changes, summary)


def event_stats(results: DataFrame, classified: DataFrame) -> DataFrame:
    """Processed, late and duplicate events and the newest event time, over ingest results and classified arrivals."""
    count = lambda status: results.agg(F.count_if(F.col("status") == status).alias("n")).scalar()
    return classified.agg(
        F.count_if(F.col("lateness_class") == "very_late").alias("late_events"), F.max("ts").alias("last_event_time")
    ).select(
        count("accepted").alias("total_processed"), count("duplicate").alias("duplicates_filtered"), "late_events", "last_event_time"
    )
