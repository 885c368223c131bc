"""Ledger, counters, late adjustments and alerts from a stream of usage events.

Late events must not be lost, and the watermark that decides is one per counter key, so the
stream has no engine watermark: each micro-batch is checked against the tables of the earlier ones.
Every table is written under ``batch_no=<n>`` with overwrite, so a batch that is run again after a
failure replaces its own rows, and it reads rows of earlier batches only.

What a batch reads of history is bounded: keys are stored in buckets of their hash, and a batch reads the
buckets it has keys in; counters are compacted every ``COMPACT_EVERY`` batches, and a batch reads the newest
snapshot and the few batches since.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.period import hours, period_end, period_start, too_late
from tallymill.operators import alerts
from tallymill.operators.counters import apply_adjustments, fold, fold_adjustments
from tallymill.operators.dedup import first_copies, with_keys
from tallymill.operators.joins import attach
from tallymill.operators.pick import first_per_key
from tallymill.operators.validate import check_ingest, default_source
from tallymill.schemas import CKEY, QTY, SUM

_LEDGER = (
    "idempotency_key string, tenant_id string, metric string, customer_ref string, resource_id string, "
    f"quantity {QTY}, ts timestamp, meta string, source string, inserted_at timestamp, lateness_class string"
)
_COUNTERS = (
    f"tenant_id string, metric string, customer_ref string, agg_sum {SUM}, agg_max {QTY}, agg_last {QTY}, "
    "watermark_ts timestamp"
)
_KEYS = "idempotency_key string"
KEY_BUCKETS = 64
COMPACT_EVERY = 16
_ADJUSTMENTS = (
    "id string, tenant_id string, metric string, customer_ref string, period_start date, "
    f"delta {QTY}, reason string, actor string, status string, parent_adjustment_id string, created_at timestamp"
)
_ALERTS = (
    f"id string, alert_config_id string, tenant_id string, customer_ref string, metric string, value {SUM}, "
    f"threshold {QTY}, action string, status string, metadata string, triggered_at timestamp"
)


_MONTH = ["period_start date"]
#: Columns and folders (below ``batch_no``) of the tables.
_TABLES = {
    "ledger": (_LEDGER, _MONTH),
    "keys": (_KEYS, ["bucket int"]),
    "counters": (_COUNTERS, _MONTH),
    "snapshots": (_COUNTERS, _MONTH),
    "adjustments": (_ADJUSTMENTS, []),
    "alerts": (_ALERTS, []),
}


class Store(NamedTuple):
    """Tables of one stream, in a folder that all executors share."""

    root: str
    #: more for larger streams: a batch reads the buckets that its keys fall in
    key_buckets: int = KEY_BUCKETS

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def prepare(self, spark: SparkSession) -> "Store":
        for table, (schema, _) in _TABLES.items():
            spark.createDataFrame([], schema).write.mode("append").parquet(self.path(table))
        return self

    def read(self, spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
        schema, folder = _TABLES[table]
        folders = ", ".join(["batch_no int", *folder])
        rows = spark.read.schema(f"{schema}, {folders}").parquet(self.path(table)).filter(F.col("batch_no").isNotNull())
        return rows if before is None else rows.filter(F.col("batch_no") < before)

    def write(self, rows: DataFrame, table: str, batch_no: int) -> None:
        folder = [f.split(" ")[0] for f in _TABLES[table][1]]
        # rows of one folder meet in one task, so a batch writes one file per folder
        clustered = rows.repartition(*folder) if folder else rows
        clustered.write.mode("overwrite").partitionBy(*folder).parquet(f"{self.path(table)}/batch_no={batch_no}")

    def counters(self, spark: SparkSession, before: int) -> DataFrame:
        """Newest row per key before a batch: the last snapshot and the log since."""
        through = before // COMPACT_EVERY * COMPACT_EVERY
        log = self.read(spark, "counters", before).filter(F.col("batch_no") >= through)
        if through:
            log = log.unionByName(self.read(spark, "snapshots").filter(F.col("batch_no") == through - 1))
        return latest_counters(log)

    def compact(self, spark: SparkSession, batch_no: int) -> None:
        """After every ``COMPACT_EVERY`` batches, one row per key up to here."""
        if (batch_no + 1) % COMPACT_EVERY == 0:
            through = (batch_no + 1) - COMPACT_EVERY
            log = self.read(spark, "counters", batch_no + 1).filter(F.col("batch_no") >= through)
            if through:
                log = log.unionByName(self.read(spark, "snapshots").filter(F.col("batch_no") == through - 1))
            self.write(latest_counters(log), "snapshots", batch_no)

    def last_batch(self, spark: SparkSession) -> int:
        """Number of the newest batch, -1 if there is none."""
        newest = self.read(spark, "counters").agg(F.max("batch_no").alias("n")).first()["n"]
        return -1 if newest is None else newest


def latest_counters(log: DataFrame) -> DataFrame:
    """Newest row per key of the counter log."""
    return first_per_key(log, CKEY, [F.desc("batch_no")]).drop("batch_no")


def merge_counters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counters plus the fold of new, disjoint events; one row per key of ``new``."""
    before = old.select(*CKEY, *[F.col(c).alias(f"_{c}") for c in ("agg_sum", "agg_max", "agg_last", "watermark_ts")])
    newer = (
        F.col("_watermark_ts").isNull()
        | (F.col("watermark_ts") > F.col("_watermark_ts"))
        | ((F.col("watermark_ts") == F.col("_watermark_ts")) & (F.col("agg_last") > F.col("_agg_last")))
    )
    return new.join(before, CKEY, "left").select(
        *CKEY,
        (F.col("agg_sum") + F.coalesce("_agg_sum", F.lit(0).cast(SUM))).cast(SUM).alias("agg_sum"),
        F.greatest("agg_max", "_agg_max").cast(QTY).alias("agg_max"),
        F.when(newer, F.col("agg_last")).otherwise(F.col("_agg_last")).alias("agg_last"),
        F.greatest("watermark_ts", "_watermark_ts").alias("watermark_ts"),
    )


def ingest_batch(
    arrivals: DataFrame,
    batch_no: int,
    store: Store,
    now: Column,
    lateness: Column | None = None,
    late_status: str = "approved",
    alert_configs: DataFrame | None = None,
) -> None:
    """One micro-batch: check, key, deduplicate against all earlier keys, route late events, advance counters, alert."""
    spark = arrivals.sparkSession
    lateness = hours(48) if lateness is None else lateness
    checked = default_source(with_keys(check_ingest(arrivals, now)), "http").filter(F.col("error").isNull())
    bucket = F.pmod(F.xxhash64("idempotency_key"), F.lit(store.key_buckets)).cast("int")
    first = first_copies(checked.drop("error"), ["inserted_at", "seq"])
    first = _staged(first.withColumns({"period_start": period_start(F.col("ts")), "bucket": bucket}), store, "first", batch_no)
    buckets = [r["bucket"] for r in first.select("bucket").distinct().collect()]  # as many rows as buckets
    known = store.read(spark, "keys", before=batch_no).filter(F.col("bucket").isin(buckets)).select("bucket", "idempotency_key")
    new = _staged(first.join(known, ["bucket", "idempotency_key"], "left_anti"), store, "new", batch_no)
    store.write(new.select("idempotency_key", "bucket"), "keys", batch_no)

    before = store.counters(spark, batch_no).join(new.select(*CKEY).distinct(), CKEY, "left_semi")
    marks = before.select(*CKEY, F.col("watermark_ts").alias("prior_watermark"))
    classed = attach(new, marks, CKEY, "left").withColumn(
        "lateness_class",
        F.when(F.col("prior_watermark").isNull(), "first")
        .when(too_late(F.col("ts"), F.col("prior_watermark"), lateness), "very_late")
        .otherwise("accepted"),
    )
    ledger_columns = [c.split(" ")[0] for c in _LEDGER.replace("decimal(20,6)", "decimal").split(", ")]
    store.write(classed.select(*ledger_columns, "period_start"), "ledger", batch_no)
    written = store.read(spark, "ledger").filter(F.col("batch_no") == batch_no)
    late = F.col("lateness_class") == "very_late"
    adjustments = written.filter(late).select(
        F.concat(F.lit("late:"), F.col("idempotency_key")).alias("id"),
        *CKEY,
        F.col("quantity").alias("delta"),
        F.lit("backfill").alias("reason"),
        F.lit("system:late-event").alias("actor"),
        F.lit(late_status).alias("status"),
        F.lit(None).cast("string").alias("parent_adjustment_id"),
        F.col("inserted_at").alias("created_at"),
    )
    store.write(adjustments, "adjustments", batch_no)
    store.write(merge_counters(before, fold(written.filter(~late), CKEY)), "counters", batch_no)
    store.compact(spark, batch_no)
    if alert_configs is not None:
        # the month of ``now``, so only the folders of two months are read
        found = alerts.evaluate(alert_configs, current_counters(spark, store, batch_no), F.trunc(now, "MM"))
        history = store.read(spark, "alerts", before=batch_no)
        store.write(alerts.alert_records(alerts.without_cooldown(found, history, now), now), "alerts", batch_no)


def current_counters(spark: SparkSession, store: Store, through: int | None = None) -> DataFrame:
    """Counters of all batches so far, with the approved late adjustments."""
    through = store.last_batch(spark) if through is None else through
    counters = store.counters(spark, through + 1)
    folded = fold_adjustments(store.read(spark, "adjustments", through + 1))
    return apply_adjustments(counters.withColumn("period_end", period_end(F.col("period_start"))), folded)


def _staged(rows: DataFrame, store: Store, step: str, batch_no: int) -> DataFrame:
    """Written once and read by all later steps of the batch."""
    path = f"{store.root}/staged/{step}/batch_no={batch_no}"
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def start_ingest(stream: DataFrame, store: Store, checkpoint: str, now: Column, **options):
    """Runs the micro-batches over what has arrived; start it again for later arrivals."""

    def step(batch: DataFrame, batch_no: int) -> None:
        ingest_batch(batch, batch_no, store, now, **options)

    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def drop_duplicates_bounded(stream: DataFrame, horizon: str = "24 hours") -> DataFrame:
    """Cheap deduplication that forgets keys older than the horizon; the ledger check never forgets."""
    return stream.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["idempotency_key"])
