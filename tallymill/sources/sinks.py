"""Writers: ledger, keyed tables, CSV exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tallymill.functions.identity import iso_millis
from tallymill.functions.period import period_start
from tallymill.operators.counters import upsert
from tallymill.operators.recon import SUMMARY_CSV, report_csv, summary_with_total
from tallymill.sources.work import settle

# Header of the event export.
EVENT_CSV = ["tenantId", "metric", "customerRef", "resourceId", "quantity", "ts", "source", "meta", "idempotencyKey"]


def append_ledger(events: DataFrame, path: str, slices: int = 16) -> None:
    """Adds accepted events to the ledger, in folders per period.

    Rows are shuffled by period and key slice, so a period gets at most ``slices`` files per append
    and a month that holds most of the rows is written by several tasks.
    """
    rows = events if "period_start" in events.columns else events.withColumn("period_start", period_start(F.col("ts")))
    sliced = rows.repartition(F.col("period_start"), F.pmod(F.xxhash64("idempotency_key"), F.lit(slices)))
    sliced.write.partitionBy("period_start").mode("append").parquet(path)


def plain_number(quantity: Column) -> Column:
    """A decimal as text without trailing zeros."""
    return F.regexp_replace(quantity.cast("decimal(20,6)").cast("string"), r"\.?0+$", "")


def events_for_export(events: DataFrame) -> DataFrame:
    """The columns of the export; a ``seq`` column is kept behind them."""
    columns = set(events.columns)
    text = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    quantity = F.col("quantity")
    return events.select(
        F.col("tenant_id").alias("tenantId"),
        "metric",
        F.col("customer_ref").alias("customerRef"),
        text("resource_id").alias("resourceId"),
        (quantity if dict(events.dtypes)["quantity"] == "string" else plain_number(quantity)).alias("quantity"),
        (F.col("ts") if dict(events.dtypes)["ts"] == "string" else iso_millis(F.col("ts"))).alias("ts"),
        F.coalesce(text("source"), F.lit("import")).alias("source"),
        text("meta").alias("meta"),
        text("idempotency_key").alias("idempotencyKey"),
        *(["seq"] if "seq" in columns else []),
    )


def _write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_events_csv(events: DataFrame, path: str) -> None:
    _write_csv(events_for_export(events).select(*EVENT_CSV), path)


def write_report_csv(reports: DataFrame, path: str) -> None:
    _write_csv(report_csv(reports), path)


def write_summary_csv(summary: DataFrame, path: str) -> None:
    """One small file: a row per metric, then TOTAL."""
    rows = summary_with_total(summary).repartition(1).sortWithinPartitions("row_order", "metric")
    _write_csv(rows.select(*SUMMARY_CSV), path)


def write_invoices(invoices: DataFrame, path: str) -> None:
    """Records results as JSON lines."""
    invoices.write.json(path)


def _path(spark: SparkSession, path: str):
    """A path and its file system, whichever the session knows."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    place, files = _path(spark, path)
    if not files.exists(place):
        return []
    names = [f.getPath().getName() for f in files.listStatus(place)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def read_periods(spark: SparkSession, path: str, schema) -> DataFrame:
    """A keyed table in folders per version and ``period_start``: of each period, its newest version."""
    columns = [f.name for f in schema.fields]
    if not _versions(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(StructType([*schema.fields, StructField("version", IntegerType())])).parquet(path)
    # folder values only: no column of the files is read for them
    newest = rows.groupBy("period_start").agg(F.max("version").alias("version"))
    return rows.join(newest, ["period_start", "version"]).select(*columns)


def upsert_periods(updates: DataFrame, path: str, keys: list[str], keep_greatest: tuple[str, ...] = ()) -> None:
    """Merges updates into a keyed table per ``period_start``; a table that is not there yet is made.

    The touched periods are written as a new version and appear at once, by the rename of their folder;
    other periods stay where they are, and a reader sees whole versions only.
    """
    spark = updates.sparkSession
    fresh = settle(updates, "upsert-in")
    base = read_periods(spark, path, StructType(list(fresh.schema.fields)))
    touched = base.join(fresh.select("period_start").distinct(), "period_start", "left_semi")
    merged = upsert(touched.select(*fresh.columns), fresh, keys, keep_greatest)
    version = max(_versions(spark, path), default=-1) + 1
    staged = f"{path}/_staged-{uuid.uuid4().hex}"
    merged.repartition("period_start").write.partitionBy("period_start").parquet(staged)
    place, files = _path(spark, staged)
    if not files.rename(place, _path(spark, f"{path}/version={version}")[0]):
        raise OSError(f"version {version} of {path} could not be put in place")
