"""The shapes of the plans that the design relies on."""

from datetime import date, datetime

from pyspark.sql import functions as F

from tallymill import schemas
from tallymill.operators import counters as C
from tallymill.operators import dedup, listing
from tallymill.plans.tables import frame
from tallymill.sources import files, sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ledger_rows(spark):
    rows = [
        ("t", "m", "c", None, "1", datetime(2024, m, d), None, f"k{m}-{d}", "http", datetime(2024, m, d), date(2024, m, 1))
        for m in (1, 2, 3) for d in (1, 9)
    ]
    return frame(spark, rows, schemas.LEDGER)


def test_counters_are_a_hash_aggregate_without_the_key(spark, tmp_path):
    sinks.append_ledger(ledger_rows(spark), str(tmp_path / "ledger"))
    text = plan(C.build_counters(files.read_ledger(spark, str(tmp_path / "ledger"))))
    assert "HashAggregate" in text and "SortAggregate" not in text and "idempotency_key" not in text
    assert text.count("Exchange hashpartitioning") == 1


def test_first_copies_are_limited_before_the_shuffle(spark):
    text = plan(dedup.first_copies(ledger_rows(spark), ["inserted_at"]))
    assert text.count("WindowGroupLimit") == 2 and text.index("WindowGroupLimit") < text.index("Exchange")
    assert text.rindex("Partial") > text.index("Exchange")


def test_a_time_range_prunes_month_folders(spark, tmp_path):
    sinks.append_ledger(ledger_rows(spark), str(tmp_path / "ledger"))
    ledger = files.read_ledger(spark, str(tmp_path / "ledger"))
    found = listing.scan_ledger(ledger, "t", "2024-02-05 00:00:00", "2024-02-20 00:00:00")
    assert found.count() == 1 and len(found.inputFiles()) >= 1
    text = plan(found)
    assert "PartitionFilters: [isnotnull(period_start" in text and "PushedFilters: [IsNotNull(tenant_id)" in text
    assert "2024-02-01" in text


def test_a_page_is_a_top_k(spark):
    rows = spark.range(1000).select("id", F.col("id").alias("ts"))
    assert "TakeOrderedAndProject(limit=75" in plan(listing.page(rows, "ts", "desc", "id", 25, 50))


def test_adjustments_without_parent_are_spread_by_their_id(spark):
    rows = spark.createDataFrame(
        [(f"a{i}", "t", "m", "c", date(2024, 1, 1), 1, "approved", "a0" if i == 5 else None) for i in range(50)],
        "id string, tenant_id string, metric string, customer_ref string, period_start date, delta int, status string, "
        "parent_adjustment_id string",
    )
    folded = C.fold_adjustments(rows)
    # a0 is not reverted, so its child counts too
    assert folded.first().adjusted == 50 and "coalesce(parent_adjustment_id" in plan(folded)
    reverted = rows.withColumn("status", F.when(F.col("id") == "a0", "reverted").otherwise("approved"))
    assert C.fold_adjustments(reverted).first().adjusted == 48
