"""Push plan, reconciliation, suggestions, drift summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import compare, identity
from tallymill.operators.counters import upsert
from tallymill.operators.joins import lookup, spread
from tallymill.operators.rating import billable_usage
from tallymill.schemas import RECON_EPSILON, SUM

ITEM = ["tenant_id", "subscription_item_id", "period_start"]

# Message and columns of the reports.
LOCAL_EXCEEDS = "Local usage exceeds Stripe reported usage. Manual review required."
REPORT_CSV = ["subscription_item_id", "period", "local", "stripe", "drift_abs", "drift_pct", "status"]
SUMMARY_CSV = ["metric", "local", "stripe", "drift_abs", "drift_pct", "items"]


def _zero() -> Column:
    return F.lit(0).cast(SUM)


def item_mappings(mappings: DataFrame) -> DataFrame:
    return mappings.filter(F.col("active") & F.col("subscription_item_id").isNotNull())


def customer_totals(counters: DataFrame, mappings: DataFrame) -> DataFrame:
    """Billable quantity per item, period and customer."""
    return billable_usage(counters, item_mappings(mappings)).select(
        *ITEM, "metric", "customer_ref", F.col("quantity").cast(SUM).alias("quantity")
    )


def local_totals(counters: DataFrame, mappings: DataFrame) -> DataFrame:
    """Sum over customers per item and period."""
    return (
        customer_totals(counters, mappings)
        .groupBy(*ITEM, "metric")
        .agg(F.sum("quantity").cast(SUM).alias("local_total"), F.count("*").alias("n_customers"))
    )


def billed_totals(summaries: DataFrame) -> DataFrame:
    """Sum of the external summaries per item and period; a missing total counts as 0."""
    return summaries.groupBy(*ITEM).agg(F.sum(F.coalesce("total_usage", _zero())).cast(SUM).alias("stripe_total"))


def push_plan(counters: DataFrame, mappings: DataFrame, write_log: DataFrame, test_configured: bool) -> DataFrame:
    """What still has to be reported, one row per item and period with a positive delta.

    Shadow mappings go to their shadow target (live ids where it has none) when a test target is
    configured, and are marked ``skipped_shadow`` otherwise.
    """
    targets = item_mappings(mappings).select(
        "tenant_id", "subscription_item_id", "metric", "stripe_account", "shadow",
        "shadow_stripe_account", "shadow_subscription_item_id",
    )
    totals = lookup(local_totals(counters, mappings), targets, ["tenant_id", "subscription_item_id", "metric"])
    log = write_log.select("tenant_id", "stripe_account", "subscription_item_id", "period_start", "pushed_total")
    shadow = F.coalesce("shadow", F.lit(False))
    to_test = shadow & F.lit(test_configured)
    planned = (
        totals.join(log, ["tenant_id", "stripe_account", "subscription_item_id", "period_start"], "left")
        .withColumn("pushed_total", F.coalesce("pushed_total", _zero()).cast(SUM))
        .withColumn("delta", (F.col("local_total") - F.col("pushed_total")).cast(SUM))
        .filter(F.col("delta") > 0)
    )
    account = F.when(to_test, F.coalesce("shadow_stripe_account", "stripe_account")).otherwise(F.col("stripe_account"))
    item = F.when(to_test, F.coalesce("shadow_subscription_item_id", "subscription_item_id")).otherwise(
        F.col("subscription_item_id")
    )
    return planned.select(
        "tenant_id",
        "metric",
        F.col("stripe_account").alias("live_account"),
        F.col("subscription_item_id").alias("live_item"),
        account.alias("target_account"),
        item.alias("target_item"),
        "period_start",
        "local_total",
        "pushed_total",
        "delta",
        F.when(to_test, "shadow").when(shadow, "skipped_shadow").otherwise("live").alias("mode"),
        identity.push_key(F.col("tenant_id"), item, F.col("period_start"), F.col("local_total"), to_test).alias("push_key"),
        F.floor(F.col("local_total") + F.lit("0.5").cast("decimal(2,1)")).cast("bigint").alias("reported_quantity"),
        F.unix_timestamp(F.col("period_start").cast("timestamp")).alias("reported_at"),
    )


def advance_write_log(write_log: DataFrame, pushed: DataFrame, now: Column) -> DataFrame:
    """New write log after the live rows of a plan went out."""
    updates = pushed.filter(F.col("mode") == "live").select(
        "tenant_id",
        F.col("live_account").alias("stripe_account"),
        F.col("live_item").alias("subscription_item_id"),
        "period_start",
        F.col("local_total").alias("pushed_total"),
        F.col("push_key").alias("last_request_id"),
        now.alias("updated_at"),
    )
    return upsert(write_log, updates, ["tenant_id", "stripe_account", "subscription_item_id", "period_start"])


def reports(local: DataFrame, billed: DataFrame, mappings: DataFrame, epsilon: float = RECON_EPSILON) -> DataFrame:
    """Local against billed per mapped item and period; a missing side counts as 0."""
    items = item_mappings(mappings).select("tenant_id", "subscription_item_id", "metric")
    known = lookup(billed, items, ["tenant_id", "subscription_item_id"])
    both = local.select(*ITEM, "metric", "local_total").join(known, ITEM + ["metric"], "full_outer")
    totals = both.select(
        *ITEM,
        "metric",
        F.coalesce("local_total", _zero()).cast(SUM).alias("local_total"),
        F.coalesce("stripe_total", _zero()).cast(SUM).alias("stripe_total"),
    )
    pct = compare.drift_pct(F.col("local_total"), F.col("stripe_total"))
    return totals.select(
        "*",
        compare.drift_abs(F.col("local_total"), F.col("stripe_total")).cast(SUM).alias("diff"),
        pct.alias("drift_pct"),
        compare.recon_status(pct, epsilon).alias("status"),
    )


_WHOLE = "decimal(38,0)"
_DIGITS = 10**6


def _micros(c: Column) -> Column:
    return (c * 1000000).cast(_WHOLE)


def _quotient(a: Column, b: Column) -> Column:
    """Whole part of a quotient of whole numbers; the engine's division rounds its last digit."""
    near = F.floor(a / b).cast(_WHOLE)
    return F.when((near * b).cast(_WHOLE) > a, near - 1).otherwise(near).cast(_WHOLE)


def share_of(gap: Column, part: Column, total: Column) -> Column:
    """``gap * part / total`` to millionths, half up, without a product of more than 38 digits.

    ``part`` is taken in digits of six places, as in long division, so totals may have 25 digits before the point.
    """
    places = [F.lit(str(10 ** (6 * k))).cast(_WHOLE) for k in range(5, -1, -1)]
    wanted, each, whole = _micros(gap), _micros(part), _micros(total)
    turns = _quotient(wanted, whole)
    rest = (wanted - turns * whole).cast(_WHOLE)
    digits = F.array(*[(_quotient(each, p) % F.lit(_DIGITS).cast(_WHOLE)).cast(_WHOLE) for p in places])
    begin = F.struct(F.lit(0).cast(_WHOLE).alias("done"), F.lit(0).cast(_WHOLE).alias("left"))

    def step(state, digit):
        shifted = (state["left"] * F.lit(_DIGITS).cast("decimal(7,0)") + rest * digit).cast(_WHOLE)
        got = _quotient(shifted, whole)
        done = (state["done"] * F.lit(_DIGITS).cast("decimal(7,0)") + got).cast(_WHOLE)
        return F.struct(done.alias("done"), (shifted - got * whole).cast(_WHOLE).alias("left"))

    def finish(state):
        up = F.when((state["left"] * 2).cast(_WHOLE) >= whole, 1).otherwise(0)
        return (state["done"] + turns * each + up).cast(_WHOLE)

    return (F.aggregate(digits, begin, step, finish) * F.lit("0.000001").cast("decimal(6,6)")).cast(SUM)


def suggestions(found: DataFrame, customers: DataFrame) -> DataFrame:
    """Pending corrections where more was billed than used, split over customers by their share.

    ``customers`` are the rows of ``customer_totals``. Without local usage every customer gets the same part.
    """
    keys = ITEM + ["metric"]
    missing = found.filter((F.col("status") == "investigate") & (F.col("stripe_total") > F.col("local_total")))
    counts = customers.groupBy(*keys).agg(F.count("*").alias("_customers"))
    per_item = missing.select(*keys, "local_total", (F.col("stripe_total") - F.col("local_total")).cast(SUM).alias("_gap"))
    per_item = per_item.join(counts, keys)
    shared = spread(customers, per_item, keys, counts, "_customers", ["customer_ref"])
    one = F.lit(1).cast(SUM)
    delta = F.when(
        F.col("local_total") > 0, share_of(F.col("_gap"), F.col("quantity"), F.col("local_total"))
    ).otherwise(share_of(F.col("_gap"), one, F.col("_customers").cast(SUM)))
    return (
        shared.withColumn("delta", delta)
        .filter(F.col("delta") > F.lit("0.01").cast("decimal(4,2)"))
        .select(
            "tenant_id", "metric", "customer_ref", "period_start", "subscription_item_id", "delta",
            F.lit("correction").alias("reason"),
            F.lit("system:reconciliation").alias("actor"),
            F.lit("pending").alias("status"),
        )
    )


def small_alignments(found: DataFrame) -> DataFrame:
    """One pending adjustment per item whose drift is within tolerance but not zero."""
    return found.filter((F.col("status") == "ok") & (F.col("diff") != 0)).select(
        *ITEM,
        "metric",
        (F.col("stripe_total") - F.col("local_total")).cast(SUM).alias("delta"),
        F.lit("correction").alias("reason"),
        F.lit("system:reconciliation").alias("actor"),
        F.lit("pending").alias("status"),
    )


def local_exceeds(found: DataFrame) -> DataFrame:
    """Review rows where more was used than billed."""
    return found.filter((F.col("status") == "investigate") & (F.col("local_total") > F.col("stripe_total"))).select(
        F.lit("local_exceeds_stripe").alias("type"),
        *ITEM,
        "metric",
        "local_total",
        "stripe_total",
        "diff",
        F.lit(LOCAL_EXCEEDS).alias("message"),
    )


def run_metrics(found: DataFrame, started: Column, ended: Column) -> DataFrame:
    """Numbers of a run and its duration in seconds."""
    return found.agg(
        F.count("*").alias("reports"),
        F.count_if(F.col("status") == "investigate").alias("investigating"),
        F.max(F.unix_timestamp(ended) - F.unix_timestamp(started)).alias("duration_seconds"),
    )


def period_summary(found: DataFrame) -> DataFrame:
    """Per tenant and period: number of reports by status and the largest difference."""
    return found.groupBy("tenant_id", "period_start").agg(
        F.count("*").alias("total"),
        *[
            F.count_if(F.col("status") == word).alias(name)
            for word, name in (("ok", "ok"), ("investigate", "investigating"), ("resolved", "resolved"))
        ],
        F.max("diff").cast(SUM).alias("max_diff"),
    )


def _with_drift(rows: DataFrame) -> DataFrame:
    return rows.withColumn("drift_abs", compare.drift_abs(F.col("local"), F.col("stripe")).cast(SUM)).withColumn(
        "drift_pct", compare.drift_pct(F.col("local"), F.col("stripe"))
    )


def drift_summary(found: DataFrame, mappings: DataFrame, tenant: str, first: str, last: str) -> DataFrame:
    """Drift per metric over a range of months ``YYYY-MM``; active mappings give the metric."""
    if last < first:
        raise ValueError("the last month is before the first")
    active = mappings.filter("active").select("tenant_id", "subscription_item_id", F.col("metric").alias("_metric"))
    month = lambda text: F.lit(f"{text}-01").cast("date")
    kept = found.filter(
        (F.col("tenant_id") == tenant) & (F.col("period_start") >= month(first)) & (F.col("period_start") <= month(last))
    )
    joined = lookup(kept, active, ["tenant_id", "subscription_item_id"])
    grouped = joined.groupBy(F.col("_metric").alias("metric")).agg(
        F.sum("local_total").cast(SUM).alias("local"),
        F.sum("stripe_total").cast(SUM).alias("stripe"),
        F.count_distinct("subscription_item_id").alias("items"),
    )
    return _with_drift(grouped).select("metric", "local", "stripe", "drift_abs", "drift_pct", "items")


def drift_total(summary: DataFrame) -> DataFrame:
    """Overall drift of a summary: items add up over metrics, even when metrics share an item."""
    total = summary.agg(
        F.coalesce(F.sum("local"), _zero()).cast(SUM).alias("local"),
        F.coalesce(F.sum("stripe"), _zero()).cast(SUM).alias("stripe"),
        F.count("*").alias("metrics"),
        F.coalesce(F.sum("items"), F.lit(0)).cast("bigint").alias("items"),
        F.count_if(F.col("drift_abs") > 0).alias("metrics_with_drift"),
    )
    return _with_drift(total).select(
        "local", "stripe", "drift_abs", "drift_pct", "metrics", "items", "metrics_with_drift"
    )


def summary_with_total(summary: DataFrame) -> DataFrame:
    """Metric rows and a ``TOTAL`` row, with ``row_order`` for the export."""
    total = drift_total(summary).withColumn("metric", F.lit("TOTAL")).drop("metrics", "metrics_with_drift")
    return summary.withColumn("row_order", F.lit(0)).unionByName(total.withColumn("row_order", F.lit(1)))


def matched_share(summary: DataFrame) -> DataFrame:
    """Matched percentage overall and the number of metrics with drift."""
    return drift_total(summary).select(
        ((F.lit(1.0) - F.col("drift_pct")) * 100).alias("matched_pct"), "metrics_with_drift", "metrics"
    )


def parity_gate(total: DataFrame, epsilon: float = RECON_EPSILON) -> DataFrame:
    return total.select(
        "drift_abs",
        "drift_pct",
        ((F.col("drift_abs") == 0) | (F.col("drift_pct") <= epsilon)).alias("passed"),
        compare.parity_label(F.col("drift_pct")).alias("label"),
    )


def report_csv(found: DataFrame) -> DataFrame:
    """The report in the column order of its export."""
    return found.select(
        "subscription_item_id",
        F.date_format("period_start", "yyyy-MM").alias("period"),
        F.col("local_total").alias("local"),
        F.col("stripe_total").alias("stripe"),
        F.col("diff").alias("drift_abs"),
        "drift_pct",
        "status",
    ).select(*REPORT_CSV)


def replay_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counter totals before and after a replay, per tenant and metric overall and per customer (customer null = all)."""
    sides = before.select("tenant_id", "metric", "customer_ref", F.col("agg_sum").alias("before"), _zero().alias("after")).unionByName(
        after.select("tenant_id", "metric", "customer_ref", _zero().alias("before"), F.col("agg_sum").alias("after"))
    )
    return (
        sides.rollup("tenant_id", "metric", "customer_ref")
        .agg(
            F.sum("before").cast(SUM).alias("before_total"),
            F.sum("after").cast(SUM).alias("after_total"),
            F.grouping("metric").alias("_no_metric"),
        )
        .filter("_no_metric = 0")
        .drop("_no_metric")
        .withColumn("change", (F.col("after_total") - F.col("before_total")).cast(SUM))
    )
