"""Append-only corrections: creation, approval, reversal, listing, late policy.

Every step reads the latest rows and returns new row versions, the refused requests and
the audit rows; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.operators.joins import lookup
from tallymill.operators.pick import first_per_key
from tallymill.operators.validate import validate_adjustments
from tallymill.schemas import ADJUSTMENTS, QTY

_ROW = [c.strip().split(" ")[0] for c in ADJUSTMENTS.replace("decimal(20,6)", "decimal").split(",")]


def latest_version(rows: DataFrame, key: str, updated: str) -> DataFrame:
    """Newest version per id."""
    return first_per_key(rows, [key], [F.desc(updated)])


def audit(rows: DataFrame, action: str, actor: Column, at: Column, resource: str = "adjustment") -> DataFrame:
    return rows.select(
        "tenant_id",
        F.lit("api_key").alias("actor_type"),
        actor.alias("actor_id"),
        F.lit(f"{resource}.{action}").alias("action"),
        F.lit(resource).alias("resource_type"),
        F.col("id").alias("resource_id"),
        at.alias("created_at"),
    )


def create(requests: DataFrame, actor: str, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pending rows for the valid requests; also the refused requests with ``errors``, and audit rows."""
    checked = validate_adjustments(requests)
    good = checked.filter(F.size("errors") == 0)
    empty = lambda kind: F.lit(None).cast(kind)
    rows = good.select(
        "id", "tenant_id", "metric", "customer_ref",
        F.try_to_date("period_start").alias("period_start"),
        F.col("delta").cast(QTY).alias("delta"),
        "reason",
        F.lit(f"api:{actor}").alias("actor"),
        F.lit("pending").alias("status"),
        empty("string").alias("approved_by"),
        empty("string").alias("reverted_by"),
        empty("string").alias("parent_adjustment_id"),
        F.col("request_id") if "request_id" in requests.columns else empty("string").alias("request_id"),
        F.col("note") if "note" in requests.columns else empty("string").alias("note"),
        empty("timestamp").alias("approved_at"),
        empty("timestamp").alias("reverted_at"),
        now.alias("created_at"),
    ).select(*_ROW)
    return rows, checked.filter(F.size("errors") > 0), audit(rows, "create", F.col("actor"), now)


def _matched(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Requests (id, tenant_id, requested_by) with the row that they name; one request per id counts."""
    asked = requests.groupBy("id", "tenant_id").agg(F.min("requested_by").alias("requested_by"))
    return asked.join(rows, ["id", "tenant_id"], "left")


def _outcome(matched: DataFrame, outcome: Column) -> DataFrame:
    return matched.select("id", "tenant_id", outcome.alias("outcome"))


def approve(requests: DataFrame, rows: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pending rows become approved; returns (new versions, outcome per request, audit rows)."""
    found = _matched(requests, rows)
    outcome = (
        F.when(F.col("status").isNull(), "Not found")
        .when(F.col("status") == "approved", "already")
        .when(F.col("status") == "reverted", "Already reverted")
        .otherwise("approved")
    )
    changed = found.filter(F.col("status") == "pending")
    updated = (
        changed.withColumn("status", F.lit("approved"))
        .withColumn("approved_by", F.concat(F.lit("api:"), F.col("requested_by")))
        .withColumn("approved_at", now)
    )
    return (
        updated.select(*_ROW),
        _outcome(found, outcome),
        audit(changed, "approve", F.concat(F.lit("api:"), F.col("requested_by")), now),
    )


def revert(requests: DataFrame, rows: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Approved rows become reverted and get an approved counter row.

    Returns (new versions, reversal rows, outcome per request, audit rows).
    """
    found = _matched(requests, rows)
    outcome = (
        F.when(F.col("status").isNull(), "Not found")
        .when(F.col("status") != "approved", "Only approved adjustments can be reverted")
        .otherwise("reverted")
    )
    by = F.concat(F.lit("api:"), F.col("requested_by"))
    changed = found.filter(F.col("status") == "approved")
    updated = (
        changed.withColumn("status", F.lit("reverted")).withColumn("reverted_by", by).withColumn("reverted_at", now)
    )
    empty = lambda kind: F.lit(None).cast(kind)
    reversal = (
        changed.withColumn("parent_adjustment_id", F.col("id"))
        .withColumn("id", F.concat(F.lit("rev:"), F.col("id")))
        .withColumn("delta", (-F.col("delta")).cast(QTY))
        .withColumn("reason", F.lit("correction"))
        .withColumn("actor", by)
        .withColumn("status", F.lit("approved"))
        .withColumn("approved_by", empty("string"))
        .withColumn("approved_at", empty("timestamp"))
        .withColumn("request_id", empty("string"))
        .withColumn("created_at", now)
    )
    return updated.select(*_ROW), reversal.select(*_ROW), _outcome(found, outcome), audit(changed, "revert", by, now)


def bulk_approve(requests: DataFrame, rows: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Approves a list of suggestions (id, tenant_id, requested_by): new versions, outcome per request, audit rows.

    A request is ``applied`` if its tenant has a pending row of that id, and ``failed`` otherwise.
    """
    updated, outcomes, audited = approve(requests, rows, now)
    applied = F.when(F.col("outcome") == "approved", "applied").otherwise("failed")
    return updated, outcomes.withColumn("outcome", applied), audited


def list_adjustments(
    rows: DataFrame,
    tenant: str,
    metric: str | None = None,
    customer: str | None = None,
    status: str | None = None,
    first_period: str | None = None,
    last_period: str | None = None,
) -> DataFrame:
    kept = rows.filter(F.col("tenant_id") == tenant)
    for column, wanted in (("metric", metric), ("customer_ref", customer), ("status", status)):
        if wanted is not None:
            kept = kept.filter(F.col(column) == wanted)
    if first_period is not None:
        kept = kept.filter(F.col("period_start") >= F.lit(first_period).cast("date"))
    if last_period is not None:
        kept = kept.filter(F.col("period_start") <= F.lit(last_period).cast("date"))
    return kept


def settle_late(rows: DataFrame, policies: DataFrame, closed_before: Column) -> tuple[DataFrame, DataFrame]:
    """Adjustments of closed periods: tenant policy ``roll`` moves them to the next period,
    any other word (``credit_note``) takes them out as credit notes. Open periods stay.

    Returns (adjustments, credit notes).
    """
    known = lookup(rows, policies, ["tenant_id"], "left").withColumn("policy", F.coalesce("policy", F.lit("roll")))
    closed = F.col("period_start") < closed_before
    kept = known.filter(~closed | (F.col("policy") == "roll")).withColumn(
        "period_start", F.when(closed, F.add_months("period_start", 1)).otherwise(F.col("period_start"))
    )
    notes = known.filter(closed & (F.col("policy") != "roll")).select(
        "id", "tenant_id", "metric", "customer_ref", "period_start",
        F.when(F.col("delta") < 0, "credit").otherwise("debit").alias("kind"),
        F.abs("delta").cast(QTY).alias("amount"),
    )
    return kept.drop("policy"), notes


def map_customers(rows: DataFrame, customer_map: DataFrame) -> DataFrame:
    """Replaces internal customer ids by billing ids where the map has one."""
    named = customer_map.select("tenant_id", F.col("internal_id").alias("customer_ref"), "billing_customer")
    return (
        lookup(rows, named, ["tenant_id", "customer_ref"], "left")
        .withColumn("customer_ref", F.coalesce("billing_customer", "customer_ref"))
        .drop("billing_customer")
    )
