"""Priced lines, invoices, projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.functions import money
from tallymill.operators.counters import measure
from tallymill.operators.intervals import overlaps
from tallymill.operators.joins import lookup
from tallymill.operators.prefix import prefix_totals
from tallymill.schemas import MONEY, PRICE_CONFIG, RATED_QTY, SUM

INVOICE = ["tenant_id", "customer_ref", "period_start"]


def priced(usage: DataFrame, prices: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Attaches ``price_config``; without one, the line is flat at unit price 0."""
    free = F.from_json(F.lit('{"model":"flat","currency":"USD","unit_price":0}'), PRICE_CONFIG)
    joined = lookup(usage, prices, on or ["metric"], "left")
    return joined.withColumn("price_config", F.coalesce("price_config", free))


def rate_lines(usage: DataFrame) -> DataFrame:
    """Adds ``subtotal`` and ``unit_price`` to rows with ``quantity`` and ``price_config``."""
    amounts = money.line_amounts(F.col("quantity"), F.col("price_config"))
    return usage.withColumn("_line", amounts).select(
        *usage.columns,
        F.col("_line.subtotal").cast(RATED_QTY).alias("subtotal"),
        F.col("_line.unit_price").cast(MONEY).alias("unit_price"),
    )


def tier_breakdown(usage: DataFrame) -> DataFrame:
    """One row per tier that got units: tier, units, unit price, rounded subtotal (flat fee for graduated prices)."""
    tiers = F.col("price_config.tiers")
    used = F.filter(money.tier_units(F.col("quantity"), tiers), lambda t: t["units"] > 0)
    fee = F.when(F.col("price_config.model") == "graduated", F.col("t.flat_price")).otherwise(F.lit(0))
    return (
        usage.filter(F.col("price_config.model").isin("tiered", "graduated") & tiers.isNotNull())
        .withColumn("t", F.explode_outer(used))
        .filter(F.col("t").isNotNull())
        .select(
            *[c for c in usage.columns if c not in ("quantity", "price_config")],
            F.col("t.tier").alias("tier"),
            F.col("t.units").alias("units"),
            F.col("t.unit_price").alias("unit_price"),
            fee.cast("decimal(13,6)").alias("flat_fee"),
            money.round_currency(F.col("t.units") * F.col("t.unit_price") + fee.cast("decimal(13,6)")).alias("subtotal"),
        )
    )


def active_commitments(commitments: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """Commitments that overlap a billing period: ``start <= period_end and end >= period_start``.

    Joined by equality on dyadic blocks of days; an open end (9999-12-31) gives at most 22 of them.
    ``periods`` has keys, period_start and period_end.
    """
    return overlaps(commitments, periods, keys, ("start_date", "end_date"), ("period_start", "period_end"))


def commitment_credit(subtotals: DataFrame, active: DataFrame, invoice: list[str]) -> DataFrame:
    """``commitment_credit`` per invoice: commitments used up in the order of ``position``.

    Each step takes min(what the commitment has left, what of the subtotal is left). Over all steps
    that is subtotal - max(subtotal, peak) + total of the running sums of what is left, so no loop is needed.
    """
    left = active.withColumn("_left", (F.col("amount") - F.col("applied")).cast("decimal(24,6)"))
    sums = prefix_totals(left, invoice, "position", "_left")
    taken = F.col("subtotal") - F.greatest(F.col("subtotal"), F.col("peak")) + F.col("total")
    return (
        subtotals.join(sums, invoice, "left")
        .withColumn("commitment_credit", F.coalesce(taken, F.lit(0)).cast(SUM))
        .drop("total", "peak")
    )


def valid_credits(credits: DataFrame, periods: DataFrame, keys: list[str]) -> DataFrame:
    """``credit_amount`` per period: credits without expiry, or expiring on or after the period end.

    Credits are summed per customer and expiry day first; days and period ends then stand in one order per
    customer, and a running sum from the latest day on gives what is still valid. A customer has as many rows there
    as calendar days, whatever the number of credits.
    """
    day = F.coalesce(F.col("expires_on"), F.lit("9999-12-31").cast("date"))
    by_day = credits.groupBy(*keys, day.alias("_day")).agg(F.sum("amount").cast(SUM).alias("_amount"))
    ends = periods.select(*keys, F.col("period_end").alias("_day"), "period_start", F.lit(None).cast(SUM).alias("_amount"))
    marked = by_day.withColumn("period_start", F.lit(None).cast("date")).unionByName(ends)
    # of equal days the credits come first: a credit is valid on the day it expires
    later = W.partitionBy(*keys).orderBy(F.desc("_day"), F.col("period_start").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    return (
        marked.withColumn("credit_amount", F.sum("_amount").over(later).cast(SUM))
        .filter(F.col("period_start").isNotNull() & F.col("credit_amount").isNotNull())
        .select(*keys, "period_start", "credit_amount")
    )


def invoice_heads(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Per invoice the sum of its lines, their number and the currency of the line with the least ``position``.

    Lines are summed per currency first, where ``position`` is the only ordered state: with a whole number that is a
    hash aggregate, whatever the currency's length. The second aggregate picks among an invoice's few currencies.
    """
    by_currency = lines.groupBy(*keys, F.col("price_config.currency").alias("currency")).agg(
        F.sum("subtotal").cast(SUM).alias("_sum"), F.count("*").alias("_n"), F.min("position").alias("_first")
    )
    first = F.min(F.struct("_first", "currency"))["currency"]
    return by_currency.groupBy(*keys).agg(
        F.sum("_sum").cast(SUM).alias("subtotal"), first.alias("currency"), F.sum("_n").alias("n_lines")
    )


def invoice_totals(headers: DataFrame) -> DataFrame:
    """Rounded amounts from subtotal, commitment_credit, credit_amount and tax_rate.

    Credits are not capped at the subtotal; only the taxable amount stops at 0.
    """
    taxable = F.greatest(
        F.lit(0).cast("decimal(28,6)"),
        (F.col("subtotal") - F.col("commitment_credit") - F.col("credit_amount")).cast("decimal(28,6)"),
    )
    tax = (taxable * F.coalesce(F.col("tax_rate"), F.lit(0)).cast("decimal(7,4)") * F.lit("0.01").cast("decimal(2,2)"))
    return headers.select(
        *[c for c in headers.columns if c not in ("subtotal", "commitment_credit", "credit_amount", "tax_rate")],
        money.round_currency(F.col("subtotal")).alias("subtotal"),
        money.round_currency(F.col("credit_amount") + F.col("commitment_credit")).alias("credits"),
        F.lit(0).cast(MONEY).alias("adjustments"),
        money.round_currency(tax).alias("tax"),
        money.round_currency(taxable + tax).alias("total"),
    )


def invoices(
    lines: DataFrame,
    commitments: DataFrame | None = None,
    credits: DataFrame | None = None,
    tax_rate: Column | float = 0,
    invoice: list[str] | None = None,
) -> DataFrame:
    """One invoice per group of rated lines (``period_end`` and ``position``, of any ordered type, included).

    Commitments and credits belong to the customer columns of the invoice keys. All uses of the sums per invoice
    share one shuffle of the lines' partial sums.
    """
    invoice = invoice or INVOICE
    customer = [c for c in invoice if c != "period_start"]
    heads = invoice_heads(lines, [*invoice, "period_end"])
    periods = heads.select(*invoice, "period_end")
    if commitments is None:
        heads = heads.withColumn("commitment_credit", F.lit(0).cast(SUM))
    else:
        heads = commitment_credit(heads, active_commitments(commitments, periods, customer), invoice)
    if credits is None:
        heads = heads.withColumn("credit_amount", F.lit(0).cast(SUM))
    else:
        heads = heads.join(valid_credits(credits, periods, customer), invoice, "left").withColumn(
            "credit_amount", F.coalesce("credit_amount", F.lit(0)).cast(SUM)
        )
    rate = tax_rate if isinstance(tax_rate, Column) else F.lit(tax_rate)
    return invoice_totals(
        heads.withColumn("currency", F.coalesce("currency", F.lit("USD"))).withColumn("tax_rate", rate)
    )


def billable_usage(counters: DataFrame, mappings: DataFrame) -> DataFrame:
    """Counters with the quantity their mapping bills; counters without an active mapping drop out."""
    words = mappings.filter("active").select("tenant_id", "metric", "aggregation", "subscription_item_id")
    return lookup(counters, words, ["tenant_id", "metric"]).withColumn("quantity", measure(F.col("aggregation")))


def projection(counters: DataFrame, mappings: DataFrame, prices: DataFrame) -> DataFrame:
    """Priced lines per customer and period of the current counters."""
    usage = billable_usage(counters, mappings).select(*INVOICE, "period_end", "metric", "quantity")
    return rate_lines(priced(usage, prices))
