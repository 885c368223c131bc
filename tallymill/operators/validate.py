"""Row checks of events, adjustments, mappings, alert rules and scenarios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import identity
from tallymill.functions.period import hours
from tallymill.schemas import (
    ADJUSTMENT_REASONS,
    AGGREGATIONS,
    ALERT_ACTIONS,
    ALERT_TYPES,
    PRICE_MODELS,
    SOURCES,
)

# Messages of the ingest checks.
FUTURE_MESSAGE = "Event timestamp too far in the future"
META_MESSAGE = "Meta too large"
BAD_TIME_MESSAGE = "Invalid ISO 8601 date-time format"
DELTA_MESSAGE = "Adjustment delta out of bounds"


def _text(name: str, low: int, high: int) -> Column:
    size = F.coalesce(F.length(F.col(name)), F.lit(0))
    return F.when((size < low) | (size > high), F.lit(f"{name}: length must be {low} to {high}"))


def _member(name: str, allowed: list[str]) -> Column:
    return F.when(~F.coalesce(F.col(name).isin(allowed), F.lit(False)), F.lit(f"{name}: unknown value"))


def _optional(name: str, check: Column) -> Column:
    return F.when(F.col(name).isNotNull(), check)


def with_errors(df: DataFrame, checks: list[Column]) -> DataFrame:
    """Adds ``errors``, the messages of the failed checks."""
    return df.withColumn("errors", F.array_compact(F.array(*checks)))


def event_checks() -> list[Column]:
    return [
        F.when(F.coalesce(F.length("tenant_id"), F.lit(0)) < 1, F.lit("tenant_id: must not be empty")),
        _text("metric", 1, 100),
        _text("customer_ref", 1, 255),
        _optional("resource_id", _text("resource_id", 0, 255)),
        F.when(~F.coalesce(F.col("quantity") > 0, F.lit(False)), F.lit("quantity: must be positive")),
        F.when(F.col("ts").isNull(), F.lit(BAD_TIME_MESSAGE)),
        _optional("idempotency_key", _text("idempotency_key", 0, 255)),
        _optional("source", _member("source", SOURCES)),
    ]


def validate_events(df: DataFrame) -> DataFrame:
    return with_errors(df, event_checks())


def is_future(ts: Column, now: Column, ahead_hours: int = 1) -> Column:
    return F.coalesce(ts > now + hours(ahead_hours), F.lit(False))


def meta_bytes(meta: Column) -> Column:
    return F.octet_length(meta)


def is_large_meta(meta: Column, max_bytes: int = 4096) -> Column:
    return F.coalesce(meta_bytes(meta) > max_bytes, F.lit(False))


def reject_future(df: DataFrame, now: Column, ahead_hours: int = 1) -> DataFrame:
    return df.filter(~is_future(F.col("ts"), now, ahead_hours))


def reject_large_meta(df: DataFrame, max_bytes: int = 4096) -> DataFrame:
    return df.filter(~is_large_meta(F.col("meta"), max_bytes))


def default_source(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("source", F.coalesce(identity.blank_to_null(F.col("source")), F.lit(source)))


def check_ingest(df: DataFrame, now: Column, max_meta: int = 4096) -> DataFrame:
    """Adds ``error``: the first failed schema check, else future time, else large meta; null when accepted."""
    checked = validate_events(df)
    return checked.withColumn(
        "error",
        F.coalesce(
            F.get("errors", F.lit(0)),
            F.when(is_future(F.col("ts"), now), F.lit(FUTURE_MESSAGE)),
            F.when(is_large_meta(F.col("meta"), max_meta), F.lit(META_MESSAGE)),
        ),
    ).drop("errors")


def tenant_guard(df: DataFrame, tenant: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the tenant, and the rows of others."""
    own = F.coalesce(F.col("tenant_id") == tenant, F.lit(False))
    return df.filter(own), df.filter(~own)


def validate_adjustments(df: DataFrame, max_delta: float = 1_000_000) -> DataFrame:
    """``period_start`` arrives as text here."""
    return with_errors(
        df,
        [
            F.when(F.coalesce(F.length("tenant_id"), F.lit(0)) < 1, F.lit("tenant_id: must not be empty")),
            _text("metric", 1, 100),
            _text("customer_ref", 1, 255),
            F.when(
                ~F.coalesce(F.col("period_start").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False))
                | F.try_to_date("period_start").isNull(),
                F.lit("period_start: must be YYYY-MM-DD"),
            ),
            F.when(~F.coalesce(F.abs("delta") <= max_delta, F.lit(False)), F.lit(DELTA_MESSAGE)),
            _member("reason", ADJUSTMENT_REASONS),
        ],
    )


def _prefixed(name: str, prefix: str) -> Column:
    return F.when(~F.coalesce(F.col(name).startswith(prefix), F.lit(False)), F.lit(f"{name}: must start with {prefix}"))


def validate_mappings(df: DataFrame) -> DataFrame:
    return with_errors(
        df,
        [
            F.when(F.coalesce(F.length("tenant_id"), F.lit(0)) < 1, F.lit("tenant_id: must not be empty")),
            _text("metric", 1, 100),
            _member("aggregation", AGGREGATIONS),
            _prefixed("stripe_account", "acct_"),
            _prefixed("price_id", "price_"),
            _optional("subscription_item_id", _prefixed("subscription_item_id", "si_")),
            _optional("currency", F.when(F.length("currency") != 3, F.lit("currency: must have 3 letters"))),
            _optional("shadow_stripe_account", _prefixed("shadow_stripe_account", "acct_")),
            _optional("shadow_price_id", _prefixed("shadow_price_id", "price_")),
            _optional("shadow_subscription_item_id", _prefixed("shadow_subscription_item_id", "si_")),
        ],
    )


def duplicate_mappings(mappings: DataFrame) -> DataFrame:
    """(tenant, metric, active) combinations that occur more than once."""
    return mappings.groupBy("tenant_id", "metric", "active").agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def validate_alert_configs(df: DataFrame) -> DataFrame:
    return with_errors(
        df,
        [
            F.when(F.coalesce(F.length("tenant_id"), F.lit(0)) < 1, F.lit("tenant_id: must not be empty")),
            _optional("customer_ref", _text("customer_ref", 1, 255)),
            _optional("metric", _text("metric", 1, 100)),
            _member("type", ALERT_TYPES),
            F.when(~F.coalesce(F.col("threshold") > 0, F.lit(False)), F.lit("threshold: must be positive")),
            _member("action", ALERT_ACTIONS),
        ],
    )


def _violation(path: str, message: str, broken: Column) -> Column:
    return F.when(
        F.coalesce(broken, F.lit(False)), F.array(F.struct(F.lit(path).alias("path"), F.lit(message).alias("message")))
    ).otherwise(F.array().cast("array<struct<path:string,message:string>>"))


def _per_item(items: Column, path: str, message: str, broken) -> Column:
    """One violation per broken element of an array, with its index in the path."""
    marked = F.transform(
        items,
        lambda x, i: F.when(
            F.coalesce(broken(x), F.lit(False)),
            F.struct(
                F.concat(F.lit(path + "."), i.cast("string")).alias("path"), F.lit(message).alias("message")
            ),
        ),
    )
    return F.coalesce(F.array_compact(marked), F.array().cast("array<struct<path:string,message:string>>"))


def _unsorted_tiers(price: Column) -> Column:
    bounds = F.transform(price["tiers"], lambda t: F.when(t["up_to"] != 0, t["up_to"]))
    return F.exists(
        F.transform(bounds, lambda b, i: (i > 0) & (F.get(bounds, i - 1).isNull() | (F.get(bounds, i - 1) >= b))),
        lambda bad: F.coalesce(bad, F.lit(False)),
    )


def scenario_violations(scenarios: DataFrame) -> DataFrame:
    """One row (scenario, path, message) per broken rule of a scenario row."""
    usage = F.col("usage_items")
    found = [
        _violation("name", "required", F.coalesce(F.length("name"), F.lit(0)) == 0),
        _violation("inputs.customerId", "required", F.coalesce(F.length("customer_id"), F.lit(0)) == 0),
        _violation("inputs.periodStart", "required", F.col("period_start").isNull()),
        _violation("inputs.periodEnd", "required", F.col("period_end").isNull()),
        _violation("inputs.usageItems", "required", usage.isNull()),
        _violation("inputs.taxRate", "must be 0 or more", F.col("tax_rate") < 0),
        _violation(
            "tolerances.relative", "must be 0 to 1", (F.col("tol_relative") < 0) | (F.col("tol_relative") > 1)
        ),
        _violation("tolerances.absolute", "must be 0 or more", F.col("tol_absolute") < 0),
        _per_item(usage, "inputs.usageItems", "metric required", lambda u: F.coalesce(F.length(u["metric"]), F.lit(0)) == 0),
        _per_item(usage, "inputs.usageItems", "quantity must be 0 or more", lambda u: u["quantity"].isNull() | (u["quantity"] < 0)),
        _per_item(usage, "inputs.usageItems", "unknown price model", lambda u: ~F.coalesce(u["price_config"]["model"].isin(PRICE_MODELS), F.lit(False))),
        _per_item(usage, "inputs.usageItems", "tiers must ascend", lambda u: _unsorted_tiers(u["price_config"])),
        _per_item(F.col("commitments"), "inputs.commitments", "amount must be 0 or more", lambda c: c["amount"] < 0),
        _per_item(F.col("credits"), "inputs.credits", "amount must be 0 or more", lambda c: c["amount"] < 0),
    ]
    # the outer form keeps the checks out of an inferred filter, where they would run a second time
    broken = scenarios.select(
        F.col("name").alias("scenario"), F.explode_outer(reduce(lambda a, b: F.concat(a, b), found)).alias("v")
    ).filter(F.col("v").isNotNull())
    return broken.select("scenario", F.col("v.path").alias("path"), F.col("v.message").alias("message"))
