"""Threshold, budget and spike alerts over counters; caps on ingest.

A rule may leave customer or metric open. Instead of matching every counter with every open
rule, the counters are summed once at the four grains (cube), and rules meet them by an equal join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.period import hours
from tallymill.operators.joins import attach, lookup
from tallymill.schemas import SUM

ANY = "*"


def _open(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(ANY))


def scope_totals(counters: DataFrame) -> DataFrame:
    """Sum per tenant, period and scope; an open customer or metric is ``*``."""
    return (
        counters.groupBy("tenant_id", "period_start", "customer_ref", "metric")
        .agg(F.sum("agg_sum").cast(SUM).alias("_sum"))
        .groupingSets(
            [
                [F.col("tenant_id"), F.col("period_start")],
                [F.col("tenant_id"), F.col("period_start"), F.col("customer_ref")],
                [F.col("tenant_id"), F.col("period_start"), F.col("metric")],
                [F.col("tenant_id"), F.col("period_start"), F.col("customer_ref"), F.col("metric")],
            ],
            "tenant_id", "period_start", "customer_ref", "metric",
        )
        .agg(F.sum("_sum").cast(SUM).alias("value"))
        .select("tenant_id", "period_start", _open("customer_ref").alias("_customer"), _open("metric").alias("_metric"), "value")
    )


def evaluate(configs: DataFrame, counters: DataFrame, period: str | Column | None = None) -> DataFrame:
    """Triggered alerts per rule and period (all periods when none is given).

    threshold and budget: usage in scope >= threshold. spike: usage / usage of the month before >= threshold,
    and never when the month before had none.
    """
    rules = configs.filter("enabled").withColumn("_customer", _open("customer_ref")).withColumn("_metric", _open("metric"))
    scope = ["tenant_id", "_customer", "_metric"]
    if period is not None:
        day = period if isinstance(period, Column) else F.lit(period).cast("date")
        counters = counters.filter((F.col("period_start") == day) | (F.col("period_start") == F.add_months(day, -1)))
    totals = scope_totals(counters)
    before = totals.select(*scope, F.add_months("period_start", 1).alias("period_start"), F.col("value").alias("_before"))
    both = totals.join(before, scope + ["period_start"], "left")
    if period is not None:
        both = both.filter(F.col("period_start") == day)
    ratio = F.when(F.col("_before") > 0, F.col("value").cast("double") / F.col("_before").cast("double")).otherwise(F.lit(0.0))
    hit = F.when(F.col("type") == "spike", ratio >= F.col("threshold").cast("double")).otherwise(
        F.col("value") >= F.col("threshold")
    )
    return attach(rules, both, scope, "inner").filter(hit).drop("_customer", "_metric", "_before")


def without_cooldown(triggered: DataFrame, history: DataFrame, now: Column, cooldown_hours: int = 1) -> DataFrame:
    """Drops alerts whose rule fired for the same period within the last hour."""
    recent = history.filter(F.col("triggered_at") > now - hours(cooldown_hours)).select(
        F.col("alert_config_id").alias("id"), F.to_date(F.get_json_object("metadata", "$.periodStart")).alias("period_start")
    )
    return triggered.join(recent, ["id", "period_start"], "left_anti")


def alert_records(triggered: DataFrame, now: Column) -> DataFrame:
    """Rows for the alert history."""
    return triggered.select(
        F.concat_ws(":", "id", "period_start").alias("id"),
        F.col("id").alias("alert_config_id"),
        "tenant_id",
        "customer_ref",
        "metric",
        F.col("value").cast(SUM).alias("value"),
        "threshold",
        "action",
        F.lit("triggered").alias("status"),
        F.to_json(F.struct(F.col("period_start").cast("string").alias("periodStart"), F.col("type").alias("configType"))).alias("metadata"),
        now.alias("triggered_at"),
    )


def outbox(triggered: DataFrame, now: Column) -> DataFrame:
    """Messages to send, as rows: channel, target and payload. A webhook or Slack rule without a target gives none.

    A cap rule whose config asks to notify the customer gives an email with the threshold as value.
    """
    setting = lambda name: F.get_json_object("config", f"$.{name}")
    notify = F.col("action").isin("hard_cap", "soft_cap") & (setting("notifyCustomer") == "true")
    channel = F.when(F.col("action").isin("email", "webhook", "slack"), F.col("action")).when(notify, F.lit("email"))
    target = (
        F.when(F.col("channel") == "email", setting("email"))
        .when(F.col("channel") == "webhook", setting("url"))
        .otherwise(setting("webhook"))
    )
    shown = F.when(F.col("action").isin("hard_cap", "soft_cap"), F.col("threshold").cast(SUM)).otherwise(F.col("value"))
    keep = {"ignoreNullFields": "false"}
    email = F.to_json(
        F.struct(
            F.col("target").alias("to"),
            F.concat(F.lit("Usage Alert: "), F.col("type"), F.lit(" threshold exceeded")).alias("subject"),
            F.lit("usage_alert").alias("template"),
            F.struct(
                "type", shown.alias("value"), F.col("threshold").cast(SUM).alias("threshold"), "metric",
                F.col("customer_ref").alias("customerRef"),
            ).alias("data"),
        ),
        keep,
    )
    webhook = F.to_json(
        F.struct(
            F.col("id").alias("alertId"), "type", "metric", F.col("customer_ref").alias("customerRef"),
            F.col("value").alias("currentValue"), F.col("threshold").cast(SUM).alias("threshold"),
            F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        ),
        keep,
    )
    text = F.concat(
        F.lit("*Alert Type:* "), F.col("type"),
        F.lit("\n*Metric:* "), F.coalesce("metric", F.lit("All")),
        F.lit("\n*Customer:* "), F.coalesce("customer_ref", F.lit("All")),
        F.lit("\n*Current Value:* "), F.col("value").cast("string"),
        F.lit("\n*Threshold:* "), F.col("threshold").cast("string"),
    )
    slack = F.to_json(
        F.struct(
            F.lit("Usage Alert").alias("text"),
            F.array(F.struct(F.lit("section").alias("type"), F.struct(F.lit("mrkdwn").alias("type"), text.alias("text")).alias("text"))).alias("blocks"),
        )
    )
    return (
        triggered.withColumn("channel", channel)
        .filter(F.col("channel").isNotNull())
        .withColumn("target", target)
        .filter((F.col("channel") == "email") | (F.coalesce(F.col("target"), F.lit("")) != ""))
        .select(
            "id", "tenant_id", "period_start", "channel", "target",
            F.when(F.col("channel") == "email", email).when(F.col("channel") == "webhook", webhook).otherwise(slack).alias("payload"),
        )
    )


def caps(triggered: DataFrame) -> DataFrame:
    """Hard and soft caps per tenant, customer or all, metric or all."""
    return (
        triggered.filter(F.col("action").isin("hard_cap", "soft_cap"))
        .groupBy("tenant_id", _open("customer_ref").alias("customer_ref"), _open("metric").alias("metric"))
        .agg(
            F.max(F.col("action") == "hard_cap").alias("hard"),
            F.max(F.col("action") == "soft_cap").alias("soft"),
        )
    )


def enforce_caps(events: DataFrame, in_force: DataFrame) -> DataFrame:
    """Adds ``cap``: ``reject`` under a hard cap, ``warn`` under a soft one, else null.

    ``in_force`` is the written table of ``caps``. One lookup per grain; a grain has at most one row per key, so events never multiply.
    """
    marked = events
    flags = []
    for i, (customer, metric) in enumerate([(True, True), (True, False), (False, True), (False, False)]):
        grain = in_force.filter(
            ((F.col("customer_ref") != ANY) if customer else (F.col("customer_ref") == ANY))
            & ((F.col("metric") != ANY) if metric else (F.col("metric") == ANY))
        )
        on = ["tenant_id"] + (["customer_ref"] if customer else []) + (["metric"] if metric else [])
        marked = lookup(
            marked, grain.select(*on, F.col("hard").alias(f"_hard{i}"), F.col("soft").alias(f"_soft{i}")), on, "left"
        )
        flags.append(i)
    any_of = lambda kind: F.coalesce(F.greatest(*[F.col(f"_{kind}{i}") for i in flags]), F.lit(False))
    return marked.withColumn("cap", F.when(any_of("hard"), "reject").when(any_of("soft"), "warn")).drop(
        *[f"_{k}{i}" for k in ("hard", "soft") for i in flags]
    )


def list_history(
    history: DataFrame, tenant: str, customer: str | None = None, status: str | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    kept = history.filter(F.col("tenant_id") == tenant)
    if customer is not None:
        kept = kept.filter(F.col("customer_ref") == customer)
    if status is not None:
        kept = kept.filter(F.col("status") == status)
    if start is not None:
        kept = kept.filter(F.col("triggered_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        kept = kept.filter(F.col("triggered_at") <= F.lit(end).cast("timestamp"))
    return kept
