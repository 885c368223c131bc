"""Pricing studies, plan allowances, credit grants, plan changes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallymill.functions import money
from tallymill.operators.asof import as_of
from tallymill.operators.joins import attach, lookup
from tallymill.operators.prefix import previous_by_value, running_sum
from tallymill.operators.rating import rate_lines
from tallymill.schemas import MONEY, QTY, RATED_QTY, SUM


def compare_options(usage: DataFrame, options: DataFrame) -> DataFrame:
    """Usage rows rated under every option that prices their metric: one equal join on the metric."""
    return rate_lines(lookup(usage, options, ["metric"]))


def segment_of(quantity: Column, bounds: list[tuple[str, float]], largest: str) -> Column:
    """Name of the first segment whose bound holds the quantity."""
    name = None
    for segment, bound in bounds:
        name = F.when(quantity <= bound, segment) if name is None else name.when(quantity <= bound, segment)
    return name.otherwise(largest)


def pricing_study(patterns: DataFrame, options: DataFrame) -> DataFrame:
    """Revenue per option and segment, and per option over all segments (segment null).

    ``patterns`` has segment, metric, quantity and customers; equal quantities are rated once.
    """
    distinct = patterns.groupBy("segment", "metric", "quantity").agg(F.sum("customers").cast("bigint").alias("customers"))
    rated = compare_options(distinct, options)
    revenue = F.sum(F.round("subtotal", 2) * F.col("customers")).cast(MONEY).alias("revenue")
    return rated.rollup("option", "segment").agg(
        revenue, F.sum("customers").alias("customers"), F.grouping("option").alias("_all")
    ).filter("_all = 0").drop("_all")


def customer_impact(usage: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Old total, new total and change per customer: both prices are applied in one pass over the usage."""
    both = lookup(
        usage,
        old.withColumnRenamed("price_config", "_old").join(new.withColumnRenamed("price_config", "_new"), "metric"),
        ["metric"],
    )
    amounts = both.select(
        "tenant_id",
        "customer_ref",
        money.line_amounts(F.col("quantity"), F.col("_old"))["subtotal"].alias("_old"),
        money.line_amounts(F.col("quantity"), F.col("_new"))["subtotal"].alias("_new"),
    )
    totals = amounts.groupBy("tenant_id", "customer_ref").agg(
        F.sum("_old").cast(MONEY).alias("old_total"), F.sum("_new").cast(MONEY).alias("new_total")
    )
    return totals.withColumn("change", (F.col("new_total") - F.col("old_total")).cast(MONEY))


def quantity_edges(usage: DataFrame) -> DataFrame:
    """Distinct probe quantities per metric: each used quantity, 0, the next whole units, and a very large one."""
    q = F.col("quantity")
    probes = F.array(
        *[
            x.cast(RATED_QTY)
            for x in (F.lit(0), q, F.ceil(q), F.ceil(q) + 1, q - F.lit("0.01").cast(QTY), q * 10000)
        ]
    )
    return (
        usage.select("metric", F.explode(probes).alias("quantity")).filter("quantity >= 0").distinct()
    )


def price_drops(rated: DataFrame, parts: int = 64) -> DataFrame:
    """Rows whose total is below that of the next smaller quantity of the same option and metric."""
    stepped = previous_by_value(
        rated.select("option", "metric", "quantity", "subtotal"), ["option", "metric"], "quantity",
        ["quantity", "subtotal"], parts,
    )
    return stepped.filter(F.col("subtotal") < F.col("previous_subtotal"))


def overage_units(used: Column, included: Column) -> Column:
    return F.greatest(F.lit(0).cast(RATED_QTY), (used - included).cast(RATED_QTY))


def rate_plans(usage: DataFrame, allowances: DataFrame, plan_prices: DataFrame) -> DataFrame:
    """Per customer of a plan: base price plus, per metric, units above the included amount at rate or tiers.

    ``usage`` carries ``plan``; ``allowances`` has plan, metric, included and price_config of the overage.
    """
    over = lookup(usage, allowances, ["plan", "metric"]).withColumn(
        "quantity", overage_units(F.col("quantity"), F.col("included"))
    )
    charged = rate_lines(over).groupBy("tenant_id", "customer_ref", "period_start", "plan").agg(
        F.sum("subtotal").cast(MONEY).alias("overage_charge"), F.sum("quantity").cast(SUM).alias("overage_units")
    )
    return lookup(charged, plan_prices, ["plan"]).withColumn(
        "total", (F.col("base_price") + F.col("overage_charge")).cast(MONEY)
    )


def running_overage(daily: DataFrame, included: Column) -> DataFrame:
    """Running usage and running units above the allowance, per key and period; at most one row per day."""
    w = W.partitionBy("tenant_id", "metric", "customer_ref", "period_start").orderBy("day").rowsBetween(
        W.unboundedPreceding, 0
    )
    return daily.withColumn("running_usage", F.sum("quantity").over(w).cast(SUM)).withColumn(
        "running_overage",
        F.greatest(F.lit(0).cast(SUM), (F.col("running_usage") - included).cast(SUM)),
    )


def mixed_cadence(plans: DataFrame) -> DataFrame:
    """Invoice of a window with a plan change, an annual add-on and metered overage; whole cents, rounded once.

    Columns: days, upgrade_day, addon_day (whole numbers), base_before, base_after, addon (cents),
    used, included (quantities), overage_cents (cents per unit, whole).
    """
    days, year = F.col("days"), F.lit(365)
    before = F.greatest(F.lit(0), F.least("upgrade_day", "days"))
    after = F.greatest(F.lit(0), days - before)
    addon_days = F.greatest(F.lit(0), days - F.col("addon_day"))
    metered = overage_units(F.col("used"), F.col("included")) * F.col("overage_cents")
    fixed = (F.col("base_before") * before + F.col("base_after") * after) * year + F.col("addon") * addon_days * days
    denominator = (days * year).cast("decimal(12,0)")
    numerator = fixed.cast("decimal(24,6)") + metered.cast("decimal(24,6)") * denominator
    rounded = F.call_function("div", (numerator * 2 + denominator).cast(SUM), (denominator * 2).cast(SUM))
    return plans.select(
        "*",
        before.alias("days_before"),
        after.alias("days_after"),
        addon_days.alias("addon_days"),
        metered.cast(SUM).alias("metered_cents"),
        rounded.alias("total_cents"),
    )


# ---- credit grants ----------------------------------------------------------

_POOL = (
    f"struct<valid_from:date,valid_to:date,rollover:boolean,left:{SUM},burned:{SUM},roll_marks:array<{SUM}>,"
    f"expired:{SUM},first_from:date,first_to:date>"
)
_STATE = f"struct<pools:array<{_POOL}>,rest:{SUM},overage:{SUM}>"


def _expire(pools: Column, day: Column, extend: int) -> Column:
    """Pools past their end roll what is left into the days behind it, or lose it."""
    zero = F.lit(0).cast(SUM)

    def one(p):
        over = (day > p["valid_to"]) & (p["left"] > 0)
        rolls, loses = over & p["rollover"], over & ~p["rollover"]
        return F.struct(
            F.when(rolls, F.date_add(p["valid_to"], 1)).otherwise(p["valid_from"]).alias("valid_from"),
            F.when(rolls, F.date_add(p["valid_to"], extend)).otherwise(p["valid_to"]).alias("valid_to"),
            p["rollover"].alias("rollover"),
            F.when(loses, zero).otherwise(p["left"]).alias("left"),
            p["burned"].alias("burned"),
            F.when(rolls, F.array_append(p["roll_marks"], p["burned"])).otherwise(p["roll_marks"]).alias("roll_marks"),
            F.when(loses, p["left"]).otherwise(p["expired"]).cast(SUM).alias("expired"),
            p["first_from"].alias("first_from"),
            p["first_to"].alias("first_to"),
        ).cast(_POOL)

    # the order of the fields is the burn order
    return F.sort_array(F.transform(pools, one))


def burn_grants(
    daily: DataFrame, grants: DataFrame, start: dt.date, days: int, boundaries: list[dt.date], extend: int = 30
) -> DataFrame:
    """Burn, expiry and rollover of credit grants, oldest first: one row per customer.

    ``daily``: tenant_id, customer_ref, day, quantity. ``grants``: id, position, tenant_id,
    customer_ref, amount, valid_from, valid_to, rollover. A grant can be used on its days, both ends
    included. After the usage of each boundary day, and once after the window, a grant past its end
    either rolls what is left into the ``extend`` days behind its end or loses it.

    Grants of one customer with the same days are pooled first, so a row holds calendar days only,
    however many grants there are; the walk over the days is an expression of that row.
    """
    customer = ["tenant_id", "customer_ref"]
    zero = F.lit(0).cast(SUM)
    first, last = F.lit(start), F.lit(start + dt.timedelta(days=days - 1))
    pool_keys = customer + ["valid_from", "valid_to", "rollover"]
    pools = (
        grants.groupBy(*pool_keys)
        .agg(F.sum("amount").cast(SUM).alias("left"))
        .groupBy(*customer)
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "valid_from", "valid_to", "rollover", "left", zero.alias("burned"),
                        F.array().cast(f"array<{SUM}>").alias("roll_marks"), zero.alias("expired"),
                        F.col("valid_from").alias("first_from"), F.col("valid_to").alias("first_to"),
                    ).cast(_POOL)
                )
            ).alias("pools")
        )
    )
    used = (
        daily.filter(F.col("day").between(first, last))
        .groupBy(*customer, "day")
        .agg(F.sum("quantity").cast(SUM).alias("quantity"))
        .groupBy(*customer)
        .agg(
            F.map_from_entries(F.collect_list(F.struct("day", "quantity"))).alias("by_day"),
            F.sum("quantity").cast(SUM).alias("usage_total"),
        )
    )
    checks = F.array(*[F.lit(d) for d in boundaries]).cast("array<date>")

    def walk(state, day):
        use = F.coalesce(F.col("by_day")[day], zero)

        def burn(acc, p):
            open_ = (p["valid_from"] <= day) & (day <= p["valid_to"])
            take = F.when(open_, F.least(p["left"], acc["rest"])).otherwise(zero)
            after = p.withField("left", (p["left"] - take).cast(SUM)).withField("burned", (p["burned"] + take).cast(SUM))
            return F.struct(
                F.array_append(acc["pools"], after.cast(_POOL)).alias("pools"),
                (acc["rest"] - take).cast(SUM).alias("rest"),
                acc["overage"].alias("overage"),
            ).cast(_STATE)

        empty = F.struct(F.array().cast(f"array<{_POOL}>").alias("pools"), use.alias("rest"), state["overage"].alias("overage"))
        return F.aggregate(
            state["pools"],
            empty.cast(_STATE),
            burn,
            lambda acc: F.struct(
                F.when(F.array_contains(checks, day), _expire(acc["pools"], day, extend)).otherwise(acc["pools"]).alias("pools"),
                zero.alias("rest"),
                (acc["overage"] + acc["rest"]).cast(SUM).alias("overage"),
            ).cast(_STATE),
        )

    joined = used.join(pools, customer, "full_outer")
    begin = F.struct(
        F.coalesce("pools", F.array().cast(f"array<{_POOL}>")).alias("pools"), zero.alias("rest"), zero.alias("overage")
    ).cast(_STATE)
    end = F.lit(start + dt.timedelta(days=days))
    walked = joined.withColumn("_state", F.aggregate(F.sequence(first, last), begin, walk))
    return walked.select(
        *customer,
        F.coalesce("usage_total", zero).alias("usage_total"),
        F.col("_state.overage").alias("overage_total"),
        _expire(F.col("_state.pools"), end, extend).alias("pools"),
    )


def grant_ledger(burned: DataFrame, grants: DataFrame) -> DataFrame:
    """Burned, remaining, expired and rolled per grant: the pool's burn is dealt in grant order."""
    pool_keys = ["tenant_id", "customer_ref", "valid_from", "valid_to", "rollover"]
    placed = running_sum(grants, pool_keys, "position", "amount", "before")
    pools = burned.select("tenant_id", "customer_ref", F.explode_outer("pools").alias("p")).select(
        "tenant_id", "customer_ref",
        F.col("p.first_from").alias("valid_from"), F.col("p.first_to").alias("valid_to"), "p.rollover",
        "p.burned", "p.roll_marks", "p.expired",
        F.col("p.valid_from").alias("new_from"), F.col("p.valid_to").alias("new_to"),
    )
    joined = attach(placed, pools, pool_keys, "inner")

    def dealt(pool_burned: Column) -> Column:
        rest = (pool_burned - F.col("before")).cast(SUM)
        return F.greatest(F.lit(0).cast(SUM), F.least(F.col("amount").cast(SUM), rest)).cast(SUM)

    rolled = F.aggregate(
        "roll_marks", F.lit(0).cast(SUM), lambda acc, mark: (acc + F.col("amount") - dealt(mark)).cast(SUM)
    )
    left = (F.col("amount") - F.col("grant_burned")).cast(SUM)
    gone = F.col("expired") > 0
    return joined.withColumn("grant_burned", dealt(F.col("burned"))).select(
        "id",
        "tenant_id",
        "customer_ref",
        F.col("amount").cast(SUM).alias("amount"),
        F.col("grant_burned").alias("burned"),
        F.when(gone, F.lit(0).cast(SUM)).otherwise(left).cast(SUM).alias("remaining"),
        F.when(gone, left).otherwise(F.lit(0)).cast(SUM).alias("expired"),
        F.col("new_from").alias("valid_from"),
        F.col("new_to").alias("valid_to"),
        rolled.alias("rolled"),
    )


def burn_totals(burned: DataFrame) -> DataFrame:
    """Usage, burned and overage per customer."""
    total = F.aggregate("pools", F.lit(0).cast(SUM), lambda acc, p: (acc + p["burned"]).cast(SUM))
    return burned.select("tenant_id", "customer_ref", "usage_total", total.alias("burned_total"), "overage_total")


# ---- plan changes -----------------------------------------------------------


def split_by_item(usage: DataFrame, changes: DataFrame) -> DataFrame:
    """Usage per customer, metric, month and the item that was active at the time; before the first change, none.

    ``changes``: customer_ref, changed_at, item; of changes at one time the greatest item counts. An event takes the
    newest change at or before it, so no event meets any other segment of the customer's timeline. Changes
    are gathered per customer and day.
    """
    events = usage.select("customer_ref", "metric", "period_start", "ts", "quantity")
    placed = as_of(events, changes, ["customer_ref"], "ts", "changed_at", ["item"], slices="day")
    return placed.groupBy("customer_ref", "metric", "period_start", "item").agg(
        F.sum("quantity").cast(SUM).alias("agg_sum"), F.count("*").alias("n_events")
    )
