"""Prices as column expressions over ``array<struct<up_to,unit_price,flat_price>>``.

A tier whose bound is null or 0 is unbounded. Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill.schemas import MONEY, PRICE, RATED_QTY

TOTAL = "decimal(38,12)"


def round_currency(amount: Column, places: int = 2) -> Column:
    """Half up, away from zero."""
    return F.round(amount, places).cast(f"decimal(38,{places})")


def _bound(tier: Column) -> Column:
    return F.when(tier["up_to"] != 0, tier["up_to"])


def tier_units(quantity: Column, tiers: Column) -> Column:
    """Units of ``quantity`` that fall into each tier, with its prices and its position from 1."""
    qty = quantity.cast(RATED_QTY)
    zero = F.lit(0).cast(RATED_QTY)

    def one(tier, i):
        low = F.when(i == 0, zero).otherwise(_bound(F.get(tiers, i - 1)))
        high = F.least(qty, F.coalesce(_bound(tier), qty))
        # an unbounded tier takes everything, so the tiers behind it get nothing
        units = F.when(low.isNull(), zero).otherwise(F.greatest(zero, high - low))
        return F.struct(
            (i + 1).alias("tier"),
            units.cast(RATED_QTY).alias("units"),
            tier["unit_price"].cast(PRICE).alias("unit_price"),
            F.coalesce(tier["flat_price"], F.lit(0)).cast(PRICE).alias("flat_price"),
        )

    return F.transform(tiers, one)


def _sum_over(units: Column, amount) -> Column:
    return F.aggregate(units, F.lit(0).cast(TOTAL), lambda acc, t: (acc + amount(t)).cast(TOTAL))


def tiered_total(quantity: Column, tiers: Column) -> Column:
    """Every unit at the price of its tier, rounded once."""
    return round_currency(_sum_over(tier_units(quantity, tiers), lambda t: t["units"] * t["unit_price"]))


def graduated_total(quantity: Column, tiers: Column) -> Column:
    """As tiered, plus the flat fee of each tier that got units."""

    def amount(t):
        fee = F.when(t["units"] > 0, t["flat_price"]).otherwise(F.lit(0).cast(PRICE))
        return t["units"] * t["unit_price"] + fee

    return round_currency(_sum_over(tier_units(quantity, tiers), amount))


def volume_tier(quantity: Column, tiers: Column) -> Column:
    """The tier that the whole quantity reaches; beyond all tiers, the last one."""
    qty = quantity.cast(RATED_QTY)
    reached = F.filter(tiers, lambda t: F.coalesce(qty <= _bound(t), F.lit(True)))
    return F.coalesce(F.get(reached, F.lit(0)), F.get(tiers, F.size(tiers) - 1))


def volume_total(quantity: Column, tiers: Column) -> Column:
    price = F.coalesce(volume_tier(quantity, tiers)["unit_price"], F.lit(0)).cast(PRICE)
    return round_currency(quantity.cast(RATED_QTY) * price)


def flat_total(quantity: Column, unit_price: Column) -> Column:
    return round_currency(quantity.cast(RATED_QTY) * F.coalesce(unit_price, F.lit(0)).cast(PRICE))


def package_total(quantity: Column, package_size: Column, unit_price: Column) -> Column:
    """Started packages times the price; a missing or zero size counts as 1."""
    size = F.coalesce(F.when(package_size != 0, package_size), F.lit(1)).cast(RATED_QTY)
    packages = F.ceil(quantity.cast(RATED_QTY) / size).cast("decimal(24,0)")
    return round_currency(packages * F.coalesce(unit_price, F.lit(0)).cast(PRICE))


def clamp_charge(subtotal: Column, minimum: Column, maximum: Column) -> Column:
    """Minimum, then maximum; null and 0 mean none."""
    raised = F.when((minimum != 0) & (subtotal < minimum), minimum).otherwise(subtotal)
    return F.when((maximum != 0) & (raised > maximum), maximum).otherwise(raised).cast(RATED_QTY)


# model -> (subtotal before the clamp, effective unit price)
def _share(subtotal: Column, quantity: Column) -> Column:
    return F.when(quantity > 0, subtotal.cast("decimal(24,2)") / quantity).otherwise(F.lit(0))


def _tiered(q, p):
    subtotal = F.when(p["tiers"].isNotNull(), tiered_total(q, p["tiers"])).otherwise(F.lit(0))
    return subtotal, _share(subtotal, q)


def _graduated(q, p):
    subtotal = F.when(p["tiers"].isNotNull(), graduated_total(q, p["tiers"])).otherwise(F.lit(0))
    return subtotal, _share(subtotal, q)


def _volume(q, p):
    subtotal = F.when(p["tiers"].isNotNull(), volume_total(q, p["tiers"])).otherwise(F.lit(0))
    return subtotal, F.coalesce(volume_tier(q, p["tiers"])["unit_price"], F.lit(0))


def _flat(q, p):
    return flat_total(q, p["unit_price"]), F.coalesce(p["unit_price"], F.lit(0))


def _package(q, p):
    return package_total(q, p["package_size"], p["unit_price"]), F.coalesce(p["unit_price"], F.lit(0))


PRICING = {
    "tiered": _tiered,
    "volume": _volume,
    "graduated": _graduated,
    "flat": _flat,
    "package": _package,
}


def line_amounts(quantity: Column, price: Column) -> Column:
    """``struct<subtotal,unit_price>`` of one priced line; an unknown model costs 0 before the clamp."""
    quantity = quantity.cast(RATED_QTY)
    subtotal = unit = None
    for model, amounts in PRICING.items():
        s, u = amounts(quantity, price)
        s, u = s.cast("decimal(24,2)"), round_currency(u).cast("decimal(24,2)")
        chosen = price["model"] == model
        subtotal = F.when(chosen, s) if subtotal is None else subtotal.when(chosen, s)
        unit = F.when(chosen, u) if unit is None else unit.when(chosen, u)
    zero = F.lit(0).cast("decimal(24,2)")
    clamped = clamp_charge(subtotal.otherwise(zero), price["minimum_charge"], price["maximum_charge"])
    return F.struct(
        clamped.alias("subtotal"), unit.otherwise(zero).cast(MONEY).alias("unit_price")
    )
