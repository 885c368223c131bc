"""Tolerant comparison, drift and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill.schemas import RECON_EPSILON

# Default tolerances of a comparison.
ABSOLUTE_TOLERANCE = 0.001
RELATIVE_TOLERANCE = 0.0005


def approx_equal(actual: Column, expected: Column, absolute: Column | None = None, relative: Column | None = None):
    """Equal within the absolute tolerance, or within the relative one against max(1, |expected|)."""
    absolute = F.coalesce(absolute, F.lit(ABSOLUTE_TOLERANCE)) if absolute is not None else F.lit(ABSOLUTE_TOLERANCE)
    relative = F.coalesce(relative, F.lit(RELATIVE_TOLERANCE)) if relative is not None else F.lit(RELATIVE_TOLERANCE)
    diff = F.abs(actual - expected).cast("double")
    return (diff <= absolute) | (diff / F.greatest(F.lit(1.0), F.abs(expected.cast("double"))) <= relative)


def drift_abs(local: Column, billed: Column) -> Column:
    return F.abs(local - billed)


def drift_pct(local: Column, billed: Column) -> Column:
    """Share of the billed total; 1 when nothing was billed but something was used."""
    gap = drift_abs(local, billed)
    return (
        F.when(billed > 0, gap.cast("double") / billed.cast("double"))
        .when(gap > 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def recon_status(pct: Column, epsilon: float = RECON_EPSILON) -> Column:
    return F.when(pct <= epsilon, F.lit("ok")).otherwise(F.lit("investigate"))


def parity_label(pct: Column) -> Column:
    return (
        F.when(pct <= 0.005, F.lit("parity"))
        .when(pct <= 0.05, F.lit("drift_detected"))
        .otherwise(F.lit("drift_critical"))
    )


def age_label(moment: Column, now: Column) -> Column:
    """``just now``, ``5m ago``, ``3h ago``, ``2d ago``; from seven days on the date and time."""
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(moment)) / 60000)
    return (
        F.when(minutes < 1, F.lit("just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .when(minutes < 10080, F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(moment, "MMM d, yyyy, hh:mm a"))
    )


def difference_text(field: Column, expected: Column, actual: Column) -> Column:
    return F.concat(
        field,
        F.lit(": expected "),
        F.coalesce(expected, F.lit("null")),
        F.lit(", got "),
        F.coalesce(actual, F.lit("null")),
    )
