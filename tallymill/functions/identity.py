"""Deterministic keys of events and of usage reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key patterns (event, push, push with a time, shadow push).
KEY_PATTERNS = [
    r"^evt_[a-f0-9]{16}$",
    r"^push:[a-f0-9-]+:si_[a-zA-Z0-9]+:\d{4}-\d{2}-\d{2}:\d+\.\d{6}$",
    r"^push:[a-f0-9-]+:si_[a-zA-Z0-9]+:\d{4}-\d{2}-\d{2}:\d+\.\d{6}:\d+$",
    r"^push-shadow:[a-f0-9-]+:si_[a-zA-Z0-9]+:\d{4}-\d{2}-\d{2}:\d+\.\d{6}$",
]

ISO_MILLIS = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def blank_to_null(col: Column) -> Column:
    return F.when(col != "", col)


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, ISO_MILLIS)


def _digest(parts: list[Column]) -> Column:
    return F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16))


def idempotency_key(
    tenant: str = "tenant_id",
    metric: str = "metric",
    customer: str = "customer_ref",
    resource: str = "resource_id",
    ts: str = "ts",
) -> Column:
    """``evt_`` and 16 hex digits of the hash of tenant, metric, customer, resource or "default", time."""
    return _digest(
        [
            F.col(tenant),
            F.col(metric),
            F.col(customer),
            F.coalesce(blank_to_null(F.col(resource)), F.lit("default")),
            iso_millis(F.col(ts)),
        ]
    )


def key_from_fields(fields: Column, values: dict[str, Column]) -> Column:
    """Key over the field names listed in an array column, in the listed order."""
    lookup = F.create_map(*[part for name, col in values.items() for part in (F.lit(name), col.cast("string"))])
    return F.concat(
        F.lit("evt_"),
        F.substring(
            F.sha2(F.array_join(F.transform(fields, lambda name: lookup[name]), "|", "default"), 256), 1, 16
        ),
    )


def resolve_key(own: Column, batch: Column, generated: Column) -> Column:
    """Own key, else the key of the batch, else the generated one."""
    return F.coalesce(blank_to_null(own), blank_to_null(batch), generated)


def push_key(tenant: Column, item: Column, period: Column, total: Column, shadow: Column) -> Column:
    """``push:tenant:item:period:total`` with six decimals; shadow rows start with ``push-shadow``."""
    return F.concat_ws(
        ":",
        F.when(shadow, F.lit("push-shadow")).otherwise(F.lit("push")),
        tenant,
        item,
        period.cast("string"),
        total.cast("decimal(38,6)").cast("string"),
    )


def is_valid_key(key: Column) -> Column:
    hit = F.lit(False)
    for pattern in KEY_PATTERNS:
        hit = hit | key.rlike(pattern)
    return F.coalesce(hit, F.lit(False))
