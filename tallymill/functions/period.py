"""Billing periods, lateness bounds and proration factors. Everything is UTC."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def period_start(ts: Column, kind: str | Column = "monthly") -> Column:
    """First day of the billing period; ``kind`` is a word or a column of words."""
    day = F.to_date(ts)
    if isinstance(kind, Column):
        return F.when(kind == "daily", day).otherwise(F.trunc(day, "MM"))
    return day if kind == "daily" else F.trunc(day, "MM")


def period_end(start: Column, kind: str | Column = "monthly") -> Column:
    """Last day of the billing period, inclusive."""
    if isinstance(kind, Column):
        return F.when(kind == "daily", start).otherwise(F.last_day(start))
    return start if kind == "daily" else F.last_day(start)


def in_period(ts: Column, start: Column, end: Column) -> Column:
    """True from the first instant of ``start`` to the last instant of ``end``."""
    return (ts >= start.cast("timestamp")) & (ts < F.date_add(end, 1).cast("timestamp"))


def hours(n: int | Column) -> Column:
    n = F.lit(n) if isinstance(n, (int, float)) else n
    return F.make_dt_interval(F.lit(0), n)


def seconds(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n)


def watermark(now: Column, lateness: Column) -> Column:
    return now - lateness


def too_late(ts: Column, watermark_ts: Column, lateness: Column) -> Column:
    """Strictly older than the watermark less the lateness window."""
    return ts < watermark_ts - lateness


def current_period(now: datetime, kind: str = "monthly") -> tuple[str, str]:
    """First and last day of the period of ``now``."""
    day = now.date()
    if kind == "daily":
        return day.isoformat(), day.isoformat()
    first = day.replace(day=1)
    after = (first + timedelta(days=32)).replace(day=1)
    return first.isoformat(), (after - timedelta(days=1)).isoformat()


_RELATIVE = re.compile(
    r"^-P(?:(?P<days>\d+)D)?(?:T(?:(?P<hours>\d+)H)?(?:(?P<minutes>\d+)M)?(?:(?P<seconds>\d+)S)?)?$"
)


def parse_bound(text: str, now: datetime) -> datetime:
    """An ISO instant, the word ``now``, or a backward ISO duration such as ``-PT24H``."""
    if text == "now":
        return now
    found = _RELATIVE.match(text)
    if found and any(found.groupdict().values()):
        return now - timedelta(**{unit: int(n) for unit, n in found.groupdict().items() if n})
    moment = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return moment.astimezone(timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def _millis(moment: Column) -> Column:
    return F.unix_millis(moment.cast("timestamp"))


def _overlap_millis(start, end, p_start, p_end) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), F.least(end, p_end) - F.greatest(start, p_start))


def proration_factor(start: Column, end: Column, p_start: Column, p_end: Column) -> Column:
    """Share of the period that [start, end] covers; the period ends at 23:59:59.999 of its last day."""
    lo, hi = _millis(p_start), _millis(F.date_add(p_end, 1)) - 1
    covered = _overlap_millis(_millis(start), _millis(end), lo, hi)
    return F.least(F.lit(1.0), F.try_divide(covered.cast("double"), (hi - lo).cast("double")))


def prorate(amount: Column, start: Column, end: Column, p_start: Column, p_end: Column) -> Column:
    """Amount for the covered share, period end exclusive, rounded to cents; null for an empty period."""
    lo, hi = _millis(p_start), _millis(p_end)
    covered = _overlap_millis(_millis(start), _millis(end), lo, hi)
    whole = F.try_divide(
        (amount.cast("decimal(22,6)") * covered.cast("decimal(15,0)")), (hi - lo).cast("decimal(15,0)")
    )
    return F.round(whole, 2).cast("decimal(38,2)")
