"""Read paths: scans, pages, counts, usage history, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions.period import in_period, period_start
from tallymill.operators.counters import fold, measure
from tallymill.operators.joins import lookup
from tallymill.schemas import SUM

# Page sizes and sort columns of the listings.
PAGE_SIZE = 25
MAX_PAGE_SIZE = 100
OPERATION_SORTS = {"createdAt": "created_at", "startedAt": "started_at", "completedAt": "completed_at"}
SCENARIO_SORTS = {"name": "name", "createdAt": "created_at", "updatedAt": "updated_at"}


def _moment(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def scan_ledger(
    ledger: DataFrame, tenant: str, start: str, end: str, metric: str | None = None, customer: str | None = None
) -> DataFrame:
    """Events of a closed time range in time order; the range also bounds the ledger's month folders."""
    rows = filter_events(ledger, tenant, metric, customer, None, start, end)
    return rows.orderBy("ts", "idempotency_key")


def filter_events(
    ledger: DataFrame,
    tenant: str,
    metric: str | None = None,
    customer: str | None = None,
    source: str | None = None,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    rows = ledger.filter(F.col("tenant_id") == tenant)
    for column, wanted in (("metric", metric), ("customer_ref", customer), ("source", source)):
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    months = "period_start" in ledger.columns
    if start is not None:
        rows = rows.filter(F.col("ts") >= _moment(start))
        if months:
            rows = rows.filter(F.col("period_start") >= period_start(_moment(start)))
    if end is not None:
        rows = rows.filter(F.col("ts") <= _moment(end))
        if months:
            rows = rows.filter(F.col("period_start") <= period_start(_moment(end)))
    return rows


def page(
    rows: DataFrame, sort: str, direction: str = "desc", key: str = "id", limit: int = PAGE_SIZE, offset: int = 0
) -> DataFrame:
    """One page of a listing, of ``MAX_PAGE_SIZE`` rows at most; ties in the sort column are broken by the key, ascending."""
    limit = min(limit, MAX_PAGE_SIZE)
    order = F.col(sort).desc() if direction == "desc" else F.col(sort).asc()
    return rows.orderBy(order, F.col(key).asc()).offset(offset).limit(limit)


#: Bins of one counting pass, and rows that are few enough to be sorted.
BINS = 4096
SORTED_ROWS = 100_000
#: Bytes of a key that make one number.
_CHUNK = 7


def _ordinals(rows: DataFrame, sort: str, direction: str, key: str):
    """Whole numbers in the order of the listing: one for the sort column, then one per part of the key."""
    kinds = dict(rows.dtypes)
    if kinds[sort] not in ("timestamp", "date", "bigint", "int", "smallint", "tinyint"):
        raise ValueError(f"no order of whole numbers for {sort}: {kinds[sort]}")
    number = {"timestamp": F.unix_micros, "date": F.unix_date}.get(kinds[sort], lambda c: c)(F.col(sort)).cast("bigint")
    # missing values come first in ascending order and last in descending, as in a sort
    yield F.coalesce(F.bitwise_not(number), F.lit(2**63 - 1)) if direction == "desc" else F.coalesce(number, F.lit(-(2**63)))
    if kinds[key] in ("bigint", "int", "smallint", "tinyint"):
        yield F.coalesce(F.col(key).cast("bigint"), F.lit(-(2**63)))
        return
    if kinds[key] != "string":
        raise ValueError(f"the key {key} is no text and no whole number")
    longest = rows.agg(F.max(F.octet_length(key))).first()[0] or 0
    for at in range(0, longest, _CHUNK):
        part = F.rpad(F.hex(F.substring(F.encode(F.coalesce(F.col(key), F.lit("")), "UTF-8"), at + 1, _CHUNK)), 2 * _CHUNK, "0")
        yield F.conv(part, 16, 10).cast("bigint")


def deep_page(
    rows: DataFrame, sort: str, direction: str = "desc", key: str = "id", limit: int = PAGE_SIZE, offset: int = 0, few: int = SORTED_ROWS
) -> DataFrame:
    """The page of ``page``, however far down, without a sort of what stands before it.

    Counts per bin of the sort column find the range of values that holds the page; further passes narrow it, at equal
    values by parts of the key, until it has ``few`` rows. Only those are sorted, and where a page spans values far apart
    or several values of many rows each, what lies between its ends. The passes run while the query is
    built and bring ``BINS`` counts each. ``sort``: timestamps, dates or whole numbers; ``key``: text or whole numbers.
    """
    limit = min(limit, MAX_PAGE_SIZE)
    within, before = rows, 0
    for ordinal in _ordinals(rows, sort, direction, key):
        edge = within.agg(F.min(ordinal).alias("low"), F.max(ordinal).alias("high"), F.count("*").alias("n")).first()
        low, high, n = edge["low"], edge["high"], edge["n"]
        while n > few and low < high:
            width = (high - low) // BINS + 1
            spot = ordinal.cast("decimal(20,0)") - F.lit(str(low)).cast("decimal(20,0)")
            place = F.call_function("div", spot, F.lit(str(width)).cast("decimal(20,0)")).cast("int")
            counts = dict(sorted(map(tuple, within.groupBy(place.alias("bin")).agg(F.count("*").alias("n")).collect())))
            first = last = None
            seen = before
            for bin_, m in counts.items():
                if first is None and seen + m > offset:
                    first, before = bin_, seen
                seen += m
                if first is not None and seen >= offset + limit:
                    last = bin_
                    break
            if first is None:  # the page lies behind all rows
                return within.limit(0)
            last = max(counts) if last is None else last
            n = sum(m for b, m in counts.items() if first <= b <= last)
            span = high - low
            low, high = low + first * width, min(high, low + (last + 1) * width - 1)
            within = within.filter(ordinal.between(low, high))
            if width == 1 or high - low == span:
                break
        if n <= few or low < high:
            break
    order = F.col(sort).desc() if direction == "desc" else F.col(sort).asc()
    return within.orderBy(order, F.col(key).asc()).offset(offset - before).limit(limit)


def with_total(page_rows: DataFrame, all_rows: DataFrame) -> DataFrame:
    """Adds the count of the whole listing, one value, to the rows of the page."""
    return page_rows.withColumn("total", all_rows.agg(F.count("*").alias("n")).scalar())


def count_events(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("total"))


def usage_history(
    events: DataFrame, mappings: DataFrame, tenant: str, first_day: str, last_day: str, step: str = "day"
) -> DataFrame:
    """Value per metric and bucket by the aggregation of the mapping (sum without one), and the total over buckets."""
    kept = events.filter(
        (F.col("tenant_id") == tenant)
        & in_period(F.col("ts"), F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))
    )
    buckets = fold(kept.withColumn("bucket", F.date_trunc(step, "ts")), ["tenant_id", "metric", "bucket"])
    words = mappings.filter("active").select("tenant_id", "metric", "aggregation")
    valued = lookup(buckets, words, ["tenant_id", "metric"], "left").select(
        "metric", "bucket", measure(F.col("aggregation")).alias("value")
    )
    totals = valued.groupBy("metric").agg(F.sum("value").cast(SUM).alias("total"))
    return valued.join(totals, "metric")


def current_usage(counters: DataFrame, period: str) -> DataFrame:
    """Usage of the period per customer and metric."""
    return counters.filter(F.col("period_start") == F.lit(period).cast("date")).select(
        "tenant_id", "customer_ref", "metric", F.col("agg_sum").alias("current")
    )


def freshness(projections: DataFrame, now: Column, updated: str = "updated_at") -> DataFrame:
    """Newest update per tenant and its age in seconds."""
    return projections.groupBy("tenant_id").agg(F.max(updated).alias("last_updated")).withColumn(
        "staleness_seconds", (F.unix_timestamp(now) - F.unix_timestamp("last_updated")).cast("bigint")
    )


def usage_against_limits(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds ``percent`` of the metric's limit; 0 where there is no limit."""
    joined = lookup(usage, limits, ["metric"], "left")
    share = F.col("current").cast("double") / F.col("usage_limit").cast("double") * 100
    return joined.withColumn("percent", F.when(F.col("usage_limit") > 0, share).otherwise(F.lit(0.0)))


def list_mappings(
    mappings: DataFrame, tenant: str | None = None, active: bool | None = None, metric: str | None = None
) -> DataFrame:
    """Mappings with their ``view``: shadow or live."""
    kept = mappings
    if tenant is not None:
        kept = kept.filter(F.col("tenant_id") == tenant)
    if active is not None:
        kept = kept.filter(F.col("active") == active)
    if metric is not None:
        kept = kept.filter(F.col("metric") == metric)
    return kept.withColumn("view", F.when(F.coalesce("shadow", F.lit(False)), "shadow").otherwise("live"))
