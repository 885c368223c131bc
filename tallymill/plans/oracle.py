"""DuckDB text of the derived tables, as common table expressions that name what they need."""

from __future__ import annotations

import re

from tallymill.plans import tables

_CTES: dict[str, str] = {}
_MATERIALIZED: set[str] = set()


def cte(name: str, text: str, materialized: bool = False) -> None:
    _CTES[name] = text
    if materialized:
        _MATERIALIZED.add(name)


def sql(body: str) -> str:
    """The body with a WITH clause of every expression that it uses, directly or not."""
    needed: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in _CTES:
            if name not in seen and re.search(rf"(?<!')\b{name}\b", text):
                seen.add(name)
                need(_CTES[name])
                needed.append(name)

    need(body)
    if not needed:
        return body
    parts = [f"{n} AS {'MATERIALIZED ' if n in _MATERIALIZED else ''}({_CTES[n]})" for n in needed]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, list):
        return "[" + ", ".join(literal(v) for v in value) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values(columns: str, rows: list[tuple]) -> str:
    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({columns})"


def event_key(ts: str = "ts") -> str:
    return (
        "'evt_' || substr(sha256(concat_ws('|', tenant_id, metric, customer_ref, "
        f"coalesce(nullif(resource_id, ''), 'default'), strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ'))), 1, 16)"
    )


def micros(expr: str) -> str:
    """A decimal with 6 places as a whole number of millionths."""
    return f"CAST(CAST({expr} AS DECIMAL(32,6)) * 1000000 AS HUGEINT)"


def half_up(numerator: str, denominator: str) -> str:
    """Whole-number quotient of two non-negative whole numbers, rounded half up."""
    return f"((2 * ({numerator}) + ({denominator})) // (2 * ({denominator})))"


def two_places(cents: str) -> str:
    return f"CAST(CAST({cents} AS DECIMAL(36,0)) / 100 AS DECIMAL(38,2))"


cte(
    "arrivals",
    f"""
    SELECT event_id * 2 + copy AS seq, 't' || (user_id % 3) AS tenant_id, event_type AS metric,
           'cus_' || user_id AS customer_ref, CAST(NULL AS VARCHAR) AS resource_id,
           CAST(CASE WHEN event_id % 50 = 7 THEN -1 ELSE value END AS DECIMAL(20,6)) AS quantity, ts, props AS meta,
           CAST(NULL AS VARCHAR) AS idempotency_key,
           CASE WHEN event_id % 50 = 9 THEN 'bogus' END AS source,
           ts + to_hours(CAST(event_id % 97 + CASE WHEN event_id % 211 = 0 THEN 240 ELSE 0 END + copy AS INTEGER))
               AS inserted_at,
           CAST(ts + to_hours(CAST(event_id % 97 + CASE WHEN event_id % 211 = 0 THEN 240 ELSE 0 END + copy
               AS INTEGER)) AS DATE) AS batch_id
    FROM events, (VALUES (0), (1)) AS c(copy) WHERE copy = 0 OR event_id % 10 = 0
    """,
)
cte(
    "keyed",
    f"""
    SELECT * EXCLUDE (idempotency_key, source), {event_key()} AS idempotency_key,
           coalesce(source, 'http') AS source,
           CASE WHEN quantity <= 0 THEN 'quantity: must be positive'
                WHEN source = 'bogus' THEN 'source: unknown value'
                WHEN ts > TIMESTAMP '{tables.NOW}' + INTERVAL 1 HOUR THEN 'Event timestamp too far in the future'
           END AS error
    FROM arrivals
    """,
)
cte(
    "results",
    """
    SELECT seq, tenant_id, metric, idempotency_key, error,
           CASE WHEN error IS NOT NULL THEN 'error'
                WHEN row_number() OVER (PARTITION BY idempotency_key, error IS NULL ORDER BY inserted_at, seq) = 1
                THEN 'accepted' ELSE 'duplicate' END AS status
    FROM keyed
    """,
)
cte(
    "ledger",
    """
    SELECT k.* EXCLUDE (error), CAST(date_trunc('month', ts) AS DATE) AS period_start
    FROM keyed k JOIN (SELECT seq FROM results WHERE status = 'accepted') USING (seq)
    """,
)
_FOLD = """
    SELECT tenant_id, metric, customer_ref, period_start, last_day(period_start) AS period_end,
           CAST(sum(quantity) AS DECIMAL(38,6)) AS agg_sum, CAST(max(quantity) AS DECIMAL(20,6)) AS agg_max,
           CAST(arg_max(quantity, (ts, quantity)) AS DECIMAL(20,6)) AS agg_last, max(ts) AS watermark_ts
    FROM {source} GROUP BY ALL
"""
cte("counters", _FOLD.format(source="ledger"))
cte(
    "plain",
    """
    SELECT event_id AS seq, 't' || (user_id % 3) AS tenant_id, event_type AS metric, 'cus_' || user_id AS customer_ref,
           CAST(value AS DECIMAL(20,6)) AS quantity, ts, 'ev' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS idempotency_key,
           CAST(date_trunc('month', ts) AS DATE) AS period_start,
           ts + to_hours(CAST(event_id % 97 + CASE WHEN event_id % 211 = 0 THEN 240 ELSE 0 END AS INTEGER)) AS inserted_at,
           CAST(ts + to_hours(CAST(event_id % 97 + CASE WHEN event_id % 211 = 0 THEN 240 ELSE 0 END AS INTEGER)) AS DATE) AS batch_id
    FROM events
    """,
)
cte(
    "marks",
    """
    SELECT tenant_id, metric, customer_ref, period_start, batch_id,
           max(newest) OVER (PARTITION BY tenant_id, metric, customer_ref, period_start ORDER BY batch_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_watermark
    FROM (SELECT tenant_id, metric, customer_ref, period_start, batch_id, max(ts) AS newest FROM plain GROUP BY ALL)
    """,
)
cte(
    "classified",
    """
    SELECT p.*, prior_watermark,
           CASE WHEN prior_watermark IS NULL THEN 'first'
                WHEN ts < prior_watermark - INTERVAL 48 HOUR THEN 'very_late' ELSE 'accepted' END AS lateness_class
    FROM plain p JOIN marks USING (tenant_id, metric, customer_ref, period_start, batch_id)
    """,
)
cte(
    "shipments",
    """
    SELECT r_name AS tenant_id, l_returnflag AS metric, n_name AS customer_ref,
           CAST(l_quantity AS DECIMAL(20,6)) AS quantity, l_shipdate AS ts,
           concat_ws(':', 'li', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS idempotency_key,
           CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start
    FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    """,
)
cte("ship_counters", _FOLD.format(source="shipments"))

_MAPPING_COLUMNS = (
    "id, tenant_id, metric, aggregation, stripe_account, price_id, subscription_item_id, currency, active, shadow, "
    "shadow_stripe_account, shadow_price_id, shadow_subscription_item_id"
)
cte("mappings", values(_MAPPING_COLUMNS, tables.mapping_rows(tables.EVENT_TENANTS, tables.EVENT_METRICS)))
cte("ship_mappings", values(_MAPPING_COLUMNS, tables.mapping_rows(tables.REGIONS, tables.FLAGS)))


def tier_rows(prices: dict[str, tuple]) -> list[tuple]:
    """(metric, position, lower, upper, unit price, flat price) of every tier; no upper bound is null."""
    rows = []
    for metric, (_, tiers, *_rest) in prices.items():
        low = "0"
        for i, (up_to, unit, flat) in enumerate(tiers or []):
            bound = None if up_to in (None, "0") else up_to
            rows.append((metric, i + 1, low, bound, unit, flat or "0"))
            low = bound
    return rows


def _typed_tiers(rows: list[tuple], first: str = "metric") -> str:
    return f"""
    SELECT {first}, pos, CAST(low AS DECIMAL(20,6)) AS low, CAST(high AS DECIMAL(20,6)) AS high,
           CAST(unit_price AS DECIMAL(13,6)) AS unit_price, CAST(flat_price AS DECIMAL(13,6)) AS flat_price
    FROM ({values(first + ", pos, low, high, unit_price, flat_price", rows)})
    """


def _typed_prices(rows: list[tuple], first: str = "metric") -> str:
    return f"""
    SELECT {first}, model, CAST(unit_price AS DECIMAL(13,6)) AS unit_price,
           CAST(package_size AS DECIMAL(20,6)) AS package_size, CAST(low_charge AS DECIMAL(20,6)) AS low_charge,
           CAST(high_charge AS DECIMAL(20,6)) AS high_charge
    FROM ({values(first + ", model, unit_price, package_size, low_charge, high_charge", rows)})
    """


def price_rows(prices: dict[str, tuple]) -> list[tuple]:
    return [(m, p[0], p[2], p[3], p[4], p[5]) for m, p in prices.items()]


cte("tier_table", _typed_tiers(tier_rows(tables.PRICES)))
cte("price_table", _typed_prices(price_rows(tables.PRICES)))
cte(
    "option_tiers",
    _typed_tiers(
        [(o, *row) for o, prices in tables.OPTIONS.items() for row in tier_rows(prices)], "option, metric"
    ),
)
cte(
    "option_prices",
    _typed_prices(
        [(o, *row) for o, prices in tables.OPTIONS.items() for row in price_rows(prices)], "option, metric"
    ),
)


def rated(usage: str, keys: str, tier_table: str = "tier_table", price_table: str = "price_table", on: str = "metric") -> str:
    """Query text that rates rows (keys, quantity): adds subtotal and unit_price.

    ``keys`` lists the columns that identify a usage row, with the join columns ``on``. Tiers are joined as
    rows and summed by grouping; quotients are whole-number divisions, so nothing passes through a float.
    """
    names = [c.strip() for c in keys.split(",")]
    mine = ", ".join(f"u.{c}" for c in names)
    same = " AND ".join(f"x.{c} = u.{c}" for c in names)
    share = two_places(
        half_up(
            "CAST(round(CASE p.model WHEN 'tiered' THEN x.tiered ELSE x.graduated END, 2) * 100 AS HUGEINT) * 1000000",
            micros("u.quantity"),
        )
    )
    return f"""
    SELECT {keys}, quantity,
           CAST(CASE WHEN high_charge <> 0 AND raised > high_charge THEN high_charge ELSE raised END AS DECIMAL(24,6)) AS subtotal,
           CAST(unit_price AS DECIMAL(38,2)) AS unit_price
    FROM (SELECT *, CASE WHEN low_charge <> 0 AND total < low_charge THEN low_charge ELSE total END AS raised FROM (
        SELECT {mine}, u.quantity, p.low_charge, p.high_charge,
          CAST(CASE p.model WHEN 'flat' THEN round(CAST(u.quantity AS DECIMAL(24,6)) * p.unit_price, 2)
               WHEN 'package' THEN round(CAST(ceil(u.quantity / p.package_size) AS DECIMAL(18,0)) * p.unit_price, 2)
               WHEN 'volume' THEN round(CAST(u.quantity AS DECIMAL(24,6)) * x.volume_price, 2)
               WHEN 'tiered' THEN round(x.tiered, 2) ELSE round(x.graduated, 2) END AS DECIMAL(30,2)) AS total,
          CAST(CASE WHEN p.model IN ('flat', 'package') THEN round(p.unit_price, 2)
               WHEN p.model = 'volume' THEN round(x.volume_price, 2)
               WHEN u.quantity <= 0 THEN 0 ELSE {share} END AS DECIMAL(30,2)) AS unit_price
        FROM ({usage}) u JOIN {price_table} p USING ({on})
        LEFT JOIN (
          SELECT {keys}, sum(units * unit_price) AS tiered,
                 sum(units * unit_price + CASE WHEN units > 0 THEN flat_price ELSE 0 END) AS graduated,
                 coalesce(arg_min(unit_price, pos) FILTER (WHERE high IS NULL OR quantity <= high),
                          arg_max(unit_price, pos)) AS volume_price
          FROM (SELECT {mine}, u.quantity, t.pos, t.high, t.unit_price, t.flat_price,
                       CAST(greatest(0, least(u.quantity, coalesce(t.high, u.quantity)) - t.low) AS DECIMAL(24,6)) AS units
                FROM ({usage}) u JOIN {tier_table} t USING ({on}))
          GROUP BY ALL) x ON {same}))
    """
