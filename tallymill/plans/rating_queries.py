"""Prices, invoices, studies, grants."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tallymill.functions import money, period
from tallymill.operators import counters as C
from tallymill.operators import rating, whatif
from tallymill.plans import tables as T
from tallymill.plans.oracle import cte, half_up, micros, rated, sql, two_places, values
from tallymill.plans.registry import query
from tallymill.schemas import MONEY, PRICE_CONFIG, QTY, RATED_QTY, SUM

CUSTOMER = ["tenant_id", "customer_ref"]
_INV = "tenant_id, customer_ref, period_start"

cte(
    "usage_events",
    """
    SELECT tenant_id, customer_ref, metric, CAST(sum(quantity) AS DECIMAL(24,6)) AS quantity FROM plain GROUP BY ALL
    """,
)
cte("rated_events", rated("SELECT * FROM usage_events", "tenant_id, customer_ref, metric"))
cte(
    "ship_usage",
    """
    SELECT c.tenant_id, customer_ref, period_start, period_end, metric,
           CAST(CASE aggregation WHEN 'max' THEN agg_max WHEN 'last' THEN agg_last ELSE agg_sum END AS DECIMAL(24,6)) AS quantity
    FROM ship_counters c JOIN ship_mappings m USING (tenant_id, metric) WHERE active
    """,
)
cte("rated_ships", rated("SELECT * FROM ship_usage", "tenant_id, customer_ref, period_start, period_end, metric"))


def event_usage(spark, folder):
    """Quantity per customer and metric over all events."""
    return T.plain_events(spark, folder).groupBy(*CUSTOMER, "metric").agg(F.sum("quantity").cast(RATED_QTY).alias("quantity"))


def shipment_usage(spark, folder):
    """Billable quantity per customer, month and metric."""
    counted = C.build_counters(T.shipments(spark, folder))
    return rating.billable_usage(counted, T.shipment_mappings(spark)).select(
        *rating.INVOICE, "period_end", "metric", F.col("quantity").cast(RATED_QTY).alias("quantity")
    )


def _register_model(metric: str, model: str, total) -> None:
    @query(
        f"rate_{model}",
        sql(
            f"""
            SELECT tenant_id, customer_ref, metric, quantity, CAST(CASE '{model}'
                WHEN 'flat' THEN round(quantity * p.unit_price, 2)
                WHEN 'package' THEN round(CAST(ceil(quantity / p.package_size) AS DECIMAL(18,0)) * p.unit_price, 2)
                ELSE t.total END AS DECIMAL(38,2)) AS total
            FROM usage_events u CROSS JOIN (SELECT * EXCLUDE (metric) FROM price_table WHERE metric = '{metric}') p LEFT JOIN (
              SELECT tenant_id, customer_ref, metric, round(CASE '{model}' WHEN 'volume' THEN
                       max(quantity) * coalesce(arg_min(unit_price, pos) FILTER (WHERE high IS NULL OR quantity <= high),
                                                arg_max(unit_price, pos))
                     ELSE sum(units * unit_price + CASE WHEN '{model}' = 'graduated' AND units > 0 THEN flat_price ELSE 0 END) END, 2) AS total
              FROM (SELECT u.*, t.*,
                      CAST(greatest(0, least(quantity, coalesce(high, quantity)) - low) AS DECIMAL(24,6)) AS units
                    FROM usage_events u CROSS JOIN (SELECT * EXCLUDE (metric) FROM tier_table WHERE metric = '{metric}') t)
              GROUP BY ALL) t USING (tenant_id, customer_ref, metric)
            """
        ),
    )
    def rate(spark, folder):
        """All usage rows under the model's one price."""
        price = T.price_configs(spark).filter(F.col("metric") == metric).select("price_config").scalar()
        rows = event_usage(spark, folder).withColumn("price_config", price)
        return rows.select(*CUSTOMER, "metric", "quantity", total(F.col("quantity"), F.col("price_config")).alias("total"))


_register_model("click", "tiered", lambda q, p: money.tiered_total(q, p["tiers"]))
_register_model("view", "volume", lambda q, p: money.volume_total(q, p["tiers"]))
_register_model("purchase", "graduated", lambda q, p: money.graduated_total(q, p["tiers"]))
_register_model("error", "flat", lambda q, p: money.flat_total(q, p["unit_price"]))
_register_model("signup", "package", lambda q, p: money.package_total(q, p["package_size"], p["unit_price"]))


@query(
    "tier_breakdown",
    sql(
        """
        SELECT tenant_id, customer_ref, metric, CAST(pos AS INTEGER) AS tier, units, unit_price,
               CAST(CASE model WHEN 'graduated' THEN flat_price ELSE 0 END AS DECIMAL(13,6)) AS flat_fee,
               CAST(round(units * unit_price + CASE model WHEN 'graduated' THEN flat_price ELSE 0 END, 2) AS DECIMAL(38,2)) AS subtotal
        FROM (SELECT u.*, t.* EXCLUDE (metric), p.model,
                CAST(greatest(0, least(quantity, coalesce(high, quantity)) - low) AS DECIMAL(24,6)) AS units
              FROM usage_events u JOIN tier_table t USING (metric) JOIN price_table p USING (metric)
              WHERE model IN ('tiered', 'graduated'))
        WHERE units > 0
        """
    ),
)
def tier_breakdown(spark, folder):
    return rating.tier_breakdown(rating.priced(event_usage(spark, folder), T.price_configs(spark)))


@query("line_items", sql("SELECT * FROM rated_events"))
def line_items(spark, folder):
    rows = rating.priced(event_usage(spark, folder), T.price_configs(spark))
    return rating.rate_lines(rows).drop("price_config")


@query(
    "projection",
    sql(
        f"""
        SELECT {_INV}, period_end, CAST(sum(subtotal) AS DECIMAL(38,2)) AS projected, count(*) AS n_lines
        FROM rated_ships GROUP BY ALL
        """
    ),
)
def projection(spark, folder):
    counted = C.build_counters(T.shipments(spark, folder))
    lines = rating.projection(counted, T.shipment_mappings(spark), T.price_configs(spark, T.FLAGS))
    return lines.groupBy(*rating.INVOICE, "period_end").agg(
        F.sum("subtotal").cast(MONEY).alias("projected"), F.count("*").alias("n_lines")
    )


# Commitments and credits: one of each per customer row, owned by the customer's nation.
cte(
    "commitments",
    """
    SELECT c_custkey AS position, r_name AS tenant_id, n_name AS customer_ref,
           CAST(CAST(c_acctbal AS DECIMAL(20,6)) * CAST(0.001 AS DECIMAL(6,3)) AS DECIMAL(24,6)) AS amount,
           CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END AS DECIMAL(24,6)) AS applied,
           DATE '1995-01-15' + CAST((c_custkey * 37) % 2200 AS INTEGER) AS start_date,
           DATE '1995-01-15' + CAST((c_custkey * 37) % 2200 + 200 AS INTEGER) AS end_date
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    """,
)
cte(
    "credit_rows",
    """
    SELECT r_name AS tenant_id, n_name AS customer_ref,
           CAST(CAST(c_acctbal AS DECIMAL(20,6)) * CAST(0.0001 AS DECIMAL(6,4)) AS DECIMAL(24,6)) AS amount,
           CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE DATE '1995-01-15' + CAST((c_custkey * 53) % 2400 AS INTEGER) END AS expires_on
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    """,
)


def commitments(spark, folder):
    k = F.col("c_custkey")
    start = F.date_add(F.lit("1995-01-15").cast("date"), ((k * 37) % 2200).cast("int"))
    return T.owners(spark, folder).select(
        k.alias("position"),
        *CUSTOMER,
        (F.col("c_acctbal").cast(QTY) * F.lit("0.001").cast("decimal(6,3)")).cast(RATED_QTY).alias("amount"),
        F.when(k % 3 == 0, 2).otherwise(0).cast(RATED_QTY).alias("applied"),
        start.alias("start_date"),
        F.date_add(start, 200).alias("end_date"),
    )


def credits(spark, folder):
    k = F.col("c_custkey")
    return T.owners(spark, folder).select(
        *CUSTOMER,
        (F.col("c_acctbal").cast(QTY) * F.lit("0.0001").cast("decimal(6,4)")).cast(RATED_QTY).alias("amount"),
        F.when(k % 4 != 0, F.date_add(F.lit("1995-01-15").cast("date"), ((k * 53) % 2400).cast("int"))).alias("expires_on"),
    )


cte(
    "active_commitments",
    f"""
    SELECT {_INV}, position, amount, applied,
           row_number() OVER (PARTITION BY {_INV} ORDER BY position) AS step
    FROM (SELECT DISTINCT {_INV}, period_end FROM ship_usage) p JOIN commitments c USING (tenant_id, customer_ref)
    WHERE start_date <= period_end AND end_date >= period_start
    """,
)
cte(
    "invoice_base",
    f"SELECT {_INV}, period_end, CAST(sum(subtotal) AS DECIMAL(30,6)) AS subtotal, count(*) AS n_lines FROM rated_ships GROUP BY ALL",
)
# commitments taken one after the other
cte(
    "taken",
    f"""
    SELECT {_INV}, CAST(0 AS BIGINT) AS step, CAST(subtotal AS DECIMAL(30,6)) AS rest FROM invoice_base
    UNION ALL
    SELECT t.tenant_id, t.customer_ref, t.period_start, a.step,
           CAST(t.rest - least(a.amount - a.applied, t.rest) AS DECIMAL(30,6)) AS rest
    FROM taken t JOIN active_commitments a ON a.tenant_id = t.tenant_id AND a.customer_ref = t.customer_ref
         AND a.period_start = t.period_start AND a.step = t.step + 1
    """,
)
cte("rest_after", f"SELECT {_INV}, arg_max(rest, step) AS rest FROM taken GROUP BY ALL")
cte(
    "credit_sums",
    f"""
    SELECT {_INV}, CAST(sum(amount) AS DECIMAL(30,6)) AS credit_amount
    FROM invoice_base JOIN credit_rows USING (tenant_id, customer_ref)
    WHERE expires_on IS NULL OR expires_on >= period_end GROUP BY ALL
    """,
)


@query(
    "commitment_overlap",
    sql(f"SELECT {_INV}, count(*) AS n_active, CAST(sum(amount - applied) AS DECIMAL(38,6)) AS available FROM active_commitments GROUP BY ALL"),
)
def commitment_overlap(spark, folder):
    periods = shipment_usage(spark, folder).select(*rating.INVOICE, "period_end").distinct()
    active = rating.active_commitments(commitments(spark, folder), periods, CUSTOMER)
    return active.groupBy(*rating.INVOICE).agg(
        F.count("*").alias("n_active"), F.sum(F.col("amount") - F.col("applied")).cast(SUM).alias("available")
    )


@query(
    "commitment_overlap_open",
    sql(
        f"""
        SELECT {_INV}, count(*) AS n_active, CAST(sum(amount - applied) AS DECIMAL(38,6)) AS available
        FROM (SELECT DISTINCT {_INV}, period_end FROM ship_usage) p JOIN (
          SELECT * EXCLUDE (end_date), CASE WHEN position % 2 = 0 THEN DATE '9999-12-31' ELSE end_date END AS end_date FROM commitments
        ) c USING (tenant_id, customer_ref)
        WHERE start_date <= period_end AND end_date >= period_start GROUP BY ALL
        """
    ),
)
def commitment_overlap_open(spark, folder):
    """The same where every other commitment has no end."""
    periods = shipment_usage(spark, folder).select(*rating.INVOICE, "period_end").distinct()
    end = F.when(F.col("position") % 2 == 0, F.lit("9999-12-31").cast("date")).otherwise(F.col("end_date"))
    active = rating.active_commitments(commitments(spark, folder).withColumn("end_date", end), periods, CUSTOMER)
    return active.groupBy(*rating.INVOICE).agg(
        F.count("*").alias("n_active"), F.sum(F.col("amount") - F.col("applied")).cast(SUM).alias("available")
    )


@query(
    "commitment_credit",
    sql(f"SELECT {_INV}, CAST(subtotal - rest AS DECIMAL(38,6)) AS commitment_credit FROM invoice_base JOIN rest_after USING ({_INV})"),
)
def commitment_credit(spark, folder):
    lines = rating.rate_lines(rating.priced(shipment_usage(spark, folder), T.price_configs(spark, T.FLAGS)))
    heads = lines.groupBy(*rating.INVOICE, "period_end").agg(F.sum("subtotal").cast(SUM).alias("subtotal"))
    active = rating.active_commitments(commitments(spark, folder), heads.drop("subtotal"), CUSTOMER)
    return rating.commitment_credit(heads, active, rating.INVOICE).select(*rating.INVOICE, "commitment_credit")


@query("credits_valid", sql(f"SELECT {_INV}, CAST(credit_amount AS DECIMAL(38,6)) AS credit_amount FROM credit_sums"))
def credits_valid(spark, folder):
    periods = shipment_usage(spark, folder).select(*rating.INVOICE, "period_end").distinct()
    return rating.valid_credits(credits(spark, folder), periods, CUSTOMER)


@query(
    "invoices",
    sql(
        f"""
        SELECT {_INV}, period_end, n_lines, 'USD' AS currency, CAST(round(subtotal, 2) AS DECIMAL(38,2)) AS subtotal,
               CAST(round(credit_amount + used, 2) AS DECIMAL(38,2)) AS credits, CAST(0 AS DECIMAL(38,2)) AS adjustments,
               CAST(round(taxable * CAST(0.0825 AS DECIMAL(5,4)), 2) AS DECIMAL(38,2)) AS tax,
               CAST(round(taxable + taxable * CAST(0.0825 AS DECIMAL(5,4)), 2) AS DECIMAL(38,2)) AS total
        FROM (SELECT *, CAST(greatest(0, subtotal - used - credit_amount) AS DECIMAL(28,6)) AS taxable
              FROM (SELECT b.*, subtotal - rest AS used, coalesce(credit_amount, 0) AS credit_amount
                    FROM invoice_base b JOIN rest_after USING ({_INV}) LEFT JOIN credit_sums USING ({_INV})))
        """
    ),
)
def invoices(spark, folder):
    """Monthly invoices of all customers with commitments, credits and 8.25 % tax."""
    lines = rating.rate_lines(rating.priced(shipment_usage(spark, folder), T.price_configs(spark, T.FLAGS)))
    return rating.invoices(
        lines.withColumn("position", F.ascii("metric")), commitments(spark, folder), credits(spark, folder), 8.25
    )


_PRORATED = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DECIMAL(20,6)) AS amount,
           l_shipdate AS start_at, l_shipdate + to_hours(CAST(l_partkey % 900 AS INTEGER)) AS end_at,
           CAST(date_trunc('month', l_shipdate) AS DATE) AS p_start, last_day(CAST(l_shipdate AS DATE)) AS p_end
    FROM lineitem
"""


@query(
    "proration",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           least(1.0, CAST(greatest(0, epoch_ms(least(end_at, p_end + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND)) - epoch_ms(start_at)) AS DOUBLE)
             / CAST(epoch_ms(p_end + INTERVAL 1 DAY) - 1 - epoch_ms(CAST(p_start AS TIMESTAMP)) AS DOUBLE)) AS factor,
           {two_places(half_up(
               "CAST(amount * 100 AS HUGEINT) * CAST(greatest(0, epoch_ms(least(end_at, CAST(p_end AS TIMESTAMP))) - epoch_ms(start_at)) AS HUGEINT)",
               "CAST(epoch_ms(CAST(p_end AS TIMESTAMP)) - epoch_ms(CAST(p_start AS TIMESTAMP)) AS HUGEINT)"))} AS prorated
    FROM ({_PRORATED})
    """,
)
def proration(spark, folder):
    """Line amounts prorated over the month of shipment, by both period-end rules."""
    rows = T.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_extendedprice").cast(QTY).alias("amount"),
        F.col("l_shipdate").alias("start_at"),
        (F.col("l_shipdate") + period.hours((F.col("l_partkey") % 900).cast("int"))).alias("end_at"),
        F.trunc("l_shipdate", "MM").alias("p_start"),
        F.last_day("l_shipdate").alias("p_end"),
    )
    span = [F.col(c) for c in ("start_at", "end_at", "p_start", "p_end")]
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        period.proration_factor(*span).alias("factor"),
        period.prorate(F.col("amount"), *span).alias("prorated"),
    )


# ---- studies ----------------------------------------------------------------

_OPTIONS = ", ".join(f"('{o}')" for o in T.OPTIONS)
cte(
    "option_usage",
    f"SELECT u.*, option FROM ship_usage u, (VALUES {_OPTIONS}) AS o(option)",
)
_BY_OPTION = "option, tenant_id, customer_ref, period_start, metric"
cte(
    "option_rated",
    rated("SELECT * FROM option_usage", _BY_OPTION, "option_tiers", "option_prices", "option, metric"),
)


@query(
    "compare_options",
    sql(
        """
        SELECT option, metric, count(*) AS n_lines, CAST(sum(subtotal) AS DECIMAL(38,2)) AS revenue,
               CAST(max(subtotal) AS DECIMAL(38,2)) AS largest FROM option_rated GROUP BY ALL
        """
    ),
)
def compare_options(spark, folder):
    rated_rows = whatif.compare_options(shipment_usage(spark, folder), T.pricing_options(spark))
    return rated_rows.groupBy("option", "metric").agg(
        F.count("*").alias("n_lines"),
        F.sum("subtotal").cast(MONEY).alias("revenue"),
        F.max("subtotal").cast(MONEY).alias("largest"),
    )


@query(
    "pricing_study",
    sql(
        """
        SELECT option, segment, CAST(sum(subtotal) AS DECIMAL(38,2)) AS revenue, count(*) AS customers
        FROM (SELECT *, CASE WHEN quantity <= 50 THEN 'small' WHEN quantity <= 500 THEN 'medium' ELSE 'large' END AS segment
              FROM option_rated) GROUP BY GROUPING SETS ((option, segment), (option))
        """
    ),
)
def pricing_study(spark, folder):
    patterns = shipment_usage(spark, folder).select(
        whatif.segment_of(F.col("quantity"), [("small", 50), ("medium", 500)], "large").alias("segment"),
        "metric",
        "quantity",
        F.lit(1).alias("customers"),
    )
    return whatif.pricing_study(patterns, T.pricing_options(spark))


@query(
    "customer_impact",
    sql(
        """
        SELECT tenant_id, customer_ref, CAST(sum(subtotal) FILTER (WHERE option = 'current') AS DECIMAL(38,2)) AS old_total,
               CAST(sum(subtotal) FILTER (WHERE option = 'option_b') AS DECIMAL(38,2)) AS new_total,
               CAST(sum(CASE option WHEN 'option_b' THEN subtotal WHEN 'current' THEN -subtotal ELSE 0 END) AS DECIMAL(38,2)) AS change
        FROM option_rated GROUP BY ALL
        """
    ),
)
def customer_impact(spark, folder):
    options = T.pricing_options(spark)
    pick = lambda o: options.filter(F.col("option") == o).drop("option")
    return whatif.customer_impact(shipment_usage(spark, folder), pick("current"), pick("option_b"))


cte(
    "probes",
    f"""
    SELECT DISTINCT metric, CAST(probe AS DECIMAL(24,6)) AS quantity, option FROM (
      SELECT metric, unnest([0, quantity, ceil(quantity), ceil(quantity) + 1, quantity - CAST(0.01 AS DECIMAL(24,6)), quantity * 10000]) AS probe
      FROM ship_usage), (VALUES {_OPTIONS}) AS o(option) WHERE probe >= 0
    """,
)
cte("probes_rated", rated("SELECT * EXCLUDE (quantity), quantity, quantity AS probe FROM probes", "option, metric, probe", "option_tiers", "option_prices", "option, metric"))


@query("quantity_sweep", sql("SELECT option, metric, quantity, subtotal, unit_price FROM probes_rated"))
def quantity_sweep(spark, folder):
    probes = whatif.quantity_edges(shipment_usage(spark, folder))
    return whatif.compare_options(probes, T.pricing_options(spark)).select(
        "option", "metric", "quantity", "subtotal", "unit_price"
    )


@query(
    "price_monotonicity",
    sql(
        """
        SELECT * FROM (
          SELECT option, metric, quantity, subtotal, lag(quantity) OVER w AS previous_quantity, lag(subtotal) OVER w AS previous_subtotal
          FROM probes_rated WINDOW w AS (PARTITION BY option, metric ORDER BY quantity))
        WHERE subtotal < previous_subtotal
        """
    ),
)
def price_monotonicity(spark, folder):
    """Quantities that cost less than the next smaller one, over all probed quantities."""
    probes = whatif.quantity_edges(shipment_usage(spark, folder))
    return whatif.price_drops(whatif.compare_options(probes, T.pricing_options(spark)))


# ---- plans with allowances --------------------------------------------------

# plan -> (base price, metric -> (included, overage price tuple))
PLANS = {
    "starter": ("0", {"A": ("40", "0.02"), "N": ("10", "0.10"), "R": ("10", "0.05")}),
    "pro": ("29", {"A": ("120", "0.01"), "N": ("25", "0.08"), "R": ("20", "0.04")}),
    "enterprise": ("299", {"A": ("400", None), "N": ("40", None), "R": ("40", "0.02")}),
}
ENTERPRISE_TIERS = [("500", "0.008", None), ("1000", "0.006", None), (None, "0.004", None)]


def _plan_prices() -> dict[str, dict[str, tuple]]:
    return {
        plan: {
            m: (("flat", None, rate, None, None, None) if rate else ("tiered", ENTERPRISE_TIERS, None, None, None, None))
            for m, (_, rate) in allowed.items()
        }
        for plan, (_, allowed) in PLANS.items()
    }


def _plan_of(spark, folder):
    usage = shipment_usage(spark, folder)
    size = F.length("customer_ref") + F.month("period_start")
    return usage.withColumn(
        "plan", F.when(size % 3 == 0, "starter").when(size % 3 == 1, "pro").otherwise("enterprise")
    )


def _plan_tables():
    from tallymill.plans.oracle import _typed_prices, _typed_tiers, price_rows, tier_rows

    prices = _plan_prices()
    tiers = [(plan, *row) for plan, p in prices.items() for row in tier_rows(p)]
    rows = [(plan, *row) for plan, p in prices.items() for row in price_rows(p)]
    cte("plan_tiers", _typed_tiers(tiers, "plan, metric"))
    cte("plan_prices", _typed_prices(rows, "plan, metric"))
    cte(
        "allowances",
        values("plan, metric, included, base", [(p, m, inc, base) for p, (base, a) in PLANS.items() for m, (inc, _) in a.items()]),
    )


_plan_tables()
cte(
    "plan_usage",
    """
    SELECT tenant_id, customer_ref, period_start, metric, plan,
           CAST(greatest(0, quantity - CAST(included AS DECIMAL(24,6))) AS DECIMAL(24,6)) AS quantity, base
    FROM (SELECT *, CASE (length(customer_ref) + month(period_start)) % 3 WHEN 0 THEN 'starter' WHEN 1 THEN 'pro' ELSE 'enterprise' END AS plan
          FROM ship_usage) JOIN allowances USING (plan, metric)
    """,
)
cte("plan_rated", rated("SELECT * FROM plan_usage", "plan, tenant_id, customer_ref, period_start, metric", "plan_tiers", "plan_prices", "plan, metric"))


@query(
    "plan_overage",
    sql(
        f"""
        SELECT {_INV}, plan, CAST(sum(subtotal) AS DECIMAL(38,2)) AS overage_charge, CAST(sum(quantity) AS DECIMAL(38,6)) AS overage_units,
               CAST(max(base) AS DECIMAL(38,2)) AS base_price, CAST(sum(subtotal) + CAST(max(base) AS DECIMAL(38,2)) AS DECIMAL(38,2)) AS total
        FROM plan_rated JOIN (SELECT DISTINCT plan, base FROM allowances) USING (plan) GROUP BY ALL
        """
    ),
)
def plan_overage(spark, folder):
    rows = [
        (plan, m, inc, T.price_struct(_plan_prices()[plan][m])) for plan, (_, a) in PLANS.items() for m, (inc, _) in a.items()
    ]
    allowances = T.frame(spark, rows, f"plan string, metric string, included {RATED_QTY}, price_config {PRICE_CONFIG}")
    base = T.frame(spark, [(p, b) for p, (b, _) in PLANS.items()], f"plan string, base_price {MONEY}")
    return whatif.rate_plans(_plan_of(spark, folder), allowances, base)


@query(
    "running_overage",
    sql(
        """
        SELECT *, CAST(greatest(0, running_usage - 25) AS DECIMAL(38,6)) AS running_overage FROM (
          SELECT tenant_id, metric, customer_ref, period_start, day, quantity,
                 CAST(sum(quantity) OVER (PARTITION BY tenant_id, metric, customer_ref, period_start ORDER BY day) AS DECIMAL(38,6)) AS running_usage
          FROM (SELECT tenant_id, metric, customer_ref, period_start, CAST(ts AS DATE) AS day, CAST(sum(quantity) AS DECIMAL(38,6)) AS quantity
                FROM plain GROUP BY ALL))
        """
    ),
)
def running_overage(spark, folder):
    daily = (
        T.plain_events(spark, folder)
        .groupBy("tenant_id", "metric", "customer_ref", "period_start", F.to_date("ts").alias("day"))
        .agg(F.sum("quantity").cast(SUM).alias("quantity"))
    )
    return whatif.running_overage(daily, F.lit(25))


_CADENCE = """
    SELECT tenant_id, customer_ref, CAST(sum(quantity) AS DECIMAL(24,6)) AS used, 20 + u % 11 AS days, 5 + u % 9 AS upgrade_day,
           u % 30 AS addon_day, 2900 AS base_before, 5900 AS base_after, 19900 AS addon, 60 AS included, 1 AS overage_cents
    FROM (SELECT *, CAST(substr(customer_ref, 5) AS INTEGER) AS u FROM plain) GROUP BY ALL
"""


@query(
    "mixed_cadence",
    sql(
        f"""
        SELECT tenant_id, customer_ref, days_before, days_after, addon_days, CAST(metered AS DECIMAL(38,6)) AS metered_cents,
               CAST({half_up(
                   "CAST((base_before * days_before + base_after * days_after) * 365 + addon * addon_days * days AS HUGEINT) * 1000000 + "
                   + micros("metered") + " * days * 365",
                   "CAST(days * 365 AS HUGEINT) * 1000000")} AS BIGINT) AS total_cents
        FROM (SELECT *, least(upgrade_day, days) AS days_before, days - least(upgrade_day, days) AS days_after,
                     greatest(0, days - addon_day) AS addon_days, greatest(0, used - included) * overage_cents AS metered
              FROM ({_CADENCE}))
        """
    ),
)
def mixed_cadence(spark, folder):
    """A plan change and an add-on inside a window whose days depend on the customer."""
    u = F.substring_index("customer_ref", "_", -1).cast("int")
    plans = (
        T.plain_events(spark, folder)
        .groupBy(*CUSTOMER)
        .agg(F.sum("quantity").cast(RATED_QTY).alias("used"))
        .select(
            "*",
            (u % 11 + 20).alias("days"),
            (u % 9 + 5).alias("upgrade_day"),
            (u % 30).alias("addon_day"),
            F.lit(2900).alias("base_before"),
            F.lit(5900).alias("base_after"),
            F.lit(19900).alias("addon"),
            F.lit(60).alias("included"),
            F.lit(1).alias("overage_cents"),
        )
    )
    return whatif.mixed_cadence(plans).select(
        *CUSTOMER, "days_before", "days_after", "addon_days", "metered_cents", "total_cents"
    )


# ---- credit grants ----------------------------------------------------------

cte("daily", "SELECT tenant_id, customer_ref, CAST(ts AS DATE) AS day, CAST(sum(quantity) AS DECIMAL(18,6)) AS quantity FROM plain GROUP BY ALL")
cte(
    "grant_amounts",
    """
    SELECT tenant_id, customer_ref, CAST(sum(quantity) * CAST(0.4 AS DECIMAL(2,1)) AS DECIMAL(18,6)) AS a,
           CAST(sum(quantity) * CAST(0.25 AS DECIMAL(3,2)) AS DECIMAL(18,6)) AS b FROM daily GROUP BY ALL
    """,
)
# grant a: January 1 to 15, rolls over after the 16th; grant b: January 10 to 28, expires
cte(
    "burn",
    """
    SELECT tenant_id, customer_ref, 0 AS d, a AS left_a, b AS left_b, CAST(0 AS DECIMAL(18,6)) AS burned_a,
           CAST(0 AS DECIMAL(18,6)) AS burned_b, CAST(0 AS DECIMAL(18,6)) AS rolled, CAST(0 AS DECIMAL(18,6)) AS over
    FROM grant_amounts
    UNION ALL
    SELECT tenant_id, customer_ref, d, CAST(left_a - take_a AS DECIMAL(18,6)), CAST(left_b - take_b AS DECIMAL(18,6)),
           CAST(burned_a + take_a AS DECIMAL(18,6)), CAST(burned_b + take_b AS DECIMAL(18,6)),
           CAST(CASE WHEN d = 16 THEN left_a ELSE rolled END AS DECIMAL(18,6)),
           CAST(over + use - take_a - take_b AS DECIMAL(18,6))
    FROM (
      SELECT *, CASE WHEN d <= 15 THEN least(left_a, use) WHEN d >= 17 THEN least(left_a, use - first_b) ELSE 0 END AS take_a,
             CASE WHEN d BETWEEN 10 AND 15 THEN least(left_b, use - least(left_a, use)) ELSE first_b END AS take_b
      FROM (
        SELECT r.tenant_id, r.customer_ref, r.d + 1 AS d, left_a, left_b, burned_a, burned_b, rolled, over,
               coalesce(y.quantity, 0) AS use,
               CASE WHEN r.d + 1 BETWEEN 16 AND 28 THEN least(left_b, coalesce(y.quantity, 0)) ELSE 0 END AS first_b
        FROM burn r LEFT JOIN daily y ON y.tenant_id = r.tenant_id AND y.customer_ref = r.customer_ref AND day(y.day) = r.d + 1
        WHERE r.d < 30))
    """,
)


def _grants(spark, folder):
    totals = T.plain_events(spark, folder).groupBy(*CUSTOMER).agg(F.sum("quantity").cast(SUM).alias("used"))
    d = lambda text: F.lit(text).cast("date")
    both = F.array(
        F.struct(
            F.lit("a").alias("g"), F.lit(1).alias("position"),
            (F.col("used") * F.lit("0.4").cast("decimal(2,1)")).cast("decimal(18,6)").alias("amount"),
            d("2024-01-01").alias("valid_from"), d("2024-01-15").alias("valid_to"), F.lit(True).alias("rollover"),
        ),
        F.struct(
            F.lit("b").alias("g"), F.lit(2).alias("position"),
            (F.col("used") * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(18,6)").alias("amount"),
            d("2024-01-10").alias("valid_from"), d("2024-01-28").alias("valid_to"), F.lit(False).alias("rollover"),
        ),
    )
    return totals.select(*CUSTOMER, F.explode(both).alias("x")).select(
        F.concat_ws(":", "tenant_id", "customer_ref", "x.g").alias("id"), *CUSTOMER,
        "x.position", "x.amount", "x.valid_from", "x.valid_to", "x.rollover",
    )


def _burned(spark, folder):
    daily = T.plain_events(spark, folder).groupBy(*CUSTOMER, F.to_date("ts").alias("day")).agg(
        F.sum("quantity").cast(SUM).alias("quantity")
    )
    return whatif.burn_grants(daily, _grants(spark, folder), dt.date(2024, 1, 1), 30, [dt.date(2024, 1, 16)])


@query(
    "credit_burn",
    sql(
        """
        SELECT tenant_id || ':' || customer_ref || ':' || g AS id, tenant_id, customer_ref, CAST(amount AS DECIMAL(38,6)) AS amount,
               CAST(burned AS DECIMAL(38,6)) AS burned, CAST(CASE WHEN g = 'b' THEN 0 ELSE left_over END AS DECIMAL(38,6)) AS remaining,
               CAST(CASE WHEN g = 'b' THEN left_over ELSE 0 END AS DECIMAL(38,6)) AS expired,
               CASE WHEN g = 'a' AND rolled > 0 THEN DATE '2024-01-16' WHEN g = 'a' THEN DATE '2024-01-01' ELSE DATE '2024-01-10' END AS valid_from,
               CASE WHEN g = 'a' AND rolled > 0 THEN DATE '2024-02-14' WHEN g = 'a' THEN DATE '2024-01-15' ELSE DATE '2024-01-28' END AS valid_to,
               CAST(CASE WHEN g = 'a' THEN rolled ELSE 0 END AS DECIMAL(38,6)) AS rolled
        FROM (SELECT tenant_id, customer_ref, 'a' AS g, a AS amount, burned_a AS burned, left_a AS left_over, rolled
              FROM burn JOIN grant_amounts USING (tenant_id, customer_ref) WHERE d = 30
              UNION ALL
              SELECT tenant_id, customer_ref, 'b', b, burned_b, left_b, rolled
              FROM burn JOIN grant_amounts USING (tenant_id, customer_ref) WHERE d = 30)
        """
    ),
)
def credit_burn(spark, folder):
    return whatif.grant_ledger(_burned(spark, folder), _grants(spark, folder))


@query(
    "credit_burn_totals",
    sql(
        """
        SELECT tenant_id, customer_ref, CAST(burned_a + burned_b + over AS DECIMAL(38,6)) AS usage_total,
               CAST(burned_a + burned_b AS DECIMAL(38,6)) AS burned_total, CAST(over AS DECIMAL(38,6)) AS overage_total
        FROM burn WHERE d = 30
        """
    ),
)
def credit_burn_totals(spark, folder):
    return whatif.burn_totals(_burned(spark, folder))


# ---- plan changes -----------------------------------------------------------

_CHANGES = """
    SELECT n_name AS customer_ref, TIMESTAMP '1995-03-01 06:00:00' + to_days(CAST((s_suppkey * 37) % 2400 AS INTEGER)) AS changed_at,
           'si_plan' || s_suppkey AS item
    FROM supplier JOIN nation ON n_nationkey = s_nationkey
"""


@query(
    "item_split",
    sql(
        f"""
        SELECT s.customer_ref, metric, period_start, item, CAST(sum(quantity) AS DECIMAL(38,6)) AS agg_sum, count(*) AS n_events
        FROM shipments s LEFT JOIN (
          SELECT *, lead(changed_at, 1, TIMESTAMP '2999-01-01 00:00:00') OVER (PARTITION BY customer_ref ORDER BY changed_at) AS until
          FROM (SELECT customer_ref, changed_at, max(item) AS item FROM ({_CHANGES}) GROUP BY ALL)) c
        ON c.customer_ref = s.customer_ref AND ts >= changed_at AND ts < until
        GROUP BY ALL
        """
    ),
)
def item_split(spark, folder):
    """Usage split over the items of a customer's plan timeline; each supplier marks one change of its nation."""
    nation = T.table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("customer_ref"))
    changes = T.table(spark, folder, "supplier").join(nation, "s_nationkey").select(
        "customer_ref",
        (F.lit("1995-03-01 06:00:00").cast("timestamp") + F.make_dt_interval(((F.col("s_suppkey") * 37) % 2400).cast("int"))).alias("changed_at"),
        F.concat(F.lit("si_plan"), F.col("s_suppkey").cast("string")).alias("item"),
    )
    return whatif.split_by_item(T.shipments(spark, folder), changes)
