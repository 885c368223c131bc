"""Scenario runs, comparisons, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.operators import listing, rating, scenarios as S, validate
from tallymill.plans import tables as T
from tallymill.plans.oracle import cte, sql
from tallymill.plans.rating_queries import shipment_usage
from tallymill.plans.registry import query
from tallymill.schemas import RATED_QTY

# ---- one scenario per customer and month ------------------------------------

_M = "month(period_start)"
cte(
    "scenario_heads",
    f"""
    SELECT tenant_id || ':' || customer_ref || ':' || period_start AS name, tenant_id, customer_ref, period_start,
           CAST(sum(subtotal) AS DECIMAL(30,6)) AS subtotal FROM rated_ships GROUP BY ALL
    """,
)
cte(
    "scenario_actual",
    """
    SELECT name, period_start, CAST(round(subtotal, 2) AS DECIMAL(24,6)) AS subtotal,
           CAST(round(subtotal * CAST(0.1 AS DECIMAL(2,1)), 2) AS DECIMAL(24,6)) AS tax,
           CAST(round(subtotal + subtotal * CAST(0.1 AS DECIMAL(2,1)), 2) AS DECIMAL(24,6)) AS total FROM scenario_heads
    """,
)
cte(
    "scenario_diffs",
    f"""
    SELECT name, 'total' AS field, total + 0.5 AS expected, total AS actual, 0.5 AS difference FROM scenario_actual
      WHERE {_M} % 4 = 0 AND NOT (0.5 <= 0.001 OR 0.5 / greatest(1.0, CAST(total + 0.5 AS DOUBLE)) <= 0.0005)
    UNION ALL
    SELECT name, 'subtotal', subtotal + 1, subtotal, 1 FROM scenario_actual
      WHERE {_M} % 3 = 0 AND NOT (1.0 / greatest(1.0, CAST(subtotal + 1 AS DOUBLE)) <= 0.0005)
    UNION ALL
    SELECT tenant_id || ':' || customer_ref || ':' || period_start, 'lineItem.' || metric || '.unitPrice', unit_price + 0.05, unit_price, 0.05 FROM rated_ships
      WHERE metric = 'A' AND {_M} % 6 = 0 AND NOT (0.05 / greatest(1.0, CAST(unit_price + 0.05 AS DOUBLE)) <= 0.0005)
    UNION ALL
    SELECT tenant_id || ':' || customer_ref || ':' || period_start, 'lineItem.' || metric || '.quantity', quantity + 1, quantity, 1 FROM rated_ships
      WHERE metric = 'N' AND {_M} % 7 = 0
    """,
)
cte(
    "scenario_words",
    f"""
    SELECT name, 'currency' AS field, 'EUR' AS expected, 'USD' AS actual FROM scenario_actual WHERE {_M} % 5 = 0
    UNION ALL
    SELECT name, 'lineItem.Z', '{{"metric":"Z","quantity":1.000000}}', NULL FROM scenario_actual WHERE {_M} = 12
    """,
)


def scenario_rows(spark, folder):
    """Usage of a customer and month as one scenario, with expected results that are off in some months."""
    lines = rating.rate_lines(rating.priced(shipment_usage(spark, folder), T.price_configs(spark, T.FLAGS)))
    month = F.month("period_start")
    off = lambda n, by: F.when(month % n == 0, F.lit(by).cast("decimal(3,2)")).otherwise(F.lit(0).cast("decimal(3,2)"))
    expected_line = F.struct(
        "metric",
        (F.col("quantity") + F.when((F.col("metric") == "N") & (month % 7 == 0), 1).otherwise(0)).cast("decimal(24,6)").alias("quantity"),
        (F.col("unit_price") + F.when(F.col("metric") == "A", off(6, "0.05")).otherwise(F.lit(0).cast("decimal(3,2)"))).cast("decimal(24,6)").alias("unit_price"),
        F.lit(None).cast("decimal(24,6)").alias("subtotal"),
    )
    # one row per metric and invoice, so the arrays hold as many entries as there are metrics
    heads = lines.groupBy(*rating.INVOICE, "period_end").agg(
        F.sort_array(F.collect_list(F.struct("metric", "quantity", "price_config"))).alias("usage_items"),
        F.collect_list(expected_line).alias("_lines"),
        F.sum("subtotal").cast("decimal(30,6)").alias("_sum"),
    )
    total = F.col("_sum") + F.col("_sum") * F.lit("0.1").cast("decimal(2,1)")
    extra = F.array(
        F.struct(
            F.lit("Z").alias("metric"), F.lit(1).cast("decimal(24,6)").alias("quantity"),
            F.lit(None).cast("decimal(24,6)").alias("unit_price"), F.lit(None).cast("decimal(24,6)").alias("subtotal"),
        )
    )
    expected = F.struct(
        (F.round("_sum", 2) + off(3, "1.00")).cast("decimal(24,6)").alias("subtotal"),
        F.round(F.col("_sum") * F.lit("0.1").cast("decimal(2,1)"), 2).cast("decimal(24,6)").alias("tax"),
        (F.round(total, 2) + off(4, "0.50")).cast("decimal(24,6)").alias("total"),
        F.when(month % 5 == 0, "EUR").otherwise("USD").alias("currency"),
        F.when(month == 12, F.concat("_lines", extra)).otherwise(F.col("_lines")).alias("line_items"),
    )
    return heads.select(
        F.concat_ws(":", "tenant_id", "customer_ref", "period_start").alias("name"),
        F.col("customer_ref").alias("customer_id"),
        "period_start",
        "period_end",
        "usage_items",
        F.lit(None).cast("array<struct<amount:decimal(24,6),applied:decimal(24,6),start_date:date,end_date:date>>").alias("commitments"),
        F.lit(None).cast("array<struct<amount:decimal(24,6),expires_on:date>>").alias("credits"),
        F.lit(10).cast("decimal(7,4)").alias("tax_rate"),
        expected.alias("expected"),
        F.lit(None).cast("double").alias("tol_absolute"),
        F.lit(None).cast("double").alias("tol_relative"),
    )


def compared(spark, folder):
    return S.compare(S.simulate(scenario_rows(spark, folder)))


@query(
    "scenario_invoices",
    sql("SELECT name, CAST(subtotal AS DECIMAL(38,2)) AS subtotal, CAST(tax AS DECIMAL(38,2)) AS tax, CAST(total AS DECIMAL(38,2)) AS total FROM scenario_actual"),
)
def scenario_invoices(spark, folder):
    return S.simulate(scenario_rows(spark, folder)).select("name", "invoice.subtotal", "invoice.tax", "invoice.total")


_TEXT = "regexp_replace(CAST(CAST({0} AS DECIMAL(24,6)) AS VARCHAR), '\\.?0+$', '')"
_ALL_DIFFS = f"""
    SELECT name, field, {_TEXT.format("expected")} AS expected, {_TEXT.format("actual")} AS actual, CAST(difference AS DECIMAL(38,6)) AS difference FROM scenario_diffs
    UNION ALL SELECT name, field, expected, actual, CAST(NULL AS DECIMAL(38,6)) FROM scenario_words
"""


@query(
    "scenario_compare",
    sql(f"SELECT *, field || ': expected ' || coalesce(expected, 'null') || ', got ' || coalesce(actual, 'null') AS text FROM ({_ALL_DIFFS})"),
)
def scenario_compare(spark, folder):
    return S.difference_rows(compared(spark, folder))


@query(
    "scenario_report",
    sql(
        f"""
        SELECT name, CASE WHEN count(field) = 0 THEN 'OK' ELSE 'DIFF' END AS status, CAST(count(field) AS INTEGER) AS n_diffs
        FROM scenario_actual LEFT JOIN ({_ALL_DIFFS}) USING (name) GROUP BY name
        """
    ),
)
def scenario_report(spark, folder):
    return S.report(compared(spark, folder))


@query(
    "scenario_report_totals",
    sql(
        f"""
        SELECT count(*) AS total, count(*) FILTER (WHERE n > 0) AS diffs, count(*) FILTER (WHERE n = 0) AS ok
        FROM (SELECT name, count(field) AS n FROM scenario_actual LEFT JOIN ({_ALL_DIFFS}) USING (name) GROUP BY name)
        """
    ),
)
def scenario_report_totals(spark, folder):
    return S.report_totals(compared(spark, folder))


@query(
    "scenario_check",
    sql(
        f"""
        SELECT scenario, path, message FROM (
          SELECT name AS scenario, 'inputs.usageItems.' || (row_number() OVER (PARTITION BY name ORDER BY metric) - 1) AS path, metric, {_M} AS m
          FROM (SELECT tenant_id || ':' || customer_ref || ':' || period_start AS name, metric, period_start FROM rated_ships)),
          (VALUES ('quantity must be 0 or more', 2, 'A'), ('unknown price model', 3, 'N'), ('tiers must ascend', 4, 'R')) AS v(message, broken_in, broken)
        WHERE m = broken_in AND metric = broken
        UNION ALL SELECT name, 'tolerances.relative', 'must be 0 to 1' FROM scenario_actual WHERE {_M} = 5
        UNION ALL SELECT name, 'inputs.taxRate', 'must be 0 or more' FROM scenario_actual WHERE {_M} = 6
        """
    ),
)
def scenario_check(spark, folder):
    """Scenarios with one rule broken in some months."""
    month = F.month("period_start")

    def spoil(item):
        price = item["price_config"]
        tiers = F.when((month == 4) & (item["metric"] == "R"), F.reverse(price["tiers"])).otherwise(price["tiers"])
        return item.withField(
            "quantity", F.when((month == 2) & (item["metric"] == "A"), F.lit(-1).cast(RATED_QTY)).otherwise(item["quantity"])
        ).withField(
            "price_config",
            price.withField("model", F.when((month == 3) & (item["metric"] == "N"), "stairs").otherwise(price["model"])).withField("tiers", tiers),
        )

    rows = (
        scenario_rows(spark, folder)
        .withColumn("usage_items", F.transform("usage_items", spoil))
        .withColumn("tol_relative", F.when(month == 5, 2.0))
        .withColumn("tax_rate", F.when(month == 6, F.lit(-1).cast("decimal(7,4)")).otherwise(F.col("tax_rate")))
    )
    return validate.scenario_violations(rows)


# ---- runs: one per order ----------------------------------------------------

cte(
    "runs",
    """
    SELECT 'run' || o_orderkey AS id, 'sc' || o_custkey AS scenario_id, 't' || (o_custkey % 3) AS tenant_id,
           CASE WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN CASE WHEN month(o_orderdate) < 6 THEN 'failed' ELSE 'completed' END
                WHEN year(o_orderdate) < 1998 THEN 'failed' WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'running' END AS status,
           CASE WHEN o_orderpriority LIKE '1%' THEN 'single' ELSE 'batch' END AS run_type,
           'b' || strftime(o_orderdate, '%Y-%m-%d') AS batch_id, o_orderdate AS created_at
    FROM orders
    """,
)


def runs(spark, folder):
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed")
        .when(F.col("o_orderstatus") == "O", F.when(F.month(day) < 6, "failed").otherwise("completed"))
        .when(F.year(day) < 1998, "failed")
        .when(k % 2 == 0, "pending")
        .otherwise("running")
    )
    return T.table(spark, folder, "orders").select(
        F.concat(F.lit("run"), k.cast("string")).alias("id"),
        F.concat(F.lit("sc"), F.col("o_custkey").cast("string")).alias("scenario_id"),
        F.concat(F.lit("t"), (F.col("o_custkey") % 3).cast("string")).alias("tenant_id"),
        status.alias("status"),
        F.when(F.col("o_orderpriority").startswith("1"), "single").otherwise("batch").alias("run_type"),
        F.to_json(F.struct(F.concat(F.lit("b"), F.date_format(day, "yyyy-MM-dd")).alias("batchId"))).alias("metadata"),
        day.alias("created_at"),
    )


@query(
    "batch_rollup",
    sql(
        """
        SELECT *, CASE WHEN completed + failed <> total_runs THEN 'running' WHEN failed = 0 THEN 'completed' WHEN failed = total_runs THEN 'failed' ELSE 'partial' END AS status,
               CAST(CAST((20000 * completed + total_runs) // (2 * total_runs) AS DECIMAL(20,0)) / 100 AS DECIMAL(38,2)) AS success_rate
        FROM (SELECT tenant_id, batch_id, count(*) AS total_runs, count(*) FILTER (WHERE status = 'completed') AS completed,
                     count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'pending') AS pending,
                     count(*) FILTER (WHERE status = 'running') AS running FROM runs GROUP BY ALL)
        """
    ),
)
def batch_rollup(spark, folder):
    return S.batch_rollup(runs(spark, folder))


@query("batch_runs", sql("SELECT id, status FROM runs WHERE batch_id = 'b1997-05-20'"))
def batch_runs(spark, folder):
    return S.runs_of_batch(runs(spark, folder), "b1997-05-20").select("id", "status")


_RUNS = "tenant_id = 't1' AND status = 'completed' AND run_type = 'batch'"


@query(
    "runs_page",
    sql(f"SELECT id, scenario_id, created_at, (SELECT count(*) FROM runs WHERE {_RUNS}) AS total FROM runs WHERE {_RUNS} ORDER BY created_at DESC, id LIMIT 50 OFFSET 50"),
)
def runs_page(spark, folder):
    kept = runs(spark, folder).filter(_RUNS)
    page = listing.page(kept, "created_at", "desc", "id", 50, 50).select("id", "scenario_id", "created_at")
    return listing.with_total(page, kept)


_PARTS = "SELECT 'sc' || p_partkey AS id, p_name || ' ' || p_partkey AS name, [p_brand, p_type] AS tags FROM part"


@query(
    "scenarios_page",
    f"""
    SELECT id, name, (SELECT count(*) FROM ({_PARTS}) WHERE list_contains(tags, 'ECONOMY')) AS total
    FROM ({_PARTS}) WHERE list_contains(tags, 'ECONOMY') ORDER BY name DESC, id LIMIT 25 OFFSET 25
    """,
)
def scenarios_page(spark, folder):
    text = F.col("p_partkey").cast("string")
    rows = T.table(spark, folder, "part").select(
        F.concat(F.lit("sc"), text).alias("id"), F.concat_ws(" ", "p_name", text).alias("name"), F.array("p_brand", "p_type").alias("tags")
    )
    kept = S.filter_scenarios(rows, tag="ECONOMY")
    return listing.with_total(listing.page(kept, listing.SCENARIO_SORTS["name"], "desc", "id", 25, 25).select("id", "name"), kept)


@query(
    "requested_scenarios",
    sql(
        """
        SELECT scenario_id, scenario_id IN (SELECT 'sc' || (p_partkey * 3) FROM part) AS known FROM (SELECT DISTINCT scenario_id FROM runs)
        """
    ),
)
def requested_scenarios(spark, folder):
    """Scenario ids asked for by the runs, known (every third number of the part table) or not."""
    stored = T.table(spark, folder, "part").select(F.concat(F.lit("sc"), (F.col("p_partkey") * 3).cast("string")).alias("scenario_id"))
    known, unknown = S.known_scenarios(runs(spark, folder), stored)
    return known.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)))
