"""Adjustments, push plan, reconciliation, alerts, caps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.operators import adjustments as A
from tallymill.operators import alerts as L
from tallymill.operators import counters as C
from tallymill.operators import listing, recon, sketches, validate
from tallymill.functions import compare
from tallymill.plans import tables as T
from tallymill.plans.oracle import cte, half_up, literal, micros, sql, values
from tallymill.plans.registry import query
from tallymill.sources import work
from tallymill.schemas import ADJUSTMENT_REASONS, CKEY, QTY, SUM

NOW = "2002-01-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


# ---- adjustments: one per order ---------------------------------------------

_METRIC_SQL = "CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(T.EVENT_METRICS)) + " END"
_ADJ = "id, tenant_id, metric, customer_ref, period_start, delta, reason, actor, status"

cte(
    "adjustments",
    f"""
    SELECT 'adj' || o_orderkey AS id, 't' || (o_custkey % 3) AS tenant_id, {_METRIC_SQL} AS metric,
           'cus_' || o_custkey AS customer_ref, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start,
           CAST(CAST(o_totalprice AS DECIMAL(20,6)) * CAST(0.001 AS DECIMAL(4,3)) - 200 AS DECIMAL(20,6)) AS delta,
           'correction' AS reason, 'api:seed' AS actor,
           CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'reverted' END AS status,
           CAST(NULL AS VARCHAR) AS parent_adjustment_id, o_orderdate AS created_at
    FROM orders
    """,
)
cte(
    "asked",
    """
    SELECT CASE WHEN o_orderkey % 13 = 0 THEN 'gone' ELSE 'adj' END || o_orderkey AS id,
           't' || (o_custkey % 3) AS tenant_id FROM orders
    """,
)


def _metric(key):
    chosen = None
    for i, m in enumerate(T.EVENT_METRICS):
        chosen = F.when(key % 5 == i, m) if chosen is None else chosen.when(key % 5 == i, m)
    return chosen


def adjustments(spark, folder):
    o = T.table(spark, folder, "orders")
    empty = lambda kind: F.lit(None).cast(kind)
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("reverted")
    return o.select(
        F.concat(F.lit("adj"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("t"), (F.col("o_custkey") % 3).cast("string")).alias("tenant_id"),
        _metric(F.col("o_orderkey")).alias("metric"),
        F.concat(F.lit("cus_"), F.col("o_custkey").cast("string")).alias("customer_ref"),
        F.trunc("o_orderdate", "MM").alias("period_start"),
        (F.col("o_totalprice").cast(QTY) * F.lit("0.001").cast("decimal(4,3)") - 200).cast(QTY).alias("delta"),
        F.lit("correction").alias("reason"),
        F.lit("api:seed").alias("actor"),
        status.alias("status"),
        empty("string").alias("approved_by"),
        empty("string").alias("reverted_by"),
        empty("string").alias("parent_adjustment_id"),
        empty("string").alias("request_id"),
        empty("string").alias("note"),
        empty("timestamp").alias("approved_at"),
        empty("timestamp").alias("reverted_at"),
        F.col("o_orderdate").alias("created_at"),
    )


def _asked(spark, folder):
    """A request per order; every thirteenth names an id that does not exist."""
    k = F.col("o_orderkey")
    return T.table(spark, folder, "orders").select(
        F.concat(F.when(k % 13 == 0, "gone").otherwise("adj"), k.cast("string")).alias("id"),
        F.concat(F.lit("t"), (F.col("o_custkey") % 3).cast("string")).alias("tenant_id"),
        F.lit("ops").alias("requested_by"),
    )


_RAW = f"""
    SELECT 'req' || o_orderkey AS id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 't' || (o_custkey % 3) END AS tenant_id,
           {_METRIC_SQL} AS metric, 'cus_' || o_custkey AS customer_ref,
           CASE WHEN o_orderkey % 19 = 0 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%Y-%m-01') END AS period_start,
           CAST(CAST(o_totalprice AS DECIMAL(20,6)) * 4 AS DECIMAL(20,6)) AS delta,
           ['backfill', 'correction', 'promo', 'credit', 'manual', 'other'][o_orderkey % 6 + 1] AS reason
    FROM orders
"""


def _requests(spark, folder):
    k = F.col("o_orderkey")
    return T.table(spark, folder, "orders").select(
        F.concat(F.lit("req"), k.cast("string")).alias("id"),
        F.when(k % 17 == 0, "").otherwise(F.concat(F.lit("t"), (F.col("o_custkey") % 3).cast("string"))).alias("tenant_id"),
        _metric(k).alias("metric"),
        F.concat(F.lit("cus_"), F.col("o_custkey").cast("string")).alias("customer_ref"),
        F.when(k % 19 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).otherwise(F.date_format("o_orderdate", "yyyy-MM-01")).alias("period_start"),
        (F.col("o_totalprice").cast(QTY) * 4).cast(QTY).alias("delta"),
        F.element_at(F.array(*[F.lit(r) for r in ADJUSTMENT_REASONS + ["other"]]), (k % 6 + 1).cast("int")).alias("reason"),
    )


_ERRORS = """
    concat_ws('; ', CASE WHEN tenant_id = '' THEN 'tenant_id: must not be empty' END,
      CASE WHEN NOT regexp_matches(period_start, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'period_start: must be YYYY-MM-DD' END,
      CASE WHEN abs(delta) > 1000000 THEN 'Adjustment delta out of bounds' END,
      CASE WHEN reason = 'other' THEN 'reason: unknown value' END)
"""


@query("adjustment_validate", f"SELECT id, {_ERRORS} AS errors FROM ({_RAW})")
def adjustment_validate(spark, folder):
    checked = validate.validate_adjustments(_requests(spark, folder))
    return checked.select("id", F.array_join("errors", "; ").alias("errors"))


@query(
    "adjustments_create",
    f"""
    SELECT id, tenant_id, metric, customer_ref, CAST(period_start AS DATE) AS period_start, delta, reason,
           'api:ops' AS actor, 'pending' AS status FROM ({_RAW}) WHERE {_ERRORS} = ''
    """,
)
def adjustments_create(spark, folder):
    return A.create(_requests(spark, folder), "ops", now())[0].select(*_ADJ.split(", "))


@query(
    "adjustments_approve",
    sql(
        """
        SELECT a.id, a.tenant_id, CASE WHEN status IS NULL THEN 'Not found' WHEN status = 'approved' THEN 'already'
               WHEN status = 'reverted' THEN 'Already reverted' ELSE 'approved' END AS outcome
        FROM asked a LEFT JOIN adjustments USING (id, tenant_id)
        """
    ),
)
def adjustments_approve(spark, folder):
    return A.approve(_asked(spark, folder), adjustments(spark, folder), now())[1]


@query(
    "adjustments_revert",
    sql(
        f"""
        SELECT 'rev:' || id AS id, tenant_id, metric, customer_ref, period_start, CAST(-delta AS DECIMAL(20,6)) AS delta,
               'correction' AS reason, 'api:ops' AS actor, 'approved' AS status
        FROM asked JOIN adjustments USING (id, tenant_id) WHERE status = 'approved'
        """
    ),
)
def adjustments_revert(spark, folder):
    return A.revert(_asked(spark, folder), adjustments(spark, folder), now())[1].select(*_ADJ.split(", "))


@query(
    "audit_rows",
    sql(
        f"""
        SELECT tenant_id, 'api_key' AS actor_type, 'api:ops' AS actor_id, action, 'adjustment' AS resource_type,
               id AS resource_id, TIMESTAMP '{NOW}' AS created_at
        FROM (SELECT id, tenant_id, 'adjustment.approve' AS action FROM asked JOIN adjustments USING (id, tenant_id) WHERE status = 'pending'
              UNION ALL
              SELECT id, tenant_id, 'adjustment.revert' FROM asked JOIN adjustments USING (id, tenant_id) WHERE status = 'approved'
              UNION ALL SELECT id, tenant_id, 'adjustment.create' FROM ({_RAW}) WHERE {_ERRORS} = '')
        """
    ),
)
def audit_rows(spark, folder):
    asked, rows = _asked(spark, folder), adjustments(spark, folder)
    return (
        A.approve(asked, rows, now())[2]
        .unionByName(A.revert(asked, rows, now())[3])
        .unionByName(A.create(_requests(spark, folder), "ops", now())[2])
    )


@query(
    "adjustment_fold",
    sql(
        f"""
        SELECT {', '.join(CKEY)}, CAST(sum(delta) AS DECIMAL(38,6)) AS adjusted FROM adjustments a
        WHERE status = 'approved' AND NOT EXISTS (SELECT 1 FROM asked q WHERE q.id = a.id AND q.tenant_id = a.tenant_id)
        GROUP BY ALL
        """
    ),
)
def adjustment_fold(spark, folder):
    """The fold after all asked reversals: a reverted row and its reversal both count nothing."""
    rows = adjustments(spark, folder)
    changed, reversals, _, _ = A.revert(_asked(spark, folder), rows, now())
    kept = rows.join(changed.select("id"), "id", "left_anti")
    return C.fold_adjustments(kept.unionByName(changed).unionByName(reversals))


@query(
    "adjustments_latest",
    sql(
        """
        SELECT id, CASE WHEN status = 'pending' AND id IN (SELECT id FROM asked) THEN 'approved' ELSE status END AS status
        FROM adjustments
        """
    ),
)
def adjustments_latest(spark, folder):
    """Newest version per id after the asked approvals."""
    rows = adjustments(spark, folder)
    updated = A.approve(_asked(spark, folder), rows, now())[0]
    versions = rows.withColumn("updated_at", F.col("created_at")).unionByName(
        updated.withColumn("updated_at", F.col("approved_at"))
    )
    return A.latest_version(versions, "id", "updated_at").select("id", "status")


@query(
    "bulk_approve",
    sql(
        """
        SELECT count(*) FILTER (WHERE status = 'pending') AS applied, count(*) FILTER (WHERE status IS DISTINCT FROM 'pending') AS failed
        FROM (SELECT DISTINCT id, tenant_id FROM asked) LEFT JOIN adjustments USING (id, tenant_id)
        """
    ),
)
def bulk_approve(spark, folder):
    outcomes = A.bulk_approve(_asked(spark, folder), adjustments(spark, folder), now())[1]
    return outcomes.agg(
        F.count_if(F.col("outcome") == "applied").alias("applied"), F.count_if(F.col("outcome") == "failed").alias("failed")
    )


@query(
    "bulk_approve_rows",
    sql(
        """
        SELECT a.id, a.tenant_id, 'approved' AS status, a.delta FROM adjustments a
        WHERE status = 'pending' AND EXISTS (SELECT 1 FROM asked q WHERE q.id = a.id AND q.tenant_id = a.tenant_id)
        """
    ),
)
def bulk_approve_rows(spark, folder):
    """The new versions of the approved rows, per tenant."""
    return A.bulk_approve(_asked(spark, folder), adjustments(spark, folder), now())[0].select("id", "tenant_id", "status", "delta")


@query(
    "list_adjustments",
    sql(
        f"SELECT {_ADJ} FROM adjustments WHERE tenant_id = 't1' AND status = 'approved' "
        "AND period_start BETWEEN DATE '1996-01-01' AND DATE '1997-06-01'"
    ),
)
def list_adjustments(spark, folder):
    return A.list_adjustments(
        adjustments(spark, folder), "t1", status="approved", first_period="1996-01-01", last_period="1997-06-01"
    ).select(*_ADJ.split(", "))


_POLICIES = [("t0", "roll"), ("t1", "credit_note")]


@query(
    "late_after_close",
    sql(
        f"""
        SELECT id, tenant_id, CASE WHEN closed AND policy = 'roll' THEN CAST(period_start + INTERVAL 1 MONTH AS DATE) ELSE period_start END AS period_start,
               CASE WHEN closed AND policy <> 'roll' THEN CASE WHEN delta < 0 THEN 'credit' ELSE 'debit' END END AS note, 
               CAST(CASE WHEN closed AND policy <> 'roll' THEN abs(delta) ELSE delta END AS DECIMAL(20,6)) AS amount
        FROM (SELECT a.*, coalesce(policy, 'roll') AS policy, period_start < DATE '1998-01-01' AS closed
              FROM adjustments a LEFT JOIN ({values("tenant_id, policy", _POLICIES)}) p USING (tenant_id))
        """
    ),
)
def late_after_close(spark, folder):
    policies = T.frame(spark, _POLICIES, "tenant_id string, policy string")
    kept, notes = A.settle_late(adjustments(spark, folder), policies, F.lit("1998-01-01").cast("date"))
    return kept.select("id", "tenant_id", "period_start", F.lit(None).cast("string").alias("note"), F.col("delta").alias("amount")).unionByName(
        notes.select("id", "tenant_id", "period_start", F.col("kind").alias("note"), "amount")
    )


@query(
    "customer_map",
    sql(
        """
        SELECT coalesce(billing, customer_ref) AS customer_ref, count(*) AS n_events, CAST(sum(quantity) AS DECIMAL(38,6)) AS agg_sum
        FROM plain LEFT JOIN (
          SELECT 't' || (c_custkey % 3) AS tenant_id, 'cus_' || c_custkey AS customer_ref,
                 CASE WHEN c_mktsegment <> 'BUILDING' THEN 'bill_' || c_nationkey END AS billing FROM customer) USING (tenant_id, customer_ref)
        GROUP BY ALL
        """
    ),
)
def customer_map(spark, folder):
    k = F.col("c_custkey")
    rows = T.table(spark, folder, "customer").select(
        F.concat(F.lit("t"), (k % 3).cast("string")).alias("tenant_id"),
        F.concat(F.lit("cus_"), k.cast("string")).alias("internal_id"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("bill_"), F.col("c_nationkey").cast("string"))).alias("billing_customer"),
    )
    mapped = A.map_customers(T.plain_events(spark, folder), rows)
    return mapped.groupBy("customer_ref").agg(F.count("*").alias("n_events"), F.sum("quantity").cast(SUM).alias("agg_sum"))


# ---- mappings, one per supplier ---------------------------------------------

_MAPS = """
    SELECT 'map' || s_suppkey AS id, n_name AS tenant_id, 'metric' || (s_suppkey % 40) AS metric,
           CASE WHEN s_suppkey % 11 = 0 THEN 'mean' ELSE 'sum' END AS aggregation,
           CASE WHEN s_suppkey % 7 = 0 THEN 'acc_' ELSE 'acct_' END || s_suppkey AS stripe_account,
           'price_' || s_suppkey AS price_id, CASE WHEN s_suppkey % 5 <> 0 THEN 'si_' || s_suppkey END AS subscription_item_id,
           CASE WHEN s_suppkey % 9 = 0 THEN 'US' ELSE 'USD' END AS currency, s_acctbal > 0 AS active, s_suppkey % 3 = 0 AS shadow
    FROM supplier JOIN nation ON n_nationkey = s_nationkey
"""


def _supplier_mappings(spark, folder):
    k = F.col("s_suppkey")
    text = k.cast("string")
    nation = T.table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("tenant_id"))
    empty = F.lit(None).cast("string")
    return T.table(spark, folder, "supplier").join(nation, "s_nationkey").select(
        F.concat(F.lit("map"), text).alias("id"),
        "tenant_id",
        F.concat(F.lit("metric"), (k % 40).cast("string")).alias("metric"),
        F.when(k % 11 == 0, "mean").otherwise("sum").alias("aggregation"),
        F.concat(F.when(k % 7 == 0, "acc_").otherwise("acct_"), text).alias("stripe_account"),
        F.concat(F.lit("price_"), text).alias("price_id"),
        F.when(k % 5 != 0, F.concat(F.lit("si_"), text)).alias("subscription_item_id"),
        F.when(k % 9 == 0, "US").otherwise("USD").alias("currency"),
        (F.col("s_acctbal") > 0).alias("active"),
        (k % 3 == 0).alias("shadow"),
        empty.alias("shadow_stripe_account"),
        empty.alias("shadow_price_id"),
        empty.alias("shadow_subscription_item_id"),
    )


@query(
    "mapping_check",
    f"""
    SELECT id, concat_ws('; ', CASE WHEN aggregation = 'mean' THEN 'aggregation: unknown value' END,
        CASE WHEN NOT starts_with(stripe_account, 'acct_') THEN 'stripe_account: must start with acct_' END,
        CASE WHEN length(currency) <> 3 THEN 'currency: must have 3 letters' END) AS errors FROM ({_MAPS})
    """,
)
def mapping_check(spark, folder):
    return validate.validate_mappings(_supplier_mappings(spark, folder)).select("id", F.array_join("errors", "; ").alias("errors"))


@query(
    "mapping_unique",
    f"SELECT tenant_id, metric, active, count(*) AS n_rows FROM ({_MAPS}) GROUP BY ALL HAVING count(*) > 1",
)
def mapping_unique(spark, folder):
    return validate.duplicate_mappings(_supplier_mappings(spark, folder))


@query(
    "list_mappings",
    f"SELECT id, tenant_id, metric, active, CASE WHEN shadow THEN 'shadow' ELSE 'live' END AS view FROM ({_MAPS}) WHERE active",
)
def list_mappings(spark, folder):
    return listing.list_mappings(_supplier_mappings(spark, folder), active=True).select("id", "tenant_id", "metric", "active", "view")


# ---- billed usage, push plan, reconciliation --------------------------------

# tenant or metric -> what the external biller counted, as a factor of local usage
_FACTORS = {"ASIA": "1.050", "N": "1.004", "R": "0.970"}
_FACTOR_SQL = "CASE WHEN tenant_id = 'ASIA' THEN 1.050 WHEN metric = 'N' THEN 1.004 WHEN metric = 'R' THEN 0.970 ELSE 1.000 END"

cte(
    "customer_totals",
    """
    SELECT c.tenant_id, subscription_item_id, period_start, metric, customer_ref,
           CAST(CASE aggregation WHEN 'max' THEN agg_max WHEN 'last' THEN coalesce(agg_last, 0) ELSE agg_sum END AS DECIMAL(38,6)) AS quantity
    FROM ship_counters c JOIN ship_mappings m USING (tenant_id, metric) WHERE active AND subscription_item_id IS NOT NULL
    """,
)
cte(
    "local_totals",
    """
    SELECT tenant_id, subscription_item_id, period_start, metric, CAST(sum(quantity) AS DECIMAL(38,6)) AS local_total, count(*) AS n_customers
    FROM customer_totals GROUP BY ALL
    """,
)
cte(
    "summaries",
    f"""
    SELECT tenant_id, subscription_item_id, period_start,
           CASE WHEN NOT (customer_ref LIKE '%7' AND metric = 'R')
                THEN CAST(CAST(quantity AS DECIMAL(26,6)) * CAST({_FACTOR_SQL} AS DECIMAL(4,3)) AS DECIMAL(38,6)) END AS total_usage
    FROM customer_totals
    """,
)
cte(
    "billed",
    """
    SELECT tenant_id, subscription_item_id, period_start, CAST(sum(coalesce(total_usage, 0)) AS DECIMAL(38,6)) AS stripe_total
    FROM summaries GROUP BY ALL
    """,
)
cte(
    "reports",
    """
    SELECT *, CASE WHEN drift_pct <= 0.005 THEN 'ok' ELSE 'investigate' END AS status FROM (
      SELECT *, CASE WHEN stripe_total > 0 THEN CAST(diff AS DOUBLE) / CAST(stripe_total AS DOUBLE) WHEN diff > 0 THEN 1.0 ELSE 0.0 END AS drift_pct
      FROM (SELECT tenant_id, subscription_item_id, period_start, metric, local_total, stripe_total,
                   CAST(abs(local_total - stripe_total) AS DECIMAL(38,6)) AS diff
            FROM local_totals JOIN billed USING (tenant_id, subscription_item_id, period_start)))
    """,
)
cte(
    "write_log",
    """
    SELECT tenant_id, 'acct_' || tenant_id AS stripe_account, subscription_item_id, period_start,
           CAST(CASE WHEN tenant_id = 'AMERICA' AND metric = 'R' THEN local_total * 2 ELSE local_total - 5 END AS DECIMAL(38,6)) AS pushed_total,
           'req' AS last_request_id, TIMESTAMP '2001-01-01 00:00:00' AS updated_at
    FROM local_totals WHERE period_start < DATE '2000-01-01'
    """,
)


def _counters(spark, folder):
    return C.build_counters(T.shipments(spark, folder))


def summaries(spark, folder, counters=None):
    counted = _counters(spark, folder) if counters is None else counters
    totals = recon.customer_totals(counted, T.shipment_mappings(spark))
    factor = (
        F.when(F.col("tenant_id") == "ASIA", F.lit("1.050"))
        .when(F.col("metric") == "N", F.lit("1.004"))
        .when(F.col("metric") == "R", F.lit("0.970"))
        .otherwise(F.lit("1.000"))
        .cast("decimal(4,3)")
    )
    seen = ~(F.col("customer_ref").endswith("7") & (F.col("metric") == "R"))
    return totals.select(
        *recon.ITEM, F.when(seen, (F.col("quantity").cast("decimal(26,6)") * factor).cast(SUM)).alias("total_usage")
    )


def found_reports(spark, folder, counters=None):
    mappings = T.shipment_mappings(spark)
    counted = _counters(spark, folder) if counters is None else counters
    local = recon.local_totals(counted, mappings)
    return recon.reports(local, recon.billed_totals(summaries(spark, folder, counted)), mappings)


def write_log(spark, folder):
    local = recon.local_totals(_counters(spark, folder), T.shipment_mappings(spark))
    pushed = F.when(
        (F.col("tenant_id") == "AMERICA") & (F.col("metric") == "R"), F.col("local_total") * 2
    ).otherwise(F.col("local_total") - 5)
    return local.filter(F.col("period_start") < F.lit("2000-01-01").cast("date")).select(
        "tenant_id",
        F.concat(F.lit("acct_"), F.col("tenant_id")).alias("stripe_account"),
        "subscription_item_id",
        "period_start",
        pushed.cast(SUM).alias("pushed_total"),
        F.lit("req").alias("last_request_id"),
        F.lit("2001-01-01 00:00:00").cast("timestamp").alias("updated_at"),
    )


@query("local_totals", sql("SELECT * FROM local_totals"))
def local_totals(spark, folder):
    return recon.local_totals(_counters(spark, folder), T.shipment_mappings(spark))


@query("billed_totals", sql("SELECT * FROM billed"))
def billed_totals(spark, folder):
    return recon.billed_totals(summaries(spark, folder))


def _plan_sql(configured: bool) -> str:
    return f"""
    SELECT t.tenant_id, t.metric, stripe_account AS live_account, subscription_item_id AS live_item,
           CASE WHEN to_test THEN coalesce(shadow_stripe_account, stripe_account) ELSE stripe_account END AS target_account,
           CASE WHEN to_test THEN coalesce(shadow_subscription_item_id, subscription_item_id) ELSE subscription_item_id END AS target_item,
           period_start, local_total, pushed_total, CAST(local_total - pushed_total AS DECIMAL(38,6)) AS delta,
           CASE WHEN to_test THEN 'shadow' WHEN shadow THEN 'skipped_shadow' ELSE 'live' END AS mode,
           CASE WHEN to_test THEN 'push-shadow:' ELSE 'push:' END || t.tenant_id || ':' ||
             CASE WHEN to_test THEN coalesce(shadow_subscription_item_id, subscription_item_id) ELSE subscription_item_id END
             || ':' || period_start || ':' || local_total AS push_key,
           CAST(floor(local_total + 0.5) AS BIGINT) AS reported_quantity, CAST(epoch(CAST(period_start AS TIMESTAMP)) AS BIGINT) AS reported_at
    FROM (SELECT l.*, m.* EXCLUDE (tenant_id, metric, subscription_item_id), shadow AND {literal(configured)} AS to_test,
                 CAST(coalesce(w.pushed_total, 0) AS DECIMAL(38,6)) AS pushed_total
          FROM local_totals l JOIN ship_mappings m USING (tenant_id, metric, subscription_item_id)
          LEFT JOIN write_log w USING (tenant_id, stripe_account, subscription_item_id, period_start)) t
    WHERE local_total > pushed_total
    """


def push_plan_rows(spark, folder, configured):
    return recon.push_plan(_counters(spark, folder), T.shipment_mappings(spark), write_log(spark, folder), configured)


@query("push_plan", sql(_plan_sql(True)))
def push_plan(spark, folder):
    return push_plan_rows(spark, folder, True)


@query("push_plan_without_test_target", sql(_plan_sql(False)))
def push_plan_without_test_target(spark, folder):
    return push_plan_rows(spark, folder, False)


@query(
    "write_log_advance",
    sql(
        f"""
        SELECT tenant_id, stripe_account, subscription_item_id, period_start,
               coalesce(local_total, w.pushed_total) AS pushed_total, coalesce(push_key, last_request_id) AS last_request_id,
               CASE WHEN push_key IS NULL THEN updated_at ELSE TIMESTAMP '{NOW}' END AS updated_at
        FROM write_log w FULL JOIN (
          SELECT tenant_id, live_account AS stripe_account, live_item AS subscription_item_id, period_start, local_total, push_key
          FROM ({_plan_sql(True)}) WHERE mode = 'live') p USING (tenant_id, stripe_account, subscription_item_id, period_start)
        """
    ),
)
def write_log_advance(spark, folder):
    return recon.advance_write_log(write_log(spark, folder), push_plan_rows(spark, folder, True), now())


@query("recon_reports", sql("SELECT * FROM reports"))
def recon_reports(spark, folder):
    return found_reports(spark, folder)


@query(
    "recon_csv_rows",
    sql(
        "SELECT subscription_item_id, strftime(period_start, '%Y-%m') AS period, local_total AS local, stripe_total AS stripe, "
        "diff AS drift_abs, drift_pct, status FROM reports"
    ),
)
def recon_csv_rows(spark, folder):
    return recon.report_csv(found_reports(spark, folder))


@query(
    "suggested_adjustments",
    sql(
        f"""
        SELECT tenant_id, metric, customer_ref, period_start, subscription_item_id, delta, 'correction' AS reason,
               'system:reconciliation' AS actor, 'pending' AS status
        FROM (SELECT r.*, t.customer_ref,
                CAST(CAST({half_up(micros("r.stripe_total - r.local_total") + " * " + micros("t.quantity"), micros("r.local_total"))} AS DECIMAL(32,0)) / 1000000 AS DECIMAL(38,6)) AS delta
              FROM reports r JOIN customer_totals t USING (tenant_id, subscription_item_id, period_start, metric)
              WHERE status = 'investigate' AND stripe_total > local_total)
        WHERE delta > 0.01
        """
    ),
)
def suggested_adjustments(spark, folder):
    counted = work.settle(_counters(spark, folder), "counters")
    customers = recon.customer_totals(counted, T.shipment_mappings(spark))
    return recon.suggestions(found_reports(spark, folder, counted), customers)


@query(
    "small_alignments",
    sql(
        """
        SELECT tenant_id, subscription_item_id, period_start, metric, CAST(stripe_total - local_total AS DECIMAL(38,6)) AS delta,
               'correction' AS reason, 'system:reconciliation' AS actor, 'pending' AS status
        FROM reports WHERE status = 'ok' AND diff <> 0
        """
    ),
)
def small_alignments(spark, folder):
    return recon.small_alignments(found_reports(spark, folder))


@query(
    "local_exceeds",
    sql(
        f"""
        SELECT 'local_exceeds_stripe' AS type, tenant_id, subscription_item_id, period_start, metric, local_total, stripe_total, diff,
               '{recon.LOCAL_EXCEEDS}' AS message FROM reports WHERE status = 'investigate' AND local_total > stripe_total
        """
    ),
)
def local_exceeds(spark, folder):
    return recon.local_exceeds(found_reports(spark, folder))


@query(
    "recon_run_metrics",
    sql(
        "SELECT count(*) AS reports, count(*) FILTER (WHERE status = 'investigate') AS investigating, "
        "CASE WHEN count(*) > 0 THEN CAST(95 AS BIGINT) END AS duration_seconds FROM reports"
    ),
)
def recon_run_metrics(spark, folder):
    return recon.run_metrics(found_reports(spark, folder), now() - F.expr("interval 95 seconds"), now())


@query(
    "recon_period_summary",
    sql(
        """
        SELECT tenant_id, period_start, count(*) AS total, count(*) FILTER (WHERE status = 'ok') AS ok,
               count(*) FILTER (WHERE status = 'investigate') AS investigating,
               count(*) FILTER (WHERE status = 'resolved') AS resolved, CAST(max(diff) AS DECIMAL(38,6)) AS max_diff
        FROM reports GROUP BY ALL
        """
    ),
)
def recon_period_summary(spark, folder):
    return recon.period_summary(found_reports(spark, folder))


_DRIFT = "CASE WHEN stripe > 0 THEN CAST(abs(local - stripe) AS DOUBLE) / CAST(stripe AS DOUBLE) WHEN local > 0 THEN 1.0 ELSE 0.0 END"
cte(
    "drift",
    f"""
    SELECT *, CAST(abs(local - stripe) AS DECIMAL(38,6)) AS drift_abs, {_DRIFT} AS drift_pct FROM (
      SELECT metric, CAST(sum(local_total) AS DECIMAL(38,6)) AS local, CAST(sum(stripe_total) AS DECIMAL(38,6)) AS stripe,
             count(DISTINCT subscription_item_id) AS items
      FROM reports WHERE tenant_id = 'EUROPE' AND period_start BETWEEN DATE '1995-01-01' AND DATE '2001-12-01' GROUP BY metric)
    """,
)
cte(
    "drift_all",
    f"""
    SELECT *, CAST(abs(local - stripe) AS DECIMAL(38,6)) AS drift_abs, {_DRIFT} AS drift_pct FROM (
      SELECT CAST(sum(local) AS DECIMAL(38,6)) AS local, CAST(sum(stripe) AS DECIMAL(38,6)) AS stripe, count(*) AS metrics,
             CAST(sum(items) AS BIGINT) AS items, count(*) FILTER (WHERE drift_abs > 0) AS metrics_with_drift FROM drift)
    """,
)


def _drift(spark, folder):
    return recon.drift_summary(found_reports(spark, folder), T.shipment_mappings(spark), "EUROPE", "1995-01", "2001-12")


@query(
    "recon_summary",
    sql(
        """
        SELECT metric, local, stripe, drift_abs, drift_pct, items, 0 AS row_order FROM drift
        UNION ALL SELECT 'TOTAL', local, stripe, drift_abs, drift_pct, items, 1 FROM drift_all
        """
    ),
)
def recon_summary(spark, folder):
    return recon.summary_with_total(_drift(spark, folder))


_MONTHS = "period_start BETWEEN DATE '{}-01' AND DATE '{}-01'"
_HALVES = (("1995-01", "1995-12"), ("1996-01", "1996-12"))


@query(
    "items_by_range",
    sql(
        f"""
        SELECT metric, count(DISTINCT (tenant_id, subscription_item_id)) AS items,
               count(DISTINCT (tenant_id, subscription_item_id)) FILTER (WHERE status = 'investigate') AS drifting
        FROM reports WHERE {_MONTHS.format('1995-01', '1996-12')} GROUP BY ALL
        """
    ),
)
def items_by_range(spark, folder):
    """Distinct items over two years from monthly sketches, exact at this size."""
    return sketches.items_over(sketches.item_sketches(found_reports(spark, folder)), "1995-01", "1996-12")


@query(
    "items_drifting_twice",
    sql(
        f"""
        SELECT metric, count(*) FILTER (WHERE a AND b) AS items FROM (
          SELECT metric, tenant_id, subscription_item_id, coalesce(bool_or(status = 'investigate' AND {_MONTHS.format(*_HALVES[0])}), false) AS a,
                 coalesce(bool_or(status = 'investigate' AND {_MONTHS.format(*_HALVES[1])}), false) AS b
          FROM reports WHERE {_MONTHS.format('1995-01', '1996-12')} GROUP BY ALL) GROUP BY metric
        """
    ),
)
def items_drifting_twice(spark, folder):
    return sketches.drifting_in_both(sketches.item_sketches(found_reports(spark, folder)), *_HALVES)


@query("recon_total", sql("SELECT * FROM drift_all"))
def recon_total(spark, folder):
    return recon.drift_total(_drift(spark, folder))


@query(
    "parity_gate",
    sql(
        """
        SELECT drift_abs, drift_pct, drift_abs = 0 OR drift_pct <= 0.005 AS passed,
               CASE WHEN drift_pct <= 0.005 THEN 'parity' WHEN drift_pct <= 0.05 THEN 'drift_detected' ELSE 'drift_critical' END AS label
        FROM drift_all
        """
    ),
)
def parity_gate(spark, folder):
    return recon.parity_gate(recon.drift_total(_drift(spark, folder)))


@query(
    "matched_share",
    sql("SELECT (1.0::DOUBLE - drift_pct) * 100 AS matched_pct, metrics_with_drift, metrics FROM drift_all"),
)
def matched_share(spark, folder):
    return recon.matched_share(_drift(spark, folder))


# ---- alerts: one rule per customer row --------------------------------------

cte(
    "rules",
    """
    SELECT 'rule' || c_custkey AS id, r_name AS tenant_id, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS customer_ref,
           CASE c_custkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'N' WHEN 2 THEN 'R' END AS metric,
           CASE c_custkey % 3 WHEN 0 THEN 'threshold' WHEN 1 THEN 'spike' ELSE 'budget' END AS type,
           CAST(CASE WHEN c_custkey % 3 = 1 THEN 2.5 ELSE abs(CAST(c_acctbal AS DECIMAL(20,6))) + 50 END AS DECIMAL(20,6)) AS threshold,
           CASE c_custkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'webhook' WHEN 2 THEN 'slack' WHEN 3 THEN 'hard_cap' ELSE 'soft_cap' END AS action,
           '{"email":"ops@' || c_custkey || '.example","url":"' || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'https://hook.example/' || c_custkey END
             || '","webhook":"https://chat.example/' || c_custkey || '","notifyCustomer":' || CASE WHEN c_custkey % 8 < 4 THEN 'true' ELSE 'false' END || '}' AS config,
           c_custkey % 10 <> 9 AS enabled, c_custkey
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
    """,
)


def rules(spark, folder):
    k = F.col("c_custkey")
    text = k.cast("string")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (k % n + 1).cast("int"))
    config = F.concat(
        F.lit('{"email":"ops@'), text, F.lit('.example","url":"'),
        F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("https://hook.example/"), text)),
        F.lit('","webhook":"https://chat.example/'), text, F.lit('","notifyCustomer":'),
        F.when(k % 8 < 4, "true").otherwise("false"), F.lit("}"),
    )
    threshold = F.when(k % 3 == 1, F.lit("2.5").cast(QTY)).otherwise(F.abs(F.col("c_acctbal").cast(QTY)) + 50)
    return T.owners(spark, folder).select(
        F.concat(F.lit("rule"), text).alias("id"),
        "tenant_id",
        F.when(k % 2 == 0, F.col("customer_ref")).alias("customer_ref"),
        pick(["A", "N", "R", None], 4).alias("metric"),
        pick(["threshold", "spike", "budget"], 3).alias("type"),
        threshold.cast(QTY).alias("threshold"),
        pick(["email", "webhook", "slack", "hard_cap", "soft_cap"], 5).alias("action"),
        config.alias("config"),
        (k % 10 != 9).alias("enabled"),
    )


# usage at the four grains of a rule; an open side has the empty text
cte(
    "grain_usage",
    """
    SELECT tenant_id, customer_ref AS who, metric AS what, period_start, sum(agg_sum) AS total FROM ship_counters GROUP BY ALL
    UNION ALL SELECT tenant_id, customer_ref, '', period_start, sum(agg_sum) FROM ship_counters GROUP BY ALL
    UNION ALL SELECT tenant_id, '', metric, period_start, sum(agg_sum) FROM ship_counters GROUP BY ALL
    UNION ALL SELECT tenant_id, '', '', period_start, sum(agg_sum) FROM ship_counters GROUP BY ALL
    """,
    materialized=True,
)
cte(
    "matched_rules",
    """
    SELECT r.*, u.period_start, CAST(u.total AS DECIMAL(38,6)) AS value,
           lag(u.period_start) OVER months AS month_before, lag(u.total) OVER months AS value_before
    FROM rules r JOIN grain_usage u ON u.tenant_id = r.tenant_id AND u.who = coalesce(r.customer_ref, '') AND u.what = coalesce(r.metric, '')
    WHERE enabled
    WINDOW months AS (PARTITION BY r.id ORDER BY u.period_start)
    """,
    materialized=True,
)
cte(
    "triggered",
    """
    SELECT * EXCLUDE (month_before, value_before) FROM matched_rules
    WHERE CASE WHEN type = 'spike' THEN month_before = CAST(period_start - INTERVAL 1 MONTH AS DATE) AND value_before > 0
                 AND CAST(value AS DOUBLE) / CAST(CAST(value_before AS DECIMAL(38,6)) AS DOUBLE) >= CAST(threshold AS DOUBLE)
          ELSE value >= threshold END
    """,
    materialized=True,
)


def _triggered(spark, folder):
    return L.evaluate(rules(spark, folder), _counters(spark, folder))


@query("alerts_threshold", sql("SELECT id, tenant_id, customer_ref, metric, type, threshold, period_start, value FROM triggered WHERE type <> 'spike'"))
def alerts_threshold(spark, folder):
    found = L.evaluate(rules(spark, folder).filter(F.col("type") != "spike"), _counters(spark, folder))
    return found.select("id", "tenant_id", "customer_ref", "metric", "type", "threshold", "period_start", "value")


@query("alerts_spike", sql("SELECT id, tenant_id, customer_ref, metric, threshold, period_start, value FROM triggered WHERE type = 'spike'"))
def alerts_spike(spark, folder):
    found = L.evaluate(rules(spark, folder).filter(F.col("type") == "spike"), _counters(spark, folder))
    return found.select("id", "tenant_id", "customer_ref", "metric", "threshold", "period_start", "value")


@query("alerts_one_period", sql("SELECT id, type, value FROM triggered WHERE period_start = DATE '1998-06-01'"))
def alerts_one_period(spark, folder):
    return L.evaluate(rules(spark, folder), _counters(spark, folder), "1998-06-01").select("id", "type", "value")


cte(
    "history",
    f"""
    SELECT id || ':' || period_start AS id, id AS alert_config_id, tenant_id, customer_ref, metric, value, threshold, action, 'triggered' AS status,
           '{{"periodStart":"' || period_start || '","configType":"' || type || '"}}' AS metadata, period_start,
           CAST(period_start AS TIMESTAMP) + INTERVAL 20 DAY AS triggered_at
    FROM triggered
    """,
)


@query(
    "alert_records",
    sql(
        f"SELECT id, alert_config_id, tenant_id, customer_ref, metric, value, threshold, action, status, metadata, TIMESTAMP '{NOW}' AS triggered_at FROM history"
    ),
)
def alert_records(spark, folder):
    return L.alert_records(_triggered(spark, folder), now())


def _history(spark, folder):
    found = _triggered(spark, folder)
    return L.alert_records(found, F.col("period_start").cast("timestamp") + F.make_dt_interval(F.lit(20)))


@query(
    "alert_cooldown",
    sql(
        """
        SELECT id, period_start FROM triggered WHERE NOT (CAST(period_start AS TIMESTAMP) + INTERVAL 20 DAY > TIMESTAMP '1998-06-20 23:30:00')
        """
    ),
)
def alert_cooldown(spark, folder):
    """All alerts again at half past midnight of June 21, 1998: rows that fired since 23:30 stay silent."""
    at = F.lit("1998-06-21 00:30:00").cast("timestamp")
    return L.without_cooldown(_triggered(spark, folder), _history(spark, folder), at).select("id", "period_start")


@query(
    "alert_history",
    sql(
        "SELECT id, alert_config_id, value, triggered_at FROM history WHERE tenant_id = 'ASIA' AND status = 'triggered' "
        "AND triggered_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31'"
    ),
)
def alert_history(spark, folder):
    return L.list_history(
        _history(spark, folder), "ASIA", status="triggered", start="1997-01-01 00:00:00", end="1998-12-31 00:00:00"
    ).select("id", "alert_config_id", "value", "triggered_at")


def _json_text(expr: str) -> str:
    return f"coalesce('\"' || {expr} || '\"', 'null')"


@query(
    "alert_outbox",
    sql(
        f"""
        SELECT id, tenant_id, period_start, channel, target,
          CASE channel WHEN 'email' THEN '{{"to":"' || target || '","subject":"Usage Alert: ' || type || ' threshold exceeded","template":"usage_alert","data":{{"type":"'
                 || type || '","value":' || shown || ',"threshold":' || threshold || ',"metric":' || {_json_text("metric")} || ',"customerRef":' || {_json_text("customer_ref")} || '}}}}'
               WHEN 'webhook' THEN '{{"alertId":"' || id || '","type":"' || type || '","metric":' || {_json_text("metric")} || ',"customerRef":' || {_json_text("customer_ref")}
                 || ',"currentValue":' || value || ',"threshold":' || threshold || ',"timestamp":"2002-01-01T00:00:00.000Z"}}'
               ELSE '{{"text":"Usage Alert","blocks":[{{"type":"section","text":{{"type":"mrkdwn","text":"*Alert Type:* ' || type || '\\n*Metric:* ' || coalesce(metric, 'All')
                 || '\\n*Customer:* ' || coalesce(customer_ref, 'All') || '\\n*Current Value:* ' || value || '\\n*Threshold:* ' || threshold || '"}}}}]}}' END AS payload
        FROM (SELECT *, CASE WHEN action IN ('hard_cap', 'soft_cap') THEN threshold ELSE value END AS shown,
                CASE WHEN action IN ('email', 'webhook', 'slack') THEN action WHEN c_custkey % 8 < 4 THEN 'email' END AS channel,
                CASE action WHEN 'webhook' THEN CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'https://hook.example/' || c_custkey END
                     WHEN 'slack' THEN 'https://chat.example/' || c_custkey ELSE 'ops@' || c_custkey || '.example' END AS target
              FROM triggered) WHERE channel IS NOT NULL AND target <> ''
        """
    ),
)
def alert_outbox(spark, folder):
    return L.outbox(_triggered(spark, folder), now())


cte(
    "in_force",
    """
    SELECT tenant_id, coalesce(customer_ref, '*') AS customer_ref, coalesce(metric, '*') AS metric,
           bool_or(action = 'hard_cap') AS hard, bool_or(action = 'soft_cap') AS soft
    FROM triggered WHERE action IN ('hard_cap', 'soft_cap') GROUP BY ALL
    """,
)


@query("caps", sql("SELECT * FROM in_force"))
def caps(spark, folder):
    return L.caps(_triggered(spark, folder))


@query(
    "caps_enforced",
    sql(
        """
        SELECT tenant_id, customer_ref, metric, cap, count(*) AS n_events FROM (
          SELECT s.*, CASE WHEN (SELECT bool_or(hard) FROM in_force c WHERE c.tenant_id = s.tenant_id AND c.customer_ref IN ('*', s.customer_ref) AND c.metric IN ('*', s.metric)) THEN 'reject'
                 WHEN (SELECT bool_or(soft) FROM in_force c WHERE c.tenant_id = s.tenant_id AND c.customer_ref IN ('*', s.customer_ref) AND c.metric IN ('*', s.metric)) THEN 'warn' END AS cap
          FROM shipments s) GROUP BY ALL
        """
    ),
)
def caps_enforced(spark, folder):
    in_force = work.settle(L.caps(_triggered(spark, folder)), "caps")
    marked = L.enforce_caps(T.shipments(spark, folder), in_force)
    return marked.groupBy("tenant_id", "customer_ref", "metric", "cap").agg(F.count("*").alias("n_events"))


@query(
    "alert_rule_check",
    sql(
        """
        SELECT id, concat_ws('; ', CASE WHEN c_custkey % 3 = 2 THEN 'type: unknown value' END,
               CASE WHEN c_custkey % 4 = 3 THEN 'threshold: must be positive' END,
               CASE WHEN c_custkey % 5 > 3 THEN 'action: unknown value' END) AS errors FROM rules
        """
    ),
)
def alert_rule_check(spark, folder):
    """The rules with some words and numbers spoiled."""
    spoiled = (
        rules(spark, folder)
        .withColumn("type", F.when(F.col("type") != "budget", F.col("type")))
        .withColumn("threshold", F.when(F.col("metric").isNotNull(), F.col("threshold")).otherwise(0))
        .withColumn("action", F.regexp_replace("action", "soft_cap", "stop"))
    )
    return validate.validate_alert_configs(spoiled).select("id", F.array_join("errors", "; ").alias("errors"))


# ---- usage views ------------------------------------------------------------


@query("current_usage", sql("SELECT tenant_id, customer_ref, metric, agg_sum AS current FROM ship_counters WHERE period_start = DATE '1999-03-01'"))
def current_usage(spark, folder):
    return listing.current_usage(_counters(spark, folder), "1999-03-01")


@query(
    "usage_limits",
    sql(
        """
        SELECT tenant_id, customer_ref, metric, agg_sum AS current, CASE metric WHEN 'A' THEN 120 WHEN 'N' THEN 0 END AS usage_limit,
               CASE metric WHEN 'A' THEN CAST(agg_sum AS DOUBLE) / 120 * 100 ELSE 0.0 END AS percent
        FROM ship_counters WHERE period_start = DATE '1999-03-01'
        """
    ),
)
def usage_limits(spark, folder):
    limits = T.frame(spark, [("A", 120), ("N", 0)], "metric string, usage_limit int")
    return listing.usage_against_limits(listing.current_usage(_counters(spark, folder), "1999-03-01"), limits)


@query(
    "projection_freshness",
    sql(
        f"""
        SELECT tenant_id, max(watermark_ts) AS last_updated, CAST(epoch(TIMESTAMP '{NOW}') - epoch(max(watermark_ts)) AS BIGINT) AS staleness_seconds
        FROM ship_counters GROUP BY ALL
        """
    ),
)
def projection_freshness(spark, folder):
    return listing.freshness(_counters(spark, folder), now(), "watermark_ts")


@query(
    "age_labels",
    """
    SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN (m // 60) || 'h ago'
           WHEN m < 10080 THEN (m // 1440) || 'd ago' ELSE strftime(ts, '%b %-d, %Y, %I:%M %p') END AS label
    FROM (SELECT event_id, ts, CAST(floor((epoch_ms(TIMESTAMP '2024-01-31 00:00:00') - epoch_ms(ts)) / 60000) AS BIGINT) AS m FROM events)
    """,
)
def age_labels(spark, folder):
    at = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return T.table(spark, folder, "events").select("event_id", compare.age_label(F.col("ts"), at).alias("label"))
