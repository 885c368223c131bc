"""Files in and out, imports, operations, replays."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tallymill.functions import identity
from tallymill.functions.period import parse_bound
from tallymill.operators import backfill as B
from tallymill.operators import counters as C
from tallymill.operators import dedup, listing, recon
from tallymill.plans import tables as T
from tallymill.plans.oracle import cte, event_key, sql
from tallymill.plans.registry import query
from tallymill.schemas import CKEY, SUM
from tallymill.sources import files, sinks, work

# ---- event files: every arrival, some spoiled -------------------------------

_MS = "date_trunc('millisecond', ts)"
cte(
    "spoiled",
    """
    SELECT seq, tenant_id, metric, customer_ref, resource_id,
           CASE WHEN seq % 50 = 7 THEN '12abc' ELSE CAST(CAST(quantity AS DOUBLE) AS VARCHAR) END AS quantity_text,
           CASE WHEN seq % 50 = 7 THEN NULL ELSE quantity END AS quantity,
           CASE WHEN seq % 50 = 9 THEN NULL ELSE date_trunc('millisecond', ts) END AS ts,
           CASE WHEN seq % 50 = 11 THEN '{bad' WHEN seq % 50 = 13 THEN '{}' ELSE meta END AS meta,
           CASE WHEN seq % 50 = 15 THEN 'own "' || seq || '", quoted' END AS idempotency_key,
           coalesce(source, 'import') AS source,
           concat_ws('; ', CASE WHEN seq % 50 = 7 OR quantity <= 0 THEN 'quantity: must be positive' END,
             CASE WHEN seq % 50 = 9 THEN 'Invalid ISO 8601 date-time format' END,
             CASE WHEN source = 'bogus' THEN 'source: unknown value' END,
             CASE WHEN seq % 50 = 11 THEN 'meta: not valid JSON' END) AS errors
    FROM arrivals
    """,
)


def spoiled(spark, folder, keep=()):
    """Arrivals as text, with broken quantities, times and meta in some rows."""
    s = F.col("seq") % 50
    return T.arrivals(spark, folder).select(
        *keep, "tenant_id", "metric", "customer_ref", "resource_id",
        F.when(s == 7, "12abc").otherwise(sinks.plain_number(F.col("quantity"))).alias("quantity"),
        F.when(s == 9, "soon").otherwise(identity.iso_millis(F.col("ts"))).alias("ts"),
        F.when(s == 11, "{bad").when(s == 13, "").otherwise(F.col("meta")).alias("meta"),
        F.when(s == 15, F.concat(F.lit('own "'), F.col("seq").cast("string"), F.lit('", quoted'))).alias("idempotency_key"),
        "source",
    )


def _csv_folder(spark, folder):
    path = work.new_folder(spark, "events-csv")
    sinks.write_events_csv(spoiled(spark, folder), path)
    return path


_IMPORTED = "tenant_id, metric, customer_ref, resource_id, quantity, ts, meta, idempotency_key, source, errors"


@query("csv_import", sql(f"SELECT {_IMPORTED} FROM spoiled"))
def csv_import(spark, folder):
    """Export to CSV and import again."""
    rows = files.read_events_csv(spark, _csv_folder(spark, folder))
    return rows.withColumn("errors", F.array_join("errors", "; "))


@query("csv_import_snake_case", sql(f"SELECT {_IMPORTED} FROM spoiled"))
def csv_import_snake_case(spark, folder):
    """The same with the other spelling of the columns."""
    path = work.new_folder(spark, "events-snake")
    spoiled(spark, folder).withColumnRenamed("ts", "timestamp").write.option("header", True).option("escape", '"').csv(path)
    rows = files.read_events_csv(spark, path)
    return rows.withColumn("errors", F.array_join("errors", "; "))


_BROKEN_KEY = "replace(idempotency_key, ', quoted', ',' || chr(10) || chr(10) || 'quoted')"


def _broken(rows):
    """The same rows with line breaks inside a quoted value."""
    return rows.withColumn("idempotency_key", F.replace("idempotency_key", F.lit(", quoted"), F.lit(",\n\nquoted")))


@query("csv_import_line_breaks", sql(f"SELECT * REPLACE ({_BROKEN_KEY} AS idempotency_key) FROM (SELECT {_IMPORTED} FROM spoiled)"))
def csv_import_line_breaks(spark, folder):
    """Export and import of values with line breaks; the files are still split."""
    path = work.new_folder(spark, "events-broken")
    sinks.write_events_csv(_broken(spoiled(spark, folder)), path)
    rows = files.read_events_csv(spark, path, line_breaks=True)
    return rows.withColumn("errors", F.array_join("errors", "; "))


@query("json_import", sql(f"SELECT {_IMPORTED} FROM spoiled"))
def json_import(spark, folder):
    """Files of one JSON array of at most 500 events each."""
    path = work.new_folder(spark, "events-json")
    numbered = spoiled(spark, folder, keep=("seq",))
    event = sinks.events_for_export(numbered).select(F.struct(*sinks.EVENT_CSV).alias("event"), F.col("seq"))
    arrays = event.groupBy(F.floor(F.col("seq") / 500)).agg(F.to_json(F.collect_list("event")).alias("value")).select("value")
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    loaded = files.read_events_json(spark, path)
    return loaded.withColumn("errors", F.array_join("errors", "; "))


def _replay_rows(spark, folder):
    return spoiled(spark, folder).select(
        F.col("idempotency_key").alias("id"), F.col("customer_ref").alias("customer"), F.col("metric").alias("meter"),
        F.col("quantity").alias("qty"), "ts", F.col("resource_id").alias("resourceId"), "meta",
    )


_REPLAYED = f"""
    SELECT 'tx' AS tenant_id, metric, customer_ref, resource_id, quantity, ts, meta, idempotency_key, 'etl' AS source,
           replace(replace(errors, '; source: unknown value', ''), 'source: unknown value', '') AS errors FROM spoiled
"""


@query("replay_jsonl", sql(_REPLAYED))
def replay_jsonl(spark, folder):
    path = work.new_folder(spark, "replay-json")
    _replay_rows(spark, folder).write.json(path)
    return files.read_replay_jsonl(spark, path, "tx").withColumn("errors", F.array_join("errors", "; "))


def _replay_csv(spark, folder):
    path = work.new_folder(spark, "replay-csv")
    _replay_rows(spark, folder).write.option("header", True).option("escape", '"').csv(path)
    return files.read_replay_csv(spark, path, "tx")


@query("replay_csv_line_breaks", sql(f"SELECT * REPLACE ({_BROKEN_KEY} AS idempotency_key) FROM ({_REPLAYED})"))
def replay_csv_line_breaks(spark, folder):
    path = work.new_folder(spark, "replay-broken")
    broken = _broken(_replay_rows(spark, folder).withColumnRenamed("id", "idempotency_key")).withColumnRenamed("idempotency_key", "id")
    broken.write.option("header", True).option("escape", '"').csv(path)
    return files.read_replay_csv(spark, path, "tx", line_breaks=True).withColumn("errors", F.array_join("errors", "; "))


@query("replay_csv", sql(_REPLAYED))
def replay_csv(spark, folder):
    return _replay_csv(spark, folder).withColumn("errors", F.array_join("errors", "; "))


cte(
    "replay_keys",
    f"""
    SELECT coalesce(idempotency_key, 'evt_' || substr(sha256(concat_ws('|', tenant_id, metric, customer_ref, 'default',
               strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'))), 1, 16)) AS key, errors, ts
    FROM ({_REPLAYED})
    """,
)


@query(
    "replay_file",
    sql(
        """
        SELECT count(*) AS total, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 00:00:00') AS considered,
               count(DISTINCT key) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND errors = '') AS sent,
               count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND errors = '')
                 - count(DISTINCT key) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND errors = '') AS duplicates,
               count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' AND errors <> '') AS errors
        FROM replay_keys
        """
    ),
)
def replay_file(spark, folder):
    """Rows of the last ten days of a replay file."""
    return B.replay_file(_replay_csv(spark, folder), None, T.now(), 240)[1]


# ---- imports ----------------------------------------------------------------

cte(
    "import_rows",
    f"""
    SELECT *, coalesce(idempotency_key, {event_key()}) AS key, ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' AS wanted
    FROM spoiled
    """,
)
cte(
    "import_new",
    """
    SELECT key, arg_min(i, (ts, quantity)) AS i FROM (SELECT key, i, i.ts AS ts, i.quantity AS quantity FROM import_rows i WHERE errors = '' AND wanted)
    WHERE key NOT IN (SELECT idempotency_key FROM keyed WHERE error IS NULL AND batch_id <= DATE '2024-01-10') GROUP BY key
    """,
)


def _import(spark, folder):
    """An import of January 5 to 20 into a ledger that knows the arrivals up to the 10th."""
    loaded = files.read_events_csv(spark, _csv_folder(spark, folder))
    known = T.arrivals(spark, folder).filter(F.col("batch_id") <= F.lit("2024-01-10").cast("date"))
    ledger = dedup.ingest(known, T.now())[0].select("idempotency_key")
    return B.backfill(loaded, ledger, "2024-01-05", "2024-01-20")


@query(
    "backfill_accounting",
    sql(
        """
        SELECT (SELECT count(*) FROM import_rows) AS total_events, (SELECT count(*) FROM import_new) AS processed_events,
               (SELECT count(*) FROM import_rows WHERE errors <> '') AS failed_events,
               (SELECT count(*) FROM import_rows WHERE errors = '' AND wanted) - (SELECT count(*) FROM import_new) AS duplicate_events
        """
    ),
)
def backfill_accounting(spark, folder):
    return _import(spark, folder).accounting


@query(
    "backfill_inserted",
    sql("SELECT key AS idempotency_key, i.customer_ref AS customer_ref, i.metric AS metric, i.quantity AS quantity, i.ts AS ts FROM import_new"),
)
def backfill_inserted(spark, folder):
    return _import(spark, folder).inserted.select("idempotency_key", "customer_ref", "metric", "quantity", "ts")


@query("backfill_quarantine", sql("SELECT errors, count(*) AS n_rows FROM import_rows WHERE errors <> '' GROUP BY ALL"))
def backfill_quarantine(spark, folder):
    bad = _import(spark, folder).quarantined
    return bad.groupBy(F.array_join("errors", "; ").alias("errors")).agg(F.count("*").alias("n_rows"))


@query(
    "backfill_affected",
    sql("SELECT DISTINCT i.tenant_id AS tenant_id, i.metric AS metric, i.customer_ref AS customer_ref, CAST(date_trunc('month', i.ts) AS DATE) AS period_start FROM import_new"),
)
def backfill_affected(spark, folder):
    return _import(spark, folder).affected


@query(
    "backfill_filter",
    sql("SELECT customer_ref, count(*) AS n_events FROM plain WHERE customer_ref = 'cus_7' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-12' GROUP BY ALL"),
)
def backfill_filter(spark, folder):
    kept = B.filter_backfill(T.plain_events(spark, folder), "cus_7", "2024-01-03", "2024-01-12")
    return kept.groupBy("customer_ref").agg(F.count("*").alias("n_events"))


# ---- operations: one per order, in up to three status versions ---------------

cte(
    "operations",
    """
    SELECT 'op' || o_orderkey AS id, 't' || (o_custkey % 3) AS tenant_id,
           CASE WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'processing'
                WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
           o_orderdate AS created_at, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + INTERVAL 10 MINUTE END AS started_at,
           CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 1 HOUR END AS completed_at
    FROM orders
    """,
)


def operation_versions(spark, folder):
    o = T.table(spark, folder, "orders")
    day = F.col("o_orderdate")
    started, done = day + F.expr("interval 10 minutes"), day + F.expr("interval 1 hour")
    nothing = F.lit(None).cast("timestamp")
    version = lambda status, s, c, at: F.struct(
        status.alias("status"), s.alias("started_at"), c.alias("completed_at"), at.alias("updated_at")
    )
    versions = F.array(
        version(F.lit("pending"), nothing, nothing, day),
        F.when(F.col("o_orderstatus") != "P", version(F.lit("processing"), started, nothing, started)),
        F.when(
            F.col("o_orderstatus") == "F",
            version(F.when(F.col("o_orderkey") % 5 == 0, "failed").otherwise("completed"), started, done, done),
        ),
    )
    return o.select(
        F.concat(F.lit("op"), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("t"), (F.col("o_custkey") % 3).cast("string")).alias("tenant_id"),
        day.alias("created_at"),
        F.explode(F.array_compact(versions)).alias("v"),
    ).select("id", "tenant_id", "created_at", "v.*")


def operations(spark, folder):
    return B.current_operations(operation_versions(spark, folder))


@query("operation_status", sql("SELECT id, status, started_at, completed_at FROM operations"))
def operation_status(spark, folder):
    return operations(spark, folder).select("id", "status", "started_at", "completed_at")


@query(
    "operations_by_status",
    sql(
        "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in
        ["pending", "processing", "completed", "failed", "cancelled"]) + " FROM operations"
    ),
)
def operations_by_status(spark, folder):
    return B.operations_by_status(operations(spark, folder))


@query(
    "operations_page",
    sql("SELECT id, status, created_at FROM operations WHERE tenant_id = 't1' ORDER BY created_at DESC, id LIMIT 50 OFFSET 100"),
)
def operations_page(spark, folder):
    own = operations(spark, folder).filter(F.col("tenant_id") == "t1")
    return listing.page(own, listing.OPERATION_SORTS["createdAt"], "desc", "id", 50, 100).select("id", "status", "created_at")


@query(
    "stuck_operations",
    sql(
        "SELECT id, 'cancelled' AS status, 'Operation timed out' AS error_message, TIMESTAMP '1998-08-02 00:20:00' AS completed_at "
        "FROM operations WHERE status = 'processing' AND started_at <= TIMESTAMP '1998-08-01 23:50:00'"
    ),
)
def stuck_operations(spark, folder):
    at = F.lit("1998-08-02 00:20:00").cast("timestamp")
    return B.cancel_stuck(operations(spark, folder), at).select("id", "status", "error_message", "completed_at")


# ---- replays ----------------------------------------------------------------

cte(
    "stored_counters",
    f"""
    SELECT {', '.join(CKEY)}, last_day(period_start) AS period_end, CAST(sum(quantity) AS DECIMAL(38,6)) AS agg_sum,
           CAST(max(quantity) AS DECIMAL(20,6)) AS agg_max, CAST(arg_max(quantity, (ts, quantity)) AS DECIMAL(20,6)) AS agg_last,
           max(ts) AS watermark_ts FROM plain WHERE batch_id <= DATE '2024-01-20' GROUP BY ALL
    """,
)
cte(
    "replay_found",
    f"""
    SELECT {', '.join(CKEY)}, count(*) AS events_found, count(*) FILTER (WHERE ts < watermark_ts - INTERVAL 48 HOUR) AS late_events
    FROM plain LEFT JOIN (SELECT {', '.join(CKEY)}, watermark_ts FROM stored_counters) USING ({', '.join(CKEY)})
    WHERE tenant_id = 't1' AND metric IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-30 00:00:00'
    GROUP BY ALL
    """,
)
cte(
    "replay_customers",
    f"""
    SELECT {', '.join(CKEY)}, events_found, late_events, CAST(n.agg_sum - coalesce(s.agg_sum, 0) AS DECIMAL(38,6)) AS counter_delta,
           n.agg_sum AS new_sum, n.watermark_ts AS new_mark
    FROM replay_found JOIN (SELECT {', '.join(CKEY)}, CAST(sum(quantity) AS DECIMAL(38,6)) AS agg_sum, max(ts) AS watermark_ts FROM plain GROUP BY ALL) n USING ({', '.join(CKEY)})
    LEFT JOIN stored_counters s USING ({', '.join(CKEY)})
    """,
)


def _replay(spark, folder, apply):
    events = T.plain_events(spark, folder)
    stored = C.build_counters(events.filter(F.col("batch_id") <= F.lit("2024-01-20").cast("date")).drop("period_start"))
    now = datetime(2024, 1, 30)
    return B.replay(events, stored, "t1", ["click", "view"], parse_bound("-P15D", now), parse_bound("now", now), apply)


@query(
    "replay_dry_run",
    sql(
        """
        SELECT metric, CAST(sum(events_found) AS BIGINT) AS events_found, CAST(sum(late_events) AS BIGINT) AS late_events,
               CAST(sum(counter_delta) AS DECIMAL(38,6)) AS counter_delta, count(DISTINCT customer_ref) AS affected_customers
        FROM replay_customers GROUP BY ALL
        """
    ),
)
def replay_dry_run(spark, folder):
    return _replay(spark, folder, False).changes


@query("replay_customers", sql(f"SELECT {', '.join(CKEY)}, events_found, late_events, counter_delta FROM replay_customers"))
def replay_customers(spark, folder):
    return _replay(spark, folder, False).customers


@query(
    "replay_summary",
    sql(
        """
        SELECT 'Would update ' || count(*) FILTER (WHERE counter_delta <> 0) || ' counters with +' || CAST(sum(counter_delta) AS DECIMAL(38,2)) || ' total delta' AS summary
        FROM replay_customers
        """
    ),
)
def replay_summary(spark, folder):
    return _replay(spark, folder, False).summary


@query(
    "replay_apply",
    sql(
        f"""
        SELECT {', '.join(CKEY)}, coalesce(new_sum, agg_sum) AS agg_sum, greatest(new_mark, watermark_ts) AS watermark_ts
        FROM stored_counters FULL JOIN replay_customers USING ({', '.join(CKEY)})
        """
    ),
)
def replay_apply(spark, folder):
    return _replay(spark, folder, True).counters.select(*CKEY, "agg_sum", "watermark_ts")


@query(
    "replay_change",
    sql(
        f"""
        SELECT tenant_id, metric, customer_ref, CAST(sum(agg_sum) AS DECIMAL(38,6)) AS before_total,
               CAST(sum(coalesce(new_sum, agg_sum)) AS DECIMAL(38,6)) AS after_total,
               CAST(sum(coalesce(new_sum, agg_sum)) - sum(agg_sum) AS DECIMAL(38,6)) AS change
        FROM (SELECT {', '.join(CKEY)}, coalesce(agg_sum, 0) AS agg_sum, new_sum FROM stored_counters FULL JOIN replay_customers USING ({', '.join(CKEY)}))
        GROUP BY GROUPING SETS ((tenant_id, metric, customer_ref), (tenant_id, metric))
        """
    ),
)
def replay_change(spark, folder):
    before = _replay(spark, folder, False).counters
    return recon.replay_change(before, _replay(spark, folder, True).counters)


@query(
    "event_stats",
    sql(
        """
        SELECT (SELECT count(*) FROM results WHERE status = 'accepted') AS total_processed,
               (SELECT count(*) FROM results WHERE status = 'duplicate') AS duplicates_filtered,
               count(*) FILTER (WHERE lateness_class = 'very_late') AS late_events, max(ts) AS last_event_time FROM classified
        """
    ),
)
def event_stats(spark, folder):
    return B.event_stats(T.ingested(spark, folder)[1], C.classify_lateness(T.plain_events(spark, folder)))


# ---- ledger and counter tables on disk --------------------------------------


@query(
    "ledger_on_disk",
    sql("SELECT period_start, metric, count(*) AS n_events, CAST(sum(quantity) AS DECIMAL(38,6)) AS agg_sum FROM shipments WHERE tenant_id = 'ASIA' AND ts >= TIMESTAMP '1997-02-10' AND ts <= TIMESTAMP '1998-11-20' GROUP BY ALL"),
)
def ledger_on_disk(spark, folder):
    """Appends the shipment ledger in two parts and scans a time range of it; only the months of the range are read."""
    path = work.new_folder(spark, "ledger")
    nothing = F.lit(None).cast("string")
    rows = T.shipments(spark, folder).select(
        "tenant_id", "metric", "customer_ref", nothing.alias("resource_id"), "quantity", "ts", nothing.alias("meta"),
        "idempotency_key", F.lit("etl").alias("source"), F.col("ts").alias("inserted_at"), "period_start",
    )
    old = F.col("metric") == "A"
    sinks.append_ledger(rows.filter(old), path, 2)
    sinks.append_ledger(rows.filter(~old), path, 2)
    scanned = listing.filter_events(files.read_ledger(spark, path), "ASIA", start="1997-02-10 00:00:00", end="1998-11-20 00:00:00")
    return scanned.groupBy("period_start", "metric").agg(F.count("*").alias("n_events"), F.sum("quantity").cast(SUM).alias("agg_sum"))


@query(
    "upsert_on_disk",
    sql(f"SELECT {', '.join(CKEY)}, agg_sum, agg_max, watermark_ts FROM ship_counters"),
)
def upsert_on_disk(spark, folder):
    """A counter table of the usage before 1998-07-20, merged with recounts of the months since July 1998."""
    path = work.new_folder(spark, "counters")
    events = T.shipments(spark, folder)
    columns = CKEY + ["agg_sum", "agg_max", "watermark_ts"]
    early = C.build_counters(events.filter(F.col("ts") < F.lit("1998-07-20").cast("timestamp"))).select(*columns)
    sinks.upsert_periods(early, path, CKEY, ("watermark_ts",))
    later = C.build_counters(events.filter(F.col("period_start") >= F.lit("1998-07-01").cast("date"))).select(*columns)
    sinks.upsert_periods(later, path, CKEY, ("watermark_ts",))
    return sinks.read_periods(spark, path, early.schema).select(*columns)
