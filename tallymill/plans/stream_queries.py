"""Streams over the given events, run to the end of the data, and their windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill import schemas
from tallymill.plans import tables as T
from tallymill.plans.oracle import cte, sql
from tallymill.plans.recon_queries import found_reports
from tallymill.plans.registry import query
from tallymill.sources import files, work
from tallymill.streaming import ingest, windows

_ARRIVALS = (
    "seq bigint, tenant_id string, metric string, customer_ref string, resource_id string, "
    f"quantity {schemas.QTY}, ts timestamp, meta string, idempotency_key string, source string, inserted_at timestamp"
)
_COLUMNS = [c.split(" ")[0] for c in _ARRIVALS.replace("decimal(20,6)", "decimal").split(", ")]
_CUTS = ["2024-01-10", "2024-01-20"]
_RULES = [
    (f"r{i}", tenant, None, metric, "threshold", limit, "email", "{}", True)
    for i, (tenant, metric, limit) in enumerate([("t0", "click", "100"), ("t1", None, "500"), ("t2", "view", "1000")])
]


def _parts(spark, folder):
    """The arrivals in the order of their days of arrival: up to the 10th, up to the 20th, later."""
    rows = T.arrivals(spark, folder)
    low, high = (F.lit(d).cast("date") for d in _CUTS)
    yield rows.filter(F.col("batch_id") <= low)
    yield rows.filter((F.col("batch_id") > low) & (F.col("batch_id") <= high))
    yield rows.filter(F.col("batch_id") > high)


def _ingested(spark, folder, **options) -> ingest.Store:
    """Feeds the arrivals in three parts; each run of the stream picks up what is new."""
    store = ingest.Store(work.new_folder(spark, "stream"), key_buckets=8).prepare(spark)
    source, checkpoint = store.path("source"), store.path("checkpoint")
    for part in _parts(spark, folder):
        part.select(*_COLUMNS).write.mode("append").parquet(source)
        stream = files.read_event_stream(spark, source, _ARRIVALS, 1_000_000)
        ingest.start_ingest(stream, store, checkpoint, T.now(), **options).awaitTermination()
    return store


cte(
    "stream_rows",
    """
    SELECT l.*, CASE WHEN batch_id <= DATE '2024-01-10' THEN 0 WHEN batch_id <= DATE '2024-01-20' THEN 1 ELSE 2 END AS part FROM ledger l
    """,
)
cte(
    "stream_marks",
    """
    SELECT tenant_id, metric, customer_ref, period_start, part,
           max(newest) OVER (PARTITION BY tenant_id, metric, customer_ref, period_start ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior
    FROM (SELECT tenant_id, metric, customer_ref, period_start, part, max(ts) AS newest FROM stream_rows GROUP BY ALL)
    """,
)
cte(
    "stream_classed",
    """
    SELECT r.*, CASE WHEN prior IS NULL THEN 'first' WHEN ts < prior - INTERVAL 48 HOUR THEN 'very_late' ELSE 'accepted' END AS lateness_class
    FROM stream_rows r JOIN stream_marks USING (tenant_id, metric, customer_ref, period_start, part)
    """,
)


@query("stream_ledger", sql("SELECT idempotency_key, part AS batch_no, lateness_class FROM stream_classed"))
def stream_ledger(spark, folder):
    return _ingested(spark, folder).read(spark, "ledger").select("idempotency_key", "batch_no", "lateness_class")


@query(
    "stream_adjustments",
    sql("SELECT 'late:' || idempotency_key AS id, customer_ref, metric, quantity AS delta FROM stream_classed WHERE lateness_class = 'very_late'"),
)
def stream_adjustments(spark, folder):
    return _ingested(spark, folder).read(spark, "adjustments").select("id", "customer_ref", "metric", "delta")


# metrics with a window of their own: hours by metric, 48 for all others
_HOURS = {"click": 12, "view": 96}
cte(
    "stream_classed_by_metric",
    """
    SELECT r.*, CASE WHEN prior IS NULL THEN 'first'
                     WHEN ts < prior - (CASE metric WHEN 'click' THEN INTERVAL 12 HOUR WHEN 'view' THEN INTERVAL 96 HOUR ELSE INTERVAL 48 HOUR END)
                     THEN 'very_late' ELSE 'accepted' END AS lateness_class
    FROM stream_rows r JOIN stream_marks USING (tenant_id, metric, customer_ref, period_start, part)
    """,
)


@query(
    "stream_adjustments_by_metric",
    sql(
        "SELECT 'late:' || idempotency_key AS id, customer_ref, metric, quantity AS delta FROM stream_classed_by_metric WHERE lateness_class = 'very_late'"
    ),
)
def stream_adjustments_by_metric(spark, folder):
    own = F.lit(48)
    for metric, window in _HOURS.items():
        own = F.when(F.col("metric") == metric, window).otherwise(own)
    lateness = F.make_dt_interval(F.lit(0), own)
    return _ingested(spark, folder, lateness=lateness).read(spark, "adjustments").select("id", "customer_ref", "metric", "delta")


@query(
    "stream_counters",
    sql(
        """
        SELECT tenant_id, metric, customer_ref, period_start, last_day(period_start) AS period_end, CAST(sum(quantity) AS DECIMAL(38,6)) AS agg_sum,
               CAST(coalesce(max(quantity) FILTER (WHERE lateness_class <> 'very_late'), 0) AS DECIMAL(20,6)) AS agg_max,
               CAST(arg_max(quantity, (ts, quantity)) FILTER (WHERE lateness_class <> 'very_late') AS DECIMAL(20,6)) AS agg_last,
               max(ts) FILTER (WHERE lateness_class <> 'very_late') AS watermark_ts
        FROM stream_classed GROUP BY ALL
        """
    ),
)
def stream_counters(spark, folder):
    return ingest.current_counters(spark, _ingested(spark, folder))


@query(
    "stream_alerts",
    sql(
        """
        SELECT alert_config_id, min(part) AS first_batch FROM (
          SELECT part, 'r0' AS alert_config_id, sum(quantity) FILTER (WHERE tenant_id = 't0' AND metric = 'click') AS value, 100 AS threshold
            FROM (SELECT p.part, q.tenant_id, q.metric, q.quantity FROM (VALUES (0), (1), (2)) AS p(part) JOIN stream_rows q ON q.part <= p.part) GROUP BY part
          UNION ALL
          SELECT part, 'r1', sum(quantity) FILTER (WHERE tenant_id = 't1'), 500
            FROM (SELECT p.part, q.tenant_id, q.metric, q.quantity FROM (VALUES (0), (1), (2)) AS p(part) JOIN stream_rows q ON q.part <= p.part) GROUP BY part
          UNION ALL
          SELECT part, 'r2', sum(quantity) FILTER (WHERE tenant_id = 't2' AND metric = 'view'), 1000
            FROM (SELECT p.part, q.tenant_id, q.metric, q.quantity FROM (VALUES (0), (1), (2)) AS p(part) JOIN stream_rows q ON q.part <= p.part) GROUP BY part)
        WHERE value >= threshold GROUP BY ALL
        """
    ),
)
def stream_alerts(spark, folder):
    """The batch in which each rule fired; the cooldown keeps the later ones silent."""
    rules = T.frame(spark, _RULES, schemas.ALERT_CONFIGS)
    fired = _ingested(spark, folder, alert_configs=rules).read(spark, "alerts")
    return fired.groupBy("alert_config_id").agg(F.min("batch_no").alias("first_batch"))


# ---- windows ----------------------------------------------------------------


def _window(size: str) -> str:
    return f"time_bucket(INTERVAL '{size}', ts)"


@query(
    "events_5min",
    sql(f"SELECT {_window('5 minutes')} AS window_start, {_window('5 minutes')} + INTERVAL 5 MINUTE AS window_end, metric, count(*) AS n_events FROM plain GROUP BY ALL"),
)
def events_5min(spark, folder):
    return windows.event_counts(T.plain_events(spark, folder))


def _plain_stream(spark, folder):
    """The events as a stream of files that Spark wrote."""
    source = work.new_folder(spark, "plain")
    T.plain_events(spark, folder).drop("period_start", "batch_id").write.parquet(source)
    schema = (
        f"seq bigint, tenant_id string, metric string, customer_ref string, quantity {schemas.QTY}, ts timestamp, "
        "idempotency_key string, inserted_at timestamp"
    )
    return files.read_event_stream(spark, source, schema, 3)


def _merged(spark, stream, partial, keys, **how):
    path = work.new_folder(spark, "partials")
    windows.keep_partials(stream, partial, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return windows.merge_partials(spark, f"{path}/rows", keys, **how)


@query(
    "stream_event_counts",
    sql(f"SELECT {_window('5 minutes')} AS window_start, {_window('5 minutes')} + INTERVAL 5 MINUTE AS window_end, metric, count(*) AS n_events FROM plain GROUP BY ALL"),
)
def stream_event_counts(spark, folder):
    keys = ["window_start", "window_end", "metric"]
    return _merged(spark, _plain_stream(spark, folder), windows.event_counts, keys, add=("n_events",))


def _usage_windows(size):
    def build(spark, folder):
        return _merged(
            spark, _plain_stream(spark, folder), lambda batch: windows.usage_windows(batch, size),
            ["window_start", "tenant_id", "metric", "customer_ref"], add=("agg_sum", "n_events"), greatest=("agg_max",),
        )

    return build


for _name, _size in (("stream_usage_windows", "1 day"), ("stream_usage_windows_hour", "1 hour"), ("stream_usage_windows_minute", "1 minute")):
    query(
        _name,
        sql(
            f"""
            SELECT {_window(_size)} AS window_start, tenant_id, metric, customer_ref, CAST(sum(quantity) AS DECIMAL(38,6)) AS agg_sum,
                   CAST(max(quantity) AS DECIMAL(20,6)) AS agg_max, count(*) AS n_events FROM plain GROUP BY ALL
            """
        ),
    )(_usage_windows(_size))


@query(
    "stream_dedup_bounded",
    sql("SELECT metric, count(DISTINCT idempotency_key) AS n_events FROM keyed GROUP BY ALL"),
)
def stream_dedup_bounded(spark, folder):
    """Distinct keys of a stream with copies, when the horizon spans the data."""
    from tallymill.functions.identity import idempotency_key

    source = work.new_folder(spark, "copies")
    T.arrivals(spark, folder).select(*_COLUMNS).write.parquet(source)
    keyed = files.read_event_stream(spark, source, _ARRIVALS, 3).withColumn("idempotency_key", idempotency_key())
    path = work.new_folder(spark, "dedup")
    run = (
        ingest.drop_duplicates_bounded(keyed, "60 days")
        .select("metric", "idempotency_key")
        .writeStream.option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .format("parquet")
        .start(f"{path}/rows")
    )
    run.awaitTermination()
    return spark.read.parquet(f"{path}/rows").groupBy("metric").agg(F.count("*").alias("n_events"))


@query(
    "drift_windows",
    sql(
        """
        SELECT *, CASE WHEN max_pct > 0.005 THEN 'critical' ELSE 'warning' END AS severity FROM (
          SELECT time_bucket(INTERVAL '15 minutes', created_at) AS window_start, tenant_id, subscription_item_id,
                 CAST(max(diff) AS DECIMAL(38,6)) AS max_abs, max(drift_pct) AS max_pct
          FROM (SELECT *, CAST(period_start AS TIMESTAMP) + to_minutes(length(subscription_item_id) * 6) AS created_at FROM reports) GROUP BY ALL)
        WHERE max_pct > 0.005 OR max_abs > 1.0
        """
    ),
)
def drift_windows(spark, folder):
    at = F.col("period_start").cast("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.length("subscription_item_id") * 6
    )
    return windows.drift_alarms(found_reports(spark, folder).withColumn("created_at", at))


@query(
    "arrival_lag",
    sql(
        """
        SELECT time_bucket(INTERVAL '5 minutes', inserted_at) AS window_start, quantile_cont(lag, 0.5) AS p50, quantile_cont(lag, 0.95) AS p95, count(*) AS n_events
        FROM (SELECT inserted_at, CAST(floor(epoch(inserted_at)) - floor(epoch(ts)) AS BIGINT) AS lag FROM plain) GROUP BY ALL
        """
    ),
)
def arrival_lag(spark, folder):
    return windows.arrival_lag(T.plain_events(spark, folder), exact=True)


@query(
    "stream_arrival_lag",
    sql(
        """
        SELECT time_bucket(INTERVAL '5 minutes', inserted_at) AS window_start, quantile_disc(lag, 0.5) AS p50, quantile_disc(lag, 0.95) AS p95, count(*) AS n_events
        FROM (SELECT inserted_at, CAST(floor(epoch(inserted_at)) - floor(epoch(ts)) AS BIGINT) AS lag FROM plain) GROUP BY ALL
        """
    ),
)
def stream_arrival_lag(spark, folder):
    """Quantiles of lags from sketches of micro-batches, merged on reading; events may arrive at any time."""
    merged = _merged(spark, _plain_stream(spark, folder), windows.lag_sketches, ["window_start"], add=("n_events",), sketches=("lags",))
    return windows.lag_of_sketches(merged)


_STAGE = {"click": "past_due", "view": "email_sent", "purchase": "retry_scheduled", "error": "blocked", "signup": "recovered"}
cte(
    "stages",
    "SELECT tenant_id, customer_ref, ts, seq AS id, CASE metric "
    + " ".join(f"WHEN '{m}' THEN '{s}'" for m, s in _STAGE.items()) + " END AS stage FROM plain",
)
_STATE = """
    SELECT tenant_id, customer_ref, CASE WHEN c IS NULL THEN 'active' WHEN c.stage = 'recovered' THEN 'recovered'
           WHEN later IS NOT NULL THEN later ELSE 'past_due' END AS state, c.ts AS since
    FROM (SELECT tenant_id, customer_ref, c, (SELECT arg_max(stage, (ts, id)) FROM stages s WHERE s.tenant_id = b.tenant_id AND s.customer_ref = b.customer_ref
                 AND (s.ts, s.id) > (b.c.ts, b.c.id)) AS later
          FROM (SELECT tenant_id, customer_ref, arg_max({'ts': ts, 'id': id, 'stage': stage}, (ts, id)) FILTER (WHERE stage IN ('past_due', 'recovered')) AS c
                FROM stages GROUP BY ALL) b)
"""


def _stage_rows(events):
    stage = None
    for metric, name in _STAGE.items():
        stage = F.when(F.col("metric") == metric, name) if stage is None else stage.when(F.col("metric") == metric, name)
    return events.select("tenant_id", "customer_ref", "ts", F.col("seq").alias("id"), stage.alias("stage"))


@query("billing_state", sql(_STATE))
def billing_state(spark, folder):
    return windows.billing_state(_stage_rows(T.plain_events(spark, folder)))


@query("stream_billing_state", sql(_STATE))
def stream_billing_state(spark, folder):
    marks = _merged(
        spark, _plain_stream(spark, folder), lambda batch: windows.billing_marks(_stage_rows(batch)),
        ["tenant_id", "customer_ref"], greatest=("control", "step"),
    )
    return windows.state_of_marks(marks)
