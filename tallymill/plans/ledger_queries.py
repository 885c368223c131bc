"""Ingest, ledger, counters, lateness."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymill.functions import identity
from tallymill.operators import counters as C
from tallymill.operators import dedup, listing, validate
from tallymill.operators.asof import as_of
from tallymill.plans import tables as T
from tallymill.plans.oracle import event_key, sql, values
from tallymill.plans.registry import query
from tallymill.schemas import CKEY, KEY
from tallymill.sources import sinks
from tallymill.sources.work import new_folder, settle

_COUNTER = "tenant_id, metric, customer_ref, period_start, period_end, agg_sum, agg_max, agg_last, watermark_ts"


@query("ingest_validate", sql("SELECT * FROM results"))
def ingest_validate(spark, folder):
    return T.ingested(spark, folder)[1]


@query(
    "ingest_counts",
    sql(
        "SELECT count(*) FILTER (WHERE status = 'accepted') AS accepted, "
        "count(*) FILTER (WHERE status = 'duplicate') AS duplicates, "
        "count(*) FILTER (WHERE status = 'error') AS errors FROM results"
    ),
)
def ingest_counts(spark, folder):
    return dedup.ingest_counts(T.ingested(spark, folder)[1])


@query("event_key", sql(f"SELECT seq, {event_key()} AS idempotency_key FROM arrivals"))
def event_key_query(spark, folder):
    return T.arrivals(spark, folder).select("seq", identity.idempotency_key().alias("idempotency_key"))


@query(
    "batch_keys",
    sql(
        f"""
        SELECT seq, CASE WHEN own IS NOT NULL THEN own WHEN header IS NULL THEN {event_key()}
                         WHEN count(*) FILTER (WHERE own IS NULL AND header IS NOT NULL) OVER (PARTITION BY batch_id) > 1
                         THEN header || ':' || seq ELSE header END AS idempotency_key
        FROM (SELECT *, CASE WHEN metric = 'signup' THEN 'own-' || seq END AS own,
                     CASE WHEN day(batch_id) > 10 THEN 'batch-' || batch_id END AS header FROM arrivals)
        """
    ),
)
def batch_keys(spark, folder):
    """Own key, else the key of the batch (days after the 10th carry one), else the generated key."""
    rows = (
        T.arrivals(spark, folder)
        .withColumn("idempotency_key", F.when(F.col("metric") == "signup", F.concat(F.lit("own-"), F.col("seq").cast("string"))))
        .withColumn(
            "header",
            F.when(F.dayofmonth("batch_id") > 10, F.concat(F.lit("batch-"), F.col("batch_id").cast("string"))),
        )
    )
    return dedup.with_keys(rows, batch_key="header").select("seq", "idempotency_key")


@query(
    "key_format",
    sql(
        f"""
        SELECT seq, {event_key()} AS event_key,
               regexp_matches({event_key()}, '^evt_[a-f0-9]{{16}}$') AS valid_event,
               regexp_matches('push:' || md5(tenant_id) || ':si_' || metric || ':' || batch_id || ':' || quantity,
                 '^push:[a-f0-9-]+:si_[a-zA-Z0-9]+:\\d{{4}}-\\d{{2}}-\\d{{2}}:\\d+\\.\\d{{6}}$') AS valid_push,
               quantity >= 0 AS valid_timed, quantity >= 0 AS valid_shadow, false AS valid_other
        FROM arrivals
        """
    ),
)
def key_format(spark, folder):
    a = T.arrivals(spark, folder)
    def push(shadow):
        item = F.concat(F.lit("si_"), F.col("metric"))
        return identity.push_key(F.md5("tenant_id"), item, F.col("batch_id"), F.col("quantity"), F.lit(shadow))

    timed = F.concat_ws(":", push(False), F.col("seq").cast("string"))
    return a.select(
        "seq",
        identity.idempotency_key().alias("event_key"),
        identity.is_valid_key(identity.idempotency_key()).alias("valid_event"),
        identity.is_valid_key(push(False)).alias("valid_push"),
        identity.is_valid_key(timed).alias("valid_timed"),
        identity.is_valid_key(push(True)).alias("valid_shadow"),
        identity.is_valid_key(F.concat(F.lit("own:"), push(False))).alias("valid_other"),
    )


@query(
    "ingest_meta_limit",
    sql(
        f"""
        SELECT error, count(*) AS n_events FROM (
          SELECT CASE WHEN quantity <= 0 THEN 'quantity: must be positive' WHEN source = 'bogus' THEN 'source: unknown value'
                      WHEN ts > TIMESTAMP '{T.NOW}' + INTERVAL 1 HOUR THEN '{validate.FUTURE_MESSAGE}'
                      WHEN seq % 9 = 4 THEN '{validate.META_MESSAGE}' END AS error FROM arrivals)
        GROUP BY ALL
        """
    ),
)
def ingest_meta_limit(spark, folder):
    """Every ninth arrival with meta one byte over the limit, the next with meta at the limit."""
    meta = F.when(F.col("seq") % 9 == 4, F.repeat(F.lit("m"), 4097)).when(F.col("seq") % 9 == 5, F.repeat(F.lit("m"), 4096))
    rows = T.arrivals(spark, folder).withColumn("meta", F.coalesce(meta, "meta"))
    return validate.check_ingest(rows, T.now()).groupBy("error").agg(F.count("*").alias("n_events"))


_LEDGER = (
    "idempotency_key, seq, tenant_id, metric, customer_ref, quantity, ts, source, inserted_at, period_start"
)


@query("dedup_ledger", sql(f"SELECT {_LEDGER} FROM ledger"))
def dedup_ledger(spark, folder):
    return T.ledger(spark, folder).select(*_LEDGER.split(", "))


@query(
    "insert_if_absent",
    sql(
        """
        SELECT idempotency_key, min(seq) AS seq FROM (
          SELECT idempotency_key, arg_min(seq, (inserted_at, seq)) AS seq FROM keyed
          WHERE error IS NULL AND day(batch_id) > 15 GROUP BY ALL)
        WHERE idempotency_key NOT IN (SELECT idempotency_key FROM keyed WHERE error IS NULL AND day(batch_id) <= 15)
        GROUP BY ALL
        """
    ),
)
def insert_if_absent(spark, folder):
    """Arrivals of the second half of each month against a ledger built from the first halves."""
    keyed = dedup.with_keys(validate.check_ingest(T.arrivals(spark, folder), T.now())).filter(F.col("error").isNull())
    early = dedup.first_copies(keyed.filter(F.dayofmonth("batch_id") <= 15), ["inserted_at", "seq"])
    late = keyed.filter(F.dayofmonth("batch_id") > 15)
    return dedup.insert_if_absent(late, early, ["inserted_at", "seq"]).select("idempotency_key", "seq")


@query(
    "duplicate_lookup",
    sql(
        """
        SELECT r.seq, idempotency_key, l.seq AS stored_seq, l.inserted_at AS stored_at
        FROM results r JOIN ledger l USING (idempotency_key) WHERE status = 'duplicate'
        """
    ),
)
def duplicate_lookup(spark, folder):
    accepted, results = T.ingested(spark, folder)
    doubles = results.filter(F.col("status") == "duplicate").select("seq", "idempotency_key")
    found = dedup.resolve_duplicates(doubles, accepted.select("idempotency_key", "seq", "inserted_at"))
    return found.select(
        "seq", "idempotency_key", F.col("stored.seq").alias("stored_seq"), F.col("stored.inserted_at").alias("stored_at")
    )


@query(
    "tenant_guard",
    sql("SELECT tenant_id = 't1' AS allowed, count(*) AS n_rows FROM arrivals GROUP BY ALL"),
)
def tenant_guard(spark, folder):
    own, other = validate.tenant_guard(T.arrivals(spark, folder), "t1")
    count = F.count("*").alias("n_rows")
    return own.agg(count).select(F.lit(True).alias("allowed"), "n_rows").unionByName(
        other.agg(count).select(F.lit(False).alias("allowed"), "n_rows")
    )


@query(
    "ledger_scan",
    sql(
        """
        SELECT idempotency_key, customer_ref, quantity, ts FROM plain WHERE tenant_id = 't1' AND metric = 'click'
        AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00'
        """
    ),
)
def ledger_scan(spark, folder):
    return listing.scan_ledger(
        T.plain_events(spark, folder), "t1", "2024-01-05 00:00:00", "2024-01-20 12:00:00", metric="click"
    ).select("idempotency_key", "customer_ref", "quantity", "ts")


_LISTED = "tenant_id = 't2' AND source = 'http' AND ts >= TIMESTAMP '2024-01-03 00:00:00'"


@query(
    "list_events",
    sql(
        f"""
        SELECT idempotency_key, metric, customer_ref, quantity, ts, (SELECT count(*) FROM ledger WHERE {_LISTED}) AS total
        FROM ledger WHERE {_LISTED} ORDER BY ts DESC, idempotency_key LIMIT 25 OFFSET 50
        """
    ),
)
def list_events(spark, folder):
    """The third page of 25, newest first, with the number of all matching events."""
    rows = listing.filter_events(T.ledger(spark, folder), "t2", source="http", start="2024-01-03 00:00:00")
    page = listing.page(rows, "ts", "desc", key="idempotency_key", limit=25, offset=50)
    return listing.with_total(page.select("idempotency_key", "metric", "customer_ref", "quantity", "ts"), rows)


@query(
    "deep_event_page",
    sql("SELECT idempotency_key, metric, customer_ref, quantity, ts FROM ledger ORDER BY ts DESC, idempotency_key LIMIT 100 OFFSET 600"),
)
def deep_event_page(spark, folder):
    """A page far down, found by counts; a few hundred rows are sorted."""
    rows = T.ledger(spark, folder).select("idempotency_key", "metric", "customer_ref", "quantity", "ts")
    return listing.deep_page(settle(rows, "listed"), "ts", "desc", key="idempotency_key", limit=100, offset=600, few=500)


@query(
    "count_events",
    sql("SELECT count(*) AS total FROM ledger WHERE tenant_id = 't0' AND metric = 'view'"),
)
def count_events(spark, folder):
    return listing.count_events(listing.filter_events(T.ledger(spark, folder), "t0", metric="view"))


@query(
    "period_agg",
    sql(
        """
        SELECT CAST(coalesce(sum(quantity), 0) AS DECIMAL(38,6)) AS agg_sum,
               CAST(coalesce(max(quantity), 0) AS DECIMAL(20,6)) AS agg_max,
               CAST(arg_max(quantity, (ts, quantity)) AS DECIMAL(20,6)) AS agg_last FROM shipments
        """
    ),
)
def period_agg(spark, folder):
    return C.period_totals(T.shipments(spark, folder))


@query("counters", sql(f"SELECT {_COUNTER} FROM counters"))
def counters(spark, folder):
    return C.build_counters(T.ledger(spark, folder))


@query("counters_by_month", sql(f"SELECT {_COUNTER} FROM ship_counters"))
def counters_by_month(spark, folder):
    return C.build_counters(T.shipments(spark, folder))


_SETTINGS = values("tenant_id, metric, counter_name, key_fields, lateness_seconds, period_kind", T.SETTING_ROWS)
_WITH_SETTINGS = f"""
    SELECT p.*, coalesce(o.counter_name, a.counter_name, p.metric) AS counter_name,
           coalesce(o.lateness_seconds, a.lateness_seconds, 172800) AS lateness_seconds,
           coalesce(o.period_kind, a.period_kind, 'monthly') AS period_kind,
           coalesce(o.key_fields, a.key_fields) AS key_fields
    FROM {{source}} p
    LEFT JOIN ({_SETTINGS}) o ON o.tenant_id = p.tenant_id AND o.metric = p.metric
    LEFT JOIN ({_SETTINGS}) a ON a.tenant_id = '*' AND a.metric = p.metric
"""


@query(
    "counters_by_setting",
    sql(
        f"""
        SELECT tenant_id, metric, counter_name, customer_ref, period_start,
               CASE WHEN period_kind = 'daily' THEN period_start ELSE last_day(period_start) END AS period_end,
               CAST(sum(quantity) AS DECIMAL(38,6)) AS agg_sum, CAST(max(quantity) AS DECIMAL(20,6)) AS agg_max
        FROM (SELECT * EXCLUDE (period_start), CASE WHEN period_kind = 'daily' THEN CAST(ts AS DATE)
                     ELSE CAST(date_trunc('month', ts) AS DATE) END AS period_start
              FROM ({_WITH_SETTINGS.format(source="plain")}))
        GROUP BY ALL
        """
    ),
)
def counters_by_setting(spark, folder):
    """Daily or monthly counters, as the settings of the metric say."""
    events = T.plain_events(spark, folder).drop("period_start")
    settled = C.with_settings(events, T.metric_settings(spark))
    built = C.build_counters(settled, F.col("period_kind"))
    names = C.with_settings(built.drop("period_kind"), T.metric_settings(spark))
    return names.select("tenant_id", "metric", "counter_name", "customer_ref", "period_start", "period_end", "agg_sum", "agg_max")


@query(
    "configured_keys",
    sql(
        f"""
        SELECT seq, CASE WHEN key_fields IS NULL THEN 'evt_' || substr(sha256(concat_ws('|', tenant_id, metric, customer_ref,
                   'default', strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ'))), 1, 16)
               ELSE 'evt_' || substr(sha256(array_to_string([CASE f
                   WHEN 'tenant_id' THEN tenant_id WHEN 'metric' THEN metric WHEN 'customer_ref' THEN customer_ref
                   WHEN 'meta' THEN meta WHEN 'ts' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') END FOR f IN key_fields], '|')), 1, 16) END
               AS idempotency_key
        FROM ({_WITH_SETTINGS.format(source="arrivals")})
        """
    ),
)
def configured_keys(spark, folder):
    """Keys over the fields that the settings of the metric list."""
    events = C.with_settings(T.arrivals(spark, folder), T.metric_settings(spark))
    parts = {c: F.col(c) for c in ("tenant_id", "metric", "customer_ref", "resource_id", "meta")}
    parts["ts"] = identity.iso_millis(F.col("ts"))
    return events.select("seq", identity.key_from_fields(F.col("key_fields"), parts).alias("idempotency_key"))


def _history(step: str, measure_of: dict[str, str]) -> str:
    return sql(
        f"""
        SELECT metric, bucket, value, CAST(sum(value) OVER (PARTITION BY metric) AS DECIMAL(38,6)) AS total FROM (
          SELECT p.metric, date_trunc('{step}', ts) AS bucket,
                 CAST(CASE m.aggregation WHEN 'max' THEN max(quantity)
                      WHEN 'last' THEN arg_max(quantity, (ts, quantity)) ELSE sum(quantity) END AS DECIMAL(38,6)) AS value
          FROM plain p LEFT JOIN mappings m ON m.tenant_id = p.tenant_id AND m.metric = p.metric AND m.active
          WHERE p.tenant_id = 't1' AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-29'
          GROUP BY p.metric, bucket, m.aggregation)
        """
    )


def _register_history(step: str) -> None:
    @query(f"usage_history_{step}", _history(step, T.AGGREGATION_OF))
    def history(spark, folder):
        rows = listing.usage_history(
            T.plain_events(spark, folder), T.mappings(spark), "t1", "2024-01-02", "2024-01-28", step
        )
        return rows


for _step in ("minute", "hour", "day", "month"):
    _register_history(_step)


@query(
    "accepted_per_metric",
    sql("SELECT metric, count(*) AS n_events FROM results WHERE status = 'accepted' GROUP BY ALL"),
)
def accepted_per_metric(spark, folder):
    return T.ledger(spark, folder).groupBy("metric").agg(F.count("*").alias("n_events"))


@query(
    "affected_keys",
    sql(f"SELECT DISTINCT {', '.join(CKEY)} FROM shipments"),
)
def affected_keys(spark, folder):
    return C.affected_keys(T.shipments(spark, folder))


@query(
    "reaggregate",
    sql(
        f"""
        SELECT {_COUNTER} FROM ship_counters SEMI JOIN (
          SELECT DISTINCT {', '.join(CKEY)} FROM shipments WHERE ts >= TIMESTAMP '2000-01-01'
        ) a USING ({', '.join(CKEY)})
        """
    ),
)
def reaggregate(spark, folder):
    """Counters of the keys that a batch (everything since 2000) touches, folded over the whole ledger."""
    events = T.shipments(spark, folder)
    batch = events.filter(F.col("ts") >= F.lit("2000-01-01").cast("timestamp"))
    return C.reaggregate(events, C.affected_keys(batch))


@query(
    "reaggregate_on_disk",
    sql(
        f"""
        SELECT {_COUNTER} FROM ship_counters SEMI JOIN (
          SELECT DISTINCT {', '.join(CKEY)} FROM shipments
          WHERE ts >= TIMESTAMP '1995-03-01' AND ts < TIMESTAMP '1995-05-01' AND metric <> 'A'
        ) a USING ({', '.join(CKEY)})
        """
    ),
)
def reaggregate_on_disk(spark, folder):
    """Counters of the keys that two months' corrections touch, from a ledger stored by period."""
    path = new_folder(spark, "ledger")
    sinks.append_ledger(T.shipments(spark, folder), path)
    stored = spark.read.parquet(path)
    corrected = stored.filter((F.col("ts") >= "1995-03-01") & (F.col("ts") < "1995-05-01") & (F.col("metric") != "A"))
    return C.reaggregate(stored, C.affected_keys(corrected))


@query(
    "value_as_of",
    sql(
        """
        SELECT k.tenant_id, k.metric, k.customer_ref, k.asked_at, p.ts AS newest_ts, p.quantity
        FROM (SELECT tenant_id, metric, customer_ref, TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST(d AS INTEGER)) AS asked_at
              FROM (SELECT DISTINCT tenant_id, metric, customer_ref FROM plain), range(31) t(d)) k
        ASOF LEFT JOIN (SELECT tenant_id, metric, customer_ref, ts, max(quantity) AS quantity FROM plain GROUP BY ALL) p
        ON p.tenant_id = k.tenant_id AND p.metric = k.metric AND p.customer_ref = k.customer_ref AND k.asked_at >= p.ts
        """
    ),
)
def value_as_of(spark, folder):
    """The newest quantity of every counter at noon of each day of January."""
    events = T.plain_events(spark, folder).select(*KEY, "ts", "quantity")
    days = F.sequence(F.lit("2024-01-01 12:00:00").cast("timestamp"), F.lit("2024-01-31 12:00:00").cast("timestamp"), F.expr("interval 1 day"))
    asked = events.select(*KEY).distinct().select(*KEY, F.explode(days).alias("asked_at"))
    facts = events.withColumn("newest_ts", F.col("ts"))
    return as_of(asked, facts, KEY, "asked_at", "ts", ["newest_ts", "quantity"])


@query(
    "lateness_class",
    sql("SELECT seq, batch_id, prior_watermark, lateness_class FROM classified"),
)
def lateness_class(spark, folder):
    return C.classify_lateness(T.plain_events(spark, folder)).select("seq", "batch_id", "prior_watermark", "lateness_class")


@query(
    "lateness_by_setting",
    sql(
        f"""
        SELECT metric, CASE WHEN prior_watermark IS NULL THEN 'first'
                    WHEN ts < prior_watermark - to_seconds(CAST(lateness_seconds AS INTEGER)) THEN 'very_late' ELSE 'accepted' END AS lateness_class,
               count(*) AS n_events
        FROM ({_WITH_SETTINGS.format(source="classified")}) GROUP BY ALL
        """
    ),
)
def lateness_by_setting(spark, folder):
    events = C.with_settings(T.plain_events(spark, folder), T.metric_settings(spark))
    classes = C.classify_lateness(events, C.settings_lateness())
    return classes.groupBy("metric", "lateness_class").agg(F.count("*").alias("n_events"))


_LATE = """
    SELECT 'late:' || idempotency_key AS id, tenant_id, metric, customer_ref, period_start, quantity AS delta,
           'backfill' AS reason, 'system:late-event' AS actor, 'approved' AS status,
           CAST(NULL AS VARCHAR) AS parent_adjustment_id, inserted_at AS created_at
    FROM classified WHERE lateness_class = 'very_late'
"""


@query("late_adjustments", sql(_LATE))
def late_adjustments(spark, folder):
    return C.late_adjustments(C.classify_lateness(T.plain_events(spark, folder)))


@query(
    "counters_adjusted",
    sql(
        """
        SELECT tenant_id, metric, customer_ref, period_start, last_day(period_start) AS period_end,
               CAST(sum(quantity) AS DECIMAL(38,6)) AS agg_sum,
               CAST(coalesce(max(quantity) FILTER (WHERE lateness_class <> 'very_late'), 0) AS DECIMAL(20,6)) AS agg_max,
               CAST(arg_max(quantity, (ts, quantity)) FILTER (WHERE lateness_class <> 'very_late') AS DECIMAL(20,6)) AS agg_last,
               max(ts) FILTER (WHERE lateness_class <> 'very_late') AS watermark_ts
        FROM classified GROUP BY ALL
        """
    ),
)
def counters_adjusted(spark, folder):
    """In-time usage plus approved late adjustments: the sums equal the sums of all events."""
    return C.counters_after_lateness(C.classify_lateness(T.plain_events(spark, folder)))


@query(
    "reaggregation_reason",
    sql(
        """
        SELECT tenant_id, metric, customer_ref, period_start, batch_id,
               CASE WHEN prior_watermark IS NULL THEN 'initial'
                    WHEN prior_watermark - INTERVAL 48 HOUR > period_start THEN 'late_event' ELSE 'on_time' END AS reason
        FROM marks
        """
    ),
)
def reaggregation_reason(spark, folder):
    return C.reaggregation_reasons(T.plain_events(spark, folder))


@query(
    "reaggregation_counts",
    sql(
        """
        SELECT CASE WHEN prior_watermark IS NULL THEN 'initial'
                    WHEN prior_watermark - INTERVAL 48 HOUR > period_start THEN 'late_event' ELSE 'on_time' END AS reason,
               count(*) AS n_runs FROM marks GROUP BY ALL
        """
    ),
)
def reaggregation_counts(spark, folder):
    reasons = C.reaggregation_reasons(T.plain_events(spark, folder))
    return reasons.groupBy("reason").agg(F.count("*").alias("n_runs"))


@query(
    "upsert_counters",
    sql(
        f"""
        SELECT tenant_id, metric, customer_ref, period_start, last_day(period_start) AS period_end,
               CAST(CASE WHEN bool_or(fresh) THEN sum(quantity) FILTER (WHERE fresh) ELSE sum(quantity) END AS DECIMAL(38,6)) AS agg_sum,
               max(ts) AS watermark_ts
        FROM (SELECT *, ts >= TIMESTAMP '1998-06-15' AS fresh FROM shipments) GROUP BY ALL
        """
    ),
)
def upsert_counters(spark, folder):
    """Counters up to mid June 1998, replaced by counters of later events; the watermark never moves back."""
    events = T.shipments(spark, folder)
    fresh = F.col("ts") >= F.lit("1998-06-15").cast("timestamp")
    columns = CKEY + ["period_end", "agg_sum", "watermark_ts"]
    old = C.build_counters(events.filter(~fresh)).select(*columns)
    new = C.build_counters(events.filter(fresh)).select(*columns)
    return C.upsert(old, new, CKEY, keep_greatest=("watermark_ts",))
