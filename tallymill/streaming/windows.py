"""Tumbling windows and states that merge, for batch frames and streams alike.

On a stream, every micro-batch writes its own partial results (``keep_partials``) and a read adds them up: rows may
come as late as they like, none is dropped behind an engine watermark, and no state is held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.schemas import QTY, SUM

# Stages of a customer's billing state.
STAGES = ["active", "past_due", "email_sent", "retry_scheduled", "blocked", "recovered"]


def event_counts(events: DataFrame, size: str = "5 minutes") -> DataFrame:
    """Events per metric and window."""
    counted = events.groupBy(F.window("ts", size), "metric").agg(F.count("*").alias("n_events"))
    return counted.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "metric", "n_events")


def usage_windows(events: DataFrame, size: str) -> DataFrame:
    """Usage per counter key and window."""
    summed = events.groupBy(F.window("ts", size), "tenant_id", "metric", "customer_ref").agg(
        F.sum("quantity").cast(SUM).alias("agg_sum"),
        F.max("quantity").cast(QTY).alias("agg_max"),
        F.count("*").alias("n_events"),
    )
    return summed.select(F.col("window.start").alias("window_start"), *[c for c in summed.columns if c != "window"])


def drift_alarms(
    reports: DataFrame, size: str = "15 minutes", abs_limit: float = 1.0, pct_limit: float = 0.005
) -> DataFrame:
    """Windows whose largest drift passes a limit: absolute is a warning, relative is critical."""
    peaks = reports.groupBy(F.window("created_at", size), "tenant_id", "subscription_item_id").agg(
        F.max("diff").cast(SUM).alias("max_abs"), F.max("drift_pct").alias("max_pct")
    )
    severity = F.when(F.col("max_pct") > pct_limit, "critical").when(F.col("max_abs") > abs_limit, "warning")
    return (
        peaks.withColumn("severity", severity)
        .filter(F.col("severity").isNotNull())
        .select(F.col("window.start").alias("window_start"), "tenant_id", "subscription_item_id", "max_abs", "max_pct", "severity")
    )


def arrival_lag(events: DataFrame, size: str = "5 minutes", exact: bool = False) -> DataFrame:
    """p50 and p95 of the seconds between event and arrival, per window of arrival.

    The exact form keeps one count per distinct number of seconds; the default is a sketch of fixed size.
    """
    lagged = events.withColumn("_lag", F.unix_timestamp("inserted_at") - F.unix_timestamp("ts"))
    shares = F.array(F.lit(0.5), F.lit(0.95))
    quantiles = F.percentile("_lag", shares) if exact else F.percentile_approx("_lag", shares, 10000).cast("array<double>")
    return (
        lagged.groupBy(F.window("inserted_at", size))
        .agg(quantiles.alias("_q"), F.count("*").alias("n_events"))
        .select(F.col("window.start").alias("window_start"), F.col("_q")[0].alias("p50"), F.col("_q")[1].alias("p95"), "n_events")
    )


def lag_sketches(events: DataFrame, size: str = "5 minutes", k: int = 2000) -> DataFrame:
    """Per window of arrival, the number of events and a quantile sketch of their lags in seconds.

    Sketches of one ``k`` merge in any order (``merge_partials``). Their ranks are exact up to ``k`` events of a window
    and off by about ``2.3 / k`` of all at most beyond that, with a confidence of 99 %.
    """
    lagged = events.withColumn("_lag", F.unix_timestamp("inserted_at") - F.unix_timestamp("ts"))
    return (
        lagged.groupBy(F.window("inserted_at", size))
        .agg(F.kll_sketch_agg_bigint("_lag", k).alias("lags"), F.count("*").alias("n_events"))
        .select(F.col("window.start").alias("window_start"), "lags", "n_events")
    )


def lag_of_sketches(merged: DataFrame) -> DataFrame:
    """p50 and p95 per window: the least lag whose share of events up to it reaches that level."""
    level = lambda q: F.kll_sketch_get_quantile_bigint("lags", F.lit(q))
    return merged.select("window_start", level(0.5).alias("p50"), level(0.95).alias("p95"), "n_events")


def billing_marks(stages: DataFrame) -> DataFrame:
    """The newest opening or closing row and the newest other row per customer, each as one number.

    Microseconds, id and stage make a number of fixed width, so this is a hash aggregate, and two results merge by
    their maxima. Ids are whole numbers below 10^18. Rows without a stage do not count; a stage that is none of
    ``STAGES`` ends the query with its name.
    """
    place = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    stage = F.when(place == 0, F.raise_error(F.concat(F.lit("unknown stage: "), "stage"))).otherwise(place)
    moment = F.unix_micros("ts").cast("decimal(18,0)") * F.lit(str(10**19)).cast("decimal(20,0)")
    code = (moment + F.col("id").cast("decimal(18,0)") * 10 + stage).cast("decimal(38,0)")
    opens = F.col("stage").isin("past_due", "recovered")
    return stages.groupBy("tenant_id", "customer_ref").agg(
        F.max(F.when(opens, code)).alias("control"), F.max(F.when(~opens, code)).alias("step")
    )


def state_of_marks(marks: DataFrame) -> DataFrame:
    """Current state per customer.

    ``past_due`` opens an episode and ``recovered`` closes it; the other stages count only while one is open.
    So the state follows from the last opening or closing and the last other stage.
    """
    names = F.array(*[F.lit(s) for s in STAGES])
    stage = lambda c: F.element_at(names, (F.col(c) % 10).cast("int"))
    state = (
        F.when(F.col("control").isNull(), "active")
        .when(stage("control") == "recovered", "recovered")
        .when(F.coalesce(F.col("step") > F.col("control"), F.lit(False)), stage("step"))
        .otherwise("past_due")
    )
    since = F.timestamp_micros(F.floor(F.col("control") / F.lit(str(10**19)).cast("decimal(20,0)")).cast("bigint"))
    return marks.select("tenant_id", "customer_ref", state.alias("state"), since.alias("since"))


def billing_state(stages: DataFrame) -> DataFrame:
    """State per customer from rows (tenant_id, customer_ref, ts, id, stage)."""
    return state_of_marks(billing_marks(stages))


def keep_partials(stream: DataFrame, partial, path: str, checkpoint: str):
    """Writes ``partial(batch)``, an aggregate of the micro-batch alone, under ``batch_no=<n>``.

    An empty result is written first, so that a read before the first micro-batch finds the columns and no rows.
    """
    nothing = stream.sparkSession.createDataFrame([], stream.schema)
    partial(nothing).write.mode("overwrite").parquet(f"{path}/batch_no=-1")

    def step(batch: DataFrame, batch_no: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/batch_no={batch_no}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_partials(
    spark: SparkSession, path: str, keys: list[str], add: tuple[str, ...] = (), greatest: tuple[str, ...] = (), sketches: tuple[str, ...] = ()
) -> DataFrame:
    """One row per key of what ``keep_partials`` wrote: sums of ``add``, maxima of ``greatest``, merged ``sketches`` of quantiles."""
    rows = spark.read.parquet(path)
    kinds = dict(rows.dtypes)
    return rows.groupBy(*keys).agg(
        *[F.sum(c).cast(kinds[c]).alias(c) for c in add],
        *[F.max(c).alias(c) for c in greatest],
        *[F.kll_merge_agg_bigint(c).alias(c) for c in sketches],
    )
