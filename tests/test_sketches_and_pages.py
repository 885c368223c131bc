"""Sketches that merge, pages far down and joins of hot keys, against plain queries."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallymill.operators import listing, sketches
from tallymill.operators.joins import spread
from tallymill.streaming import windows


@pytest.mark.parametrize("direction, spanned", [("asc", 5), ("desc", 4000)])
def test_deep_pages_equal_a_sort(spark, tmp_path, direction, spanned):
    rng = random.Random(spanned)
    start = datetime(2024, 1, 1)
    given = [(f"evt_{rng.randrange(10**6):06d}é{k}", start + timedelta(seconds=rng.randrange(spanned)) if k % 50 else None) for k in range(3000)]
    spark.createDataFrame(given, "id string, ts timestamp").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for offset in (7, 1490, 2970):
        want = [tuple(r) for r in listing.page(rows, "ts", direction, "id", 60, offset).collect()]
        assert [tuple(r) for r in listing.deep_page(rows, "ts", direction, "id", 60, offset, few=70).collect()] == want


def test_deep_page_sorts_few_rows(spark, tmp_path):
    spark.range(20_000).select("id", F.timestamp_seconds(F.col("id") % 5000).alias("ts")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    found = listing.deep_page(rows, "ts", "asc", "id", 25, 15_000, few=100)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in rows.orderBy("ts", "id").offset(15_000).limit(25).collect()]
    # the top-k behind the filter holds at most the rows that were counted last
    text = found._jdf.queryExecution().executedPlan().toString()
    assert int(text.split("TakeOrderedAndProject(limit=")[1].split(",")[0]) <= 100 + 25


def test_deep_page_without_rows_or_order(spark):
    rows = spark.createDataFrame([], "id string, ts timestamp")
    assert listing.deep_page(rows, "ts").count() == 0
    with pytest.raises(ValueError):
        listing.deep_page(rows, "id", key="ts")


def test_lag_sketches_stay_within_their_rank_error(spark):
    base = datetime(2024, 1, 1)
    lags = [random.Random(9).randrange(10**6) for _ in range(3)] + list(range(40_000))
    rows = spark.createDataFrame([(n,) for n in lags], "n long").select(
        (F.lit(base) - F.make_dt_interval(secs=F.col("n"))).alias("ts"), F.lit(base).alias("inserted_at")
    )
    parts = [windows.lag_sketches(rows.filter(F.pmod(F.hash("ts"), F.lit(4)) == k)) for k in range(4)]
    merged = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).groupBy("window_start").agg(
        F.kll_merge_agg_bigint("lags").alias("lags"), F.sum("n_events").alias("n_events")
    )
    got = windows.lag_of_sketches(merged).first()
    assert got.n_events == len(lags) and abs(got.p50 - 20_000) < 200 and abs(got.p95 - 38_000) < 200


def test_a_read_before_the_first_batch_gives_no_rows(spark, tmp_path):
    (tmp_path / "source").mkdir()
    schema = "ts timestamp, inserted_at timestamp"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "source"))
    path = str(tmp_path / "rows")
    windows.keep_partials(stream, windows.lag_sketches, path, str(tmp_path / "checkpoint")).awaitTermination()
    merged = windows.merge_partials(spark, path, ["window_start"], add=("n_events",), sketches=("lags",))
    assert windows.lag_of_sketches(merged).count() == 0


def test_unknown_stages_are_refused(spark):
    rows = [("t", "c", datetime(2024, 1, 1), 1, "past_due"), ("t", "c", datetime(2024, 1, 2), 2, None)]
    schema = "tenant_id string, customer_ref string, ts timestamp, id long, stage string"
    assert windows.billing_state(spark.createDataFrame(rows, schema)).first().state == "past_due"
    with pytest.raises(Exception, match="unknown stage: odd"):
        windows.billing_state(spark.createDataFrame([*rows, ("t", "c", datetime(2024, 1, 3), 3, "odd")], schema)).collect()


def test_item_sketches(spark):
    rng = random.Random(2)
    rows = [
        (rng.choice("ab"), f"i{rng.randrange(300)}", rng.choice(["m", "n"]), date(2024, rng.randrange(1, 7), 1), rng.choice(["ok", "investigate", None]))
        for _ in range(3000)
    ]
    found = spark.createDataFrame(rows, "tenant_id string, subscription_item_id string, metric string, period_start date, status string")
    kept = sketches.item_sketches(found)
    items = lambda metric, months, status: {r[:2] for r in rows if r[2] == metric and r[3].month in months and r[4] in status}
    every, bad = ("ok", "investigate", None), ("investigate",)
    got = {r.metric: (r.items, r.drifting) for r in sketches.items_over(kept, "2024-02", "2024-04").collect()}
    assert got == {m: (len(items(m, (2, 3, 4), every)), len(items(m, (2, 3, 4), bad))) for m in "mn"}
    both = {r.metric: r.items for r in sketches.drifting_in_both(kept, ("2024-01", "2024-01"), ("2024-05", "2024-06")).collect()}
    assert both == {m: len(items(m, (1,), bad) & items(m, (5, 6), bad)) for m in "mn"}
    # a sketch that is full is still close
    many = spark.range(60_000).select(
        F.lit("a").alias("tenant_id"), F.col("id").cast("string").alias("subscription_item_id"), F.lit("m").alias("metric"),
        F.lit(date(2024, 1, 1)).alias("period_start"), F.lit("ok").alias("status"),
    )
    near = sketches.items_over(sketches.item_sketches(many, 12), "2024-01", "2024-01", 12).first()
    assert abs(near.items - 60_000) < 60_000 * 5 / 64 and near.drifting == 0


def test_a_hot_key_is_dealt_over_tasks(spark):
    """Half of all rows have one key; the busiest task of the join reads less than three times the median."""
    facts = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 997).alias("k"))
    counts = facts.groupBy("k").agg(F.count("*").alias("n"))
    dim = counts.select("k", (F.col("k") * 10).alias("v"))
    kept = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for c, v in zip(kept, ("-1", "false", "16")):
        spark.conf.set(c, v)
    try:
        joined = spread(facts, dim, ["k"], counts, "n", ["id"])
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect())
        plain = sorted(r["count"] for r in facts.join(dim, "k").groupBy(F.spark_partition_id().alias("p")).count().collect())
        rows = joined.agg(F.count("*"), F.sum("id"), F.count_if(F.col("v") != F.col("k") * 10)).first()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert tuple(rows) == (40_000, sum(range(40_000)), 0)
    assert sizes[-1] < 3 * sizes[len(sizes) // 2] and plain[-1] > 10 * plain[len(plain) // 2]
