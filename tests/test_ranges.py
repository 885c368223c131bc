"""Interval joins, as-of joins and pruned re-aggregation, against loops by hand."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallymill import schemas
from tallymill.operators import counters as C
from tallymill.operators import intervals, rating
from tallymill.operators.asof import as_of
from tallymill.operators.bloom import might_hold
from tallymill.plans.tables import frame
from tallymill.sources import sinks

OPEN = date(9999, 12, 31)


def days(rng, n):
    start = date(2020, 1, 1) + timedelta(days=rng.randrange(2000))
    return start, OPEN if n % 7 == 0 else start + timedelta(days=rng.choice([-1, 0, 1, 30, 365, rng.randrange(1500)]))


def test_cover_is_a_partition_of_the_range(spark):
    rng = random.Random(3)
    given = [days(rng, n) for n in range(200)] + [(date(1, 1, 1), OPEN), (date(2024, 1, 1), None), (None, OPEN)]
    rows = spark.createDataFrame(given, "s date, e date").select("s", "e", intervals.cover(F.col("s"), F.col("e")).alias("blocks")).collect()
    first = date(1, 1, 1)
    for r in rows:
        if r.s is None or r.e is None or r.e < r.s:
            assert not r.blocks
            continue
        low, high = (r.s - first).days, (1 << intervals.LEVELS) - 1 if r.e == OPEN else (r.e - first).days
        spans = sorted((b.block << b.level, (b.block + 1) << b.level) for b in r.blocks)
        assert spans[0][0] == low and spans[-1][1] == high + 1 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        assert len(spans) <= (22 if r.e == OPEN else 40)


def test_overlaps_are_those_of_a_loop_each_once(spark):
    rng = random.Random(4)
    held = [(rng.choice("ab"), n, *days(rng, n)) for n in range(120)]
    periods = [(k, n, date(2020 + n // 12, 1 + n % 12, 1)) for k in "abc" for n in range(70)]
    periods = [(k, n, s, s + timedelta(days=27)) for k, n, s in periods]
    left = spark.createDataFrame(held, "k string, position int, start_date date, end_date date")
    right = spark.createDataFrame(periods, "k string, n int, period_start date, period_end date")
    got = rating.active_commitments(left, right, ["k"])
    want = sorted((p, n) for k, p, s, e in held for q, n, a, b in periods if k == q and s <= e and s <= b and e >= a)
    assert sorted((r.position, r.n) for r in got.collect()) == want
    # no filter on the dates runs behind the joins
    assert "end_date" not in "".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)


@pytest.mark.parametrize("partitions, slices", [(1, None), (7, None), (4, "day"), (4, "hour")])
def test_as_of_is_that_of_a_loop_with_a_hot_key(spark, partitions, slices):
    rng = random.Random(5)
    key = lambda: "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
    at = lambda: datetime(2024, 1, 1) + timedelta(minutes=rng.randrange(3000))
    facts = [(key(), at() if n % 19 else None, n, f"v{n}") for n in range(400)]
    points = [(n, key(), at() if n % 23 else None) for n in range(500)] * 2
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = as_of(
            spark.createDataFrame(points, "n int, k string, t timestamp"),
            spark.createDataFrame(facts, "k string, seen timestamp, v int, name string"), ["k"], "t", "seen", ["v", "name"], slices,
        )
        found = sorted(map(tuple, got.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = []
    for n, k, t in points:
        before = [(s, v, name) for fk, s, v, name in facts if k is not None and fk == k and s is not None and t is not None and s <= t]
        want.append((n, k, t, *(max(before)[1:] if before else (None, None))))
    assert found == sorted(want, key=str)


def test_as_of_without_facts_or_points(spark):
    facts = spark.createDataFrame([], "k string, seen timestamp, v int")
    points = spark.createDataFrame([(1, "a", datetime(2024, 1, 1))], "n int, k string, t timestamp")
    assert as_of(points, facts, ["k"], "t", "seen", ["v"]).first().v is None
    assert as_of(points.limit(0), facts, ["k"], "t", "seen", ["v"]).count() == 0


def test_the_bloom_filter_keeps_every_key_and_few_others(spark):
    keys = spark.range(500).select((F.col("id") * 7).alias("id"), F.lit("x").alias("s"))
    rows = spark.range(3500).select("id", F.lit("x").alias("s"))
    kept = {r.id for r in rows.filter(might_hold(keys, ["id", "s"], 1 << 14)).collect()}
    assert {7 * k for k in range(500)} <= kept and len(kept) < 650
    assert rows.filter(might_hold(keys.limit(0), ["id", "s"], 64)).count() == 0
    assert rows.filter(might_hold(keys, ["id", "s"], 64)).count() == 3500


def scanned(df):
    """Rows that the file scans of an executed query put out, by their partition filters."""
    found = []

    def walk(plan):
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(plan.executedPlan())
        if "QueryStage" in name:
            return walk(plan.plan())
        if name.startswith("Scan parquet"):
            found.append((plan.toString(), plan.metrics().apply("numOutputRows").value(), plan.metrics().apply("numFiles").value()))
        children = plan.children()
        for k in range(children.size()):
            walk(children.apply(k))

    df.collect()
    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_reaggregation_reads_the_affected_months_only(spark, tmp_path):
    rows = [
        (f"t{k % 3}", "m", f"c{k % 40}", None, str(k % 9), datetime(2024, m, 1 + k % 25), None, f"k{m}-{k}", "http", datetime(2024, m, 28), date(2024, m, 1))
        for m in range(1, 13) for k in range(200)
    ]
    sinks.append_ledger(frame(spark, rows, schemas.LEDGER), str(tmp_path / "ledger"))
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    touched = ledger.filter((F.col("period_start") == "2024-05-01") & (F.col("customer_ref") == "c7"))
    got = C.reaggregate(ledger, C.affected_keys(touched))
    scans = scanned(got)
    pruned = [(text, n) for text, n, _ in scans if "dynamicpruning" in text]
    assert len(pruned) == 1 and pruned[0][1] == 200
    want = {(r.tenant_id, r.agg_sum) for r in C.build_counters(touched).collect()}
    assert {(r.tenant_id, r.agg_sum) for r in got.collect()} == want and len(want) == 3
