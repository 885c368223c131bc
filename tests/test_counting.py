"""Deduplication, lateness, adjustments, hot keys."""

import random
from datetime import datetime, timedelta
from decimal import Decimal as D

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymill import schemas
from tallymill.operators import adjustments as A
from tallymill.operators import counters as C
from tallymill.operators import dedup, prefix
from tallymill.operators.joins import attach, lookup
from tallymill.plans.tables import frame

LATE = f"tenant_id string, metric string, customer_ref string, quantity {schemas.QTY}, ts timestamp, idempotency_key string, inserted_at timestamp, batch_id int"


def at(day, hour=0, month=9):
    return datetime(2025, month, day, hour)


def counted(spark, rows, **options):
    events = frame(
        spark, [("t", "api_calls", "cust", q, ts, f"k{i}", ts, batch) for i, (q, ts, batch) in enumerate(rows)], LATE
    ).withColumn("period_start", F.trunc("ts", "MM"))
    classes = C.classify_lateness(events)
    return C.counters_after_lateness(classes, **options).first(), C.late_adjustments(classes).collect()


def test_late_event_within_the_window_is_counted(spark):
    counter, late = counted(spark, [("5", at(10), 1), ("3", at(9), 2)])
    assert counter.agg_sum == 8 and late == []


def test_very_late_event_becomes_an_adjustment(spark):
    rows = [("5", at(10), 1), ("2", at(1), 2)]
    counter, late = counted(spark, rows)
    assert counter.agg_sum == 7 and counter.agg_max == 5 and [r.delta for r in late] == [D(2)]
    assert counted(spark, rows, late_status="pending")[0].agg_sum == 5


def test_early_usage_of_a_long_month_is_kept(spark):
    counter, _ = counted(spark, [("5", at(1), 1), ("6", at(15), 2), ("7", at(29), 3)])
    assert counter.agg_sum == 18 and counter.watermark_ts == at(29) and counter.agg_last == 7


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 600), st.integers(0, 5)), min_size=1, max_size=25))
def test_sum_of_events_equals_counters(spark, rows):
    made = [(str(q), datetime(2025, 9, 1) + timedelta(hours=h), b) for q, h, b in rows]
    counter, late = counted(spark, made)
    assert counter.agg_sum == sum(q for q, _, _ in rows)
    # the same by hand, batch after batch
    mark, too_old = None, []
    for b in sorted({b for _, _, b in made}):
        batch = [(q, ts) for q, ts, n in made if n == b]
        if mark is not None:
            too_old += [D(q) for q, ts in batch if ts < mark - timedelta(hours=48)]
        mark = max([ts for _, ts in batch] + ([mark] if mark else []))
    assert sorted(r.delta for r in late) == sorted(too_old)


def test_newest_quantity_on_ties_and_before_1970(spark):
    rows = [("t", "m", "c", q, ts, "k", ts, 0) for q, ts in [("3", at(5)), ("9.5", at(5)), ("20", at(4))]]
    rows += [("t", "m", "old", q, datetime(1969, 3, d), "k", at(1), 0) for q, d in [("4", 2), ("6.25", 1)]]
    got = {r.customer_ref: r.agg_last for r in C.build_counters(frame(spark, rows, LATE)).collect()}
    assert got == {"c": D("9.5"), "old": D(4)}


ARRIVALS = (
    f"seq bigint, tenant_id string, metric string, customer_ref string, resource_id string, quantity {schemas.QTY}, "
    "ts timestamp, meta string, idempotency_key string, source string, inserted_at timestamp, batch_id int, header string"
)


def arrivals(spark, rows):
    return frame(
        spark,
        [(i, "t", "m", "c", None, q, ts, meta, key, None, at(20), 0, header) for i, (q, ts, meta, key, header) in enumerate(rows)],
        ARRIVALS,
    )


def statuses(results):
    return [r.status for r in results.orderBy("seq").collect()]


def test_normal_duplicate_and_late_case(spark):
    rows = arrivals(spark, [("100", at(10), None, None, None), ("250", at(10, 1), None, None, None), ("100", at(10), None, None, None), ("75", at(9), None, None, None)])
    accepted, results = dedup.ingest(rows, F.lit(at(20)))
    assert statuses(results) == ["accepted", "accepted", "duplicate", "accepted"]
    assert accepted.agg(F.sum("quantity")).first()[0] == 425
    again, repeated = dedup.ingest(rows, F.lit(at(20)), accepted)
    assert again.count() == 0 and set(statuses(repeated)) == {"duplicate"}


def test_rejections(spark):
    big = "x" * 4097
    rows = arrivals(spark, [("1", at(20, 1), None, None, None), ("1", at(20, 2), None, None, None), ("1", at(1), big, None, None), ("-1", at(2), None, None, None), ("1", None, None, None, None)])
    found = [r.error for r in dedup.ingest(rows, F.lit(at(20)))[1].orderBy("seq").collect()]
    assert found == [
        None, "Event timestamp too far in the future", "Meta too large", "quantity: must be positive", "Invalid ISO 8601 date-time format"
    ]


def test_key_precedence(spark):
    keys = lambda rows: [r.idempotency_key for r in dedup.with_keys(arrivals(spark, rows), "header").orderBy("seq").collect()]
    assert keys([("1", at(1), None, "own", "head")]) == ["own"]
    assert keys([("1", at(1), None, None, "head")]) == ["head"]
    assert keys([("1", at(1), None, None, "head"), ("1", at(2), None, None, "head"), ("1", at(3), None, "own", "head")]) == ["head:0", "head:1", "own"]
    assert keys([("1", at(1), None, "", "")])[0].startswith("evt_")


def adjustment_rows(spark, rows):
    names = [f.split()[0] for f in schemas.ADJUSTMENTS.replace("(20,6)", "").split(", ")]
    base = dict.fromkeys(names) | {"tenant_id": "t", "metric": "m", "customer_ref": "c", "period_start": at(1).date(), "reason": "manual", "actor": "a", "created_at": at(1)}
    return frame(spark, [tuple((base | r)[n] for n in names) for r in rows], schemas.ADJUSTMENTS)


def test_only_approved_rows_count(spark):
    rows = adjustment_rows(spark, [{"id": s, "delta": d, "status": s} for s, d in (("pending", "2"), ("approved", "3"), ("reverted", "4"))])
    assert C.fold_adjustments(rows).first().adjusted == 3


def test_lifecycle(spark):
    rows = adjustment_rows(spark, [{"id": "p", "delta": "5", "status": "pending"}])
    ask = frame(spark, [("p", "t", "ops"), ("gone", "t", "ops")], "id string, tenant_id string, requested_by string")
    now = F.lit(at(3))
    approved, outcome, audit = A.approve(ask, rows, now)
    assert {r.id: r.outcome for r in outcome.collect()} == {"p": "approved", "gone": "Not found"}
    assert audit.count() == 1 and C.fold_adjustments(approved).first().adjusted == 5
    assert {r.outcome for r in A.approve(ask, approved, now)[1].collect()} == {"already", "Not found"}
    reverted, reversal, _, _ = A.revert(ask, approved, now)
    assert reversal.first().delta == -5 and reversal.first().parent_adjustment_id == "p"
    assert C.fold_adjustments(reverted.unionByName(reversal)).count() == 0
    assert A.approve(ask, reverted, now)[1].filter("id = 'p'").first().outcome == "Already reverted"


def test_ranged_join(spark):
    rng = random.Random(4)
    facts = frame(spark, [(rng.choice("aaaaaab"), i) for i in range(400)] + [("z", 1000)], "k string, v int")
    dim = frame(spark, [("a", 1), ("b", 2), ("c", 3)], "k string, w int")
    ranged = attach(facts, dim, ["k"], "left", extra=F.col("v") % 2 == F.col("w") % 2)
    assert ranged.count() == 401 and ranged.filter("w IS NOT NULL").count() == facts.join(dim, "k").filter("v % 2 = w % 2").count()
    beyond = lookup(facts, dim, ["k"], "left")
    assert beyond.count() == 401 and beyond.filter("w IS NULL").count() == 1


def test_chunked_prefixes_equal_loops(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), i, rng.randint(-9, 9)) for i in range(200)]
    data = frame(spark, rows, "k string, position int, value int")
    before = {(r.k, r.position): r.out for r in prefix.running_sum(data, ["k"], "position", "value", "out", size=7).collect()}
    peaks = {r.k: (r.total, r.peak) for r in prefix.prefix_totals(data, ["k"], "position", "value", size=7).collect()}
    for key in "ab":
        run, best = 0, None
        for _, position, v in [r for r in rows if r[0] == key]:
            assert before[key, position] == run
            run += v
            best = run if best is None else max(best, run)
        assert peaks[key] == (run, best)


def test_previous_by_value_crosses_ranges(spark):
    values = sorted(random.Random(9).sample(range(10000), 60))
    data = frame(spark, [("k", v, v * 2) for v in values], "k string, v int, w int")
    got = {r.v: r.previous_w for r in prefix.previous_by_value(data, ["k"], "v", ["w"], 7).collect()}
    assert got == {v: (values[i - 1] * 2 if i else None) for i, v in enumerate(values)}


def test_settings_fall_back(spark):
    rows = frame(spark, [("*", "m", "all", None, 10, "daily"), ("t", "m", "own", None, None, None)], schemas.METRIC_SETTINGS)
    events = frame(spark, [("t", "m"), ("u", "m"), ("u", "n")], "tenant_id string, metric string")
    got = {(r.tenant_id, r.metric): (r.counter_name, r.lateness_seconds, r.period_kind) for r in C.with_settings(events, rows).collect()}
    assert got == {("t", "m"): ("own", 10, "daily"), ("u", "m"): ("all", 10, "daily"), ("u", "n"): ("n", 172800, "monthly")}
