"""Grants, plan changes, reconciliation, alerts, scenarios, files, streams."""

import json
import random
from datetime import date, datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallymill import schemas
from tallymill.operators import alerts, backfill, recon, scenarios, validate, whatif
from tallymill.plans.tables import frame
from tallymill.schemas import RATED_QTY, SUM
from tallymill.sources import files, sinks
from tallymill.streaming import ingest, windows

GRANTS = f"id string, position int, tenant_id string, customer_ref string, amount {schemas.QTY}, valid_from date, valid_to date, rollover boolean"


def burned(spark, usage, grants, days, boundaries):
    start = date(2024, 1, 1)
    daily = frame(spark, [("t", "c", start + timedelta(days=i), str(q)) for i, q in enumerate(usage) if q], f"tenant_id string, customer_ref string, day date, quantity {SUM}")
    rows = frame(
        spark,
        [(f"g{i}", i, "t", "c", str(a), start + timedelta(days=f), start + timedelta(days=t), r) for i, (a, f, t, r) in enumerate(grants)],
        GRANTS,
    )
    got = whatif.burn_grants(daily, rows, start, days, [start + timedelta(days=b) for b in boundaries])
    totals = whatif.burn_totals(got).first()
    return totals, {r.id: r for r in whatif.grant_ledger(got, rows).collect()}


def test_credit_lifecycle_of_the_demo(spark):
    totals, grants = burned(spark, [1500] * 40, [(50000, 0, 30, True), (20000, 10, 40, False)], 40, [30])
    assert (totals.usage_total, totals.burned_total, totals.overage_total) == (60000, 60000, 0)
    # grant a covers 31 days (46,500) and rolls 3,500 over at the end; grant b covers nine days
    assert (grants["g0"].burned, grants["g0"].remaining, grants["g0"].rolled) == (46500, 3500, 3500)
    assert (grants["g1"].burned, grants["g1"].remaining, grants["g1"].expired) == (13500, 6500, 0)


# usage per day, grants (amount, first day, last day, rolls over), days, check days, overage, per grant (burned, rolled, expired, remaining)
BURNS = [
    # the older grant is empty in the middle of day 2, the younger one in the middle of day 5
    ([4] * 10, [(10, 0, 4, False), (12, 2, 6, True)], [6], 18, [(10, 0, 0, 0), (12, 0, 0, 0)]),
    # of equal days, the one that is lost burns first; the other rolls over on day 5 and burns from day 6
    ([1] * 12, [(5, 0, 3, False), (9, 0, 3, True)], [5], 2, [(4, 0, 1, 0), (6, 9, 0, 3)]),
    # what is left after the window rolls over or is lost
    ([0, 2, 0, 0, 0], [(7, 0, 2, True), (3, 1, 3, False)], [], 0, [(2, 5, 0, 5), (0, 0, 3, 0)]),
]


@pytest.mark.parametrize("usage, grants, checks, over, want", BURNS)
def test_credit_burn(spark, usage, grants, checks, over, want):
    totals, ledger = burned(spark, usage, grants, len(usage), checks)
    assert (totals.usage_total, totals.overage_total, totals.burned_total) == (sum(usage), over, sum(w[0] for w in want))
    got = [ledger[f"g{k}"] for k in range(len(grants))]
    assert [(r.burned, r.rolled, r.expired, r.remaining) for r in got] == want


def test_item_split_at_a_mid_month_swap(spark):
    usage = frame(
        spark, [("c", "m", "2", datetime(2024, m, d), date(2024, m, 1)) for m, d in [(1, 3), (1, 20), (2, 1), (3, 9), (3, 10)]],
        f"customer_ref string, metric string, quantity {schemas.QTY}, ts timestamp, period_start date",
    )
    changes = frame(spark, [("c", datetime(2024, 1, 10), "si_a"), ("c", datetime(2024, 3, 9, 12), "si_b")], "customer_ref string, changed_at timestamp, item string")
    got = {(r.period_start.month, r.item): r.n_events for r in whatif.split_by_item(usage, changes).collect()}
    assert got == {(1, None): 1, (1, "si_a"): 1, (2, "si_a"): 1, (3, "si_a"): 1, (3, "si_b"): 1}


REPORTS = f"tenant_id string, subscription_item_id string, period_start date, metric string, local_total {SUM}, stripe_total {SUM}, diff {SUM}, drift_pct double, status string"


def test_drift_summary_example(spark):
    day = date(2025, 1, 1)
    rows = [("t", f"si_{i}", day, "api_calls", a, b, "0", 0.0, "ok") for i, (a, b) in enumerate([("50000", "49900"), ("30000", "29900"), ("20000", "20000")])]
    rows.append(("t", "si_9", day, "gb_transfer", "512", "520", "8", 0.0, "ok"))
    maps = frame(spark, [("t", r[1], r[3], True) for r in rows], "tenant_id string, subscription_item_id string, metric string, active boolean")
    summary = recon.drift_summary(frame(spark, rows, REPORTS), maps, "t", "2025-01", "2025-03")
    total = recon.drift_total(summary).first()
    assert (total.local, total.stripe, total.drift_abs, total["items"], total.metrics) == (100512, 100320, 192, 4, 2)
    gate = recon.parity_gate(recon.drift_total(summary)).first()
    assert gate.passed and gate.label == "parity"
    with pytest.raises(ValueError):
        recon.drift_summary(frame(spark, rows, REPORTS), maps, "t", "2025-03", "2025-01")


def test_csv_exports(spark, tmp_path):
    rows = frame(spark, [("t", "si_1", date(2025, 1, 1), "m", "100.5", "100", "0.5", 0.005, "ok")], REPORTS)
    sinks.write_report_csv(rows, str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("part-*.csv")).read_text().splitlines()
    assert text == ["subscription_item_id,period,local,stripe,drift_abs,drift_pct,status", "si_1,2025-01,100.500000,100.000000,0.500000,0.005,ok"]
    maps = frame(spark, [("t", "si_1", "m", True)], "tenant_id string, subscription_item_id string, metric string, active boolean")
    sinks.write_summary_csv(recon.drift_summary(rows, maps, "t", "2025-01", "2025-01"), str(tmp_path / "s"))
    (part,) = (tmp_path / "s").glob("part-*.csv")
    assert [line.split(",")[0] for line in part.read_text().splitlines()] == ["metric", "m", "TOTAL"]


def test_even_split_without_local_usage(spark):
    day = date(2025, 1, 1)
    rows = frame(spark, [("t", "si_1", day, "m", "0", "9", "9", 1.0, "investigate")], REPORTS)
    customers = frame(spark, [("t", "si_1", day, "m", c, "0") for c in "abc"], f"tenant_id string, subscription_item_id string, period_start date, metric string, customer_ref string, quantity {SUM}")
    assert [r.delta for r in recon.suggestions(rows, customers).collect()] == [D(3)] * 3


COUNTERS = f"tenant_id string, metric string, customer_ref string, period_start date, agg_sum {SUM}"


def test_spike_needs_a_month_before(spark):
    counters = frame(spark, [("t", "m", "c", date(2025, 2, 1), "10"), ("t", "m", "c", date(2025, 3, 1), "30")], COUNTERS)
    rules = frame(spark, [("r", "t", None, "m", "spike", "3", "email", "{}", True), ("off", "t", None, None, "budget", "1", "email", "{}", False)], schemas.ALERT_CONFIGS)
    assert [r.period_start for r in alerts.evaluate(rules, counters).collect()] == [date(2025, 3, 1)]
    assert alerts.evaluate(rules, counters, "2025-02-01").count() == 0


def test_caps_at_all_grains(spark):
    caps = frame(spark, [("t", "*", "m", True, False), ("t", "c", "*", False, True)], "tenant_id string, customer_ref string, metric string, hard boolean, soft boolean")
    events = frame(spark, [("t", "c", "m"), ("t", "c", "n"), ("t", "d", "n"), ("u", "c", "m")], "tenant_id string, customer_ref string, metric string")
    got = [r.cap for r in alerts.enforce_caps(events, caps).orderBy("tenant_id", "customer_ref", "metric").collect()]
    assert got == ["reject", "warn", None, None]


# 12 seats at 8 are 96, more than the minimum; 25 units are three packages of 10 at 6
FLAT_PACKAGE = {
    "metadata": {"name": "seats and bundles", "version": "2"},
    "inputs": {
        "customerId": "k1", "periodStart": "2024-05-01", "periodEnd": "2024-05-31", "taxRate": 5,
        "usageItems": [
            {"metric": "desks", "quantity": 12, "priceConfig": {"unitPrice": 8, "model": "flat", "minimumCharge": 40, "currency": "EUR"}},
            {"metric": "packs", "quantity": 25, "priceConfig": {"packageSize": 10, "unitPrice": 6, "model": "package", "currency": "EUR"}},
        ],
    },
}
TIERED = {
    "inputs": {
        "customerId": "c", "periodStart": "2024-01-01", "periodEnd": "2024-01-31",
        "commitments": [{"amount": 3, "startDate": "2024-01-01", "endDate": "2024-06-30", "applied": 0}, {"amount": 50, "startDate": "2024-03-01", "endDate": "2024-06-30", "applied": 0}],
        "credits": [{"amount": 2, "reason": "r"}, {"amount": 7, "reason": "r", "expiresAt": "2024-01-02"}],
        "usageItems": [
            {"metric": "api_calls", "quantity": 3500, "priceConfig": {"model": "tiered", "currency": "USD", "tiers": [{"upTo": 1000, "unitPrice": 0.1}, {"upTo": None, "unitPrice": 0.05}]}}
        ],
    },
    "expected": {"total": 260, "lineItems": [{"metric": "api_calls", "quantity": 3500, "unitPrice": 0.06}, {"metric": "gone", "quantity": 1}]},
}


def test_scenario_files(spark, tmp_path):
    (tmp_path / "flat-package.sim.json").write_text(json.dumps(FLAT_PACKAGE, indent=1))
    (tmp_path / "seeded.sim.json").write_text(json.dumps(TIERED, indent=1))
    lines = [{"metric": "desks", "quantity": 12, "unitPrice": 8, "subtotal": 96}, {"metric": "packs", "quantity": 25, "unitPrice": 6, "subtotal": 18}]
    expected = {"subtotal": 114, "tax": 5.7, "total": 119.7, "currency": "EUR", "lineItems": lines}
    (tmp_path / "flat-package.expected.json").write_text(json.dumps(expected))
    rows = files.read_scenarios(spark, str(tmp_path))
    done = scenarios.simulate(rows)
    got = {r.name: r.invoice for r in done.collect()}
    assert (got["flat-package"].subtotal, got["flat-package"].tax, got["flat-package"].total) == (114, D("5.7"), D("119.7"))
    # 225 less the active commitment of 3 and the valid credit of 2
    assert (got["seeded"].subtotal, got["seeded"].credits, got["seeded"].total) == (225, 5, 220)
    texts = {r.text for r in scenarios.difference_rows(scenarios.compare(done).filter("name = 'seeded'")).collect()}
    assert texts == {"total: expected 260, got 220", 'lineItem.gone: expected {"metric":"gone","quantity":1.000000}, got null'}
    paired = scenarios.pair_expected(rows, files.read_expected(spark, str(tmp_path)))
    assert {r.name: r.status for r in scenarios.report(scenarios.compare(scenarios.simulate(paired))).collect()}["flat-package"] == "OK"


CSV = '''tenantId,metric,customerRef,quantity,ts,source,meta
acme,calls,k1,70,2024-04-03T08:30:00Z,import,"{""zone"":""north""}"

 acme , calls ,k2, 35 ,2024-04-09T12:00:00Z,,
acme,calls,k2,35,2024-04-09T12:00:00Z,,
acme,calls,k3,12abc,2024-04-09T12:00:00Z,import,
acme,calls,k4,5,2024-05-02T00:00:00Z,import,
'''


def test_import_of_a_csv_file(spark, tmp_path):
    (tmp_path / "events.csv").write_text(CSV)
    loaded = files.read_events_csv(spark, str(tmp_path / "events.csv"))
    operation = {"id": "op", "tenant_id": "acme", "metric": "calls", "period_start": date(2024, 4, 1), "period_end": date(2024, 4, 30)}
    done, row = backfill.run_backfill(spark, lambda: loaded, operation, None, datetime(2024, 3, 1))
    got = row.first()
    assert (got.status, got.total_events, got.processed_events, got.failed_events, got.duplicate_events) == ("completed", 5, 2, 1, 1)
    kept = {r.customer_ref: r for r in done.inserted.collect()}
    assert set(kept) == {"k1", "k2"} and kept["k1"].meta == '{"zone":"north"}'
    assert kept["k2"].source == "import" and kept["k2"].meta == "{}"
    again, _ = backfill.run_backfill(spark, lambda: loaded, operation, done.inserted, datetime(2024, 3, 1))
    assert again.accounting.first().duplicate_events == 3


def test_missing_file_is_a_failed_operation(spark, tmp_path):
    operation = {"id": "op", "tenant_id": "t", "metric": "m", "period_start": date(2024, 1, 1)}
    done, row = backfill.run_backfill(spark, lambda: files.read_events_csv(spark, str(tmp_path / "none.csv")), operation, None, datetime(2024, 3, 1))
    assert done is None and row.first().status == "failed" and "none.csv" in row.first().error_message


@pytest.mark.parametrize("name, content", [("a.json", b'[{"tenantId":"t","metric":'), ("b.csv.gz", b"\x1f\x8b\x08no gzip at all")])
def test_unreadable_sources_are_failed_operations(spark, tmp_path, name, content):
    (tmp_path / name).write_bytes(content)
    read = files.read_events_json if name.endswith("json") else files.read_events_csv
    operation = {"id": "op", "tenant_id": "t", "metric": "m", "period_start": date(2024, 1, 1)}
    ended = datetime(2024, 3, 2)
    done, row = backfill.run_backfill(spark, lambda: read(spark, str(tmp_path / name)), operation, None, datetime(2024, 3, 1), lambda: ended)
    got = row.first()
    assert done is None and (got.status, got.total_events, got.completed_at) == ("failed", 0, ended) and got.error_message


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "e.csv").write_text('tenantId,metric,customerRef,quantity,ts,meta\nt,m,"k\n1",3,2024-01-05T00:00:00Z,"{""a"":\n1}"\n')
    (row,) = files.read_events_csv(spark, str(tmp_path / "e.csv"), line_breaks=True).collect()
    assert (row.customer_ref, row.meta, row.errors) == ("k\n1", '{"a":\n1}', [])


def test_large_totals_are_split(spark):
    day = date(2025, 1, 1)
    rows = frame(spark, [("t", "si_1", day, "m", str(3 * 10**13), str(5 * 10**13), str(2 * 10**13), 0.4, "investigate")], REPORTS)
    shares = [("a", str(10**13)), ("b", str(2 * 10**13 - 1)), ("c", "1")]
    customers = frame(spark, [("t", "si_1", day, "m", c, q) for c, q in shares], f"tenant_id string, subscription_item_id string, period_start date, metric string, customer_ref string, quantity {SUM}")
    got = {r.customer_ref: r.delta for r in recon.suggestions(rows, customers).collect()}
    assert got == {"a": D("6666666666666.666667"), "b": D("13333333333332.666667"), "c": D("0.666667")}


def test_scenario_times(spark, tmp_path):
    scenario = {"inputs": {
        "customerId": "k", "periodStart": "2024-01-01T00:00:00Z", "periodEnd": "2024-01-31T23:59:59Z",
        "credits": [{"amount": 3, "expiresAt": "2024-01-31T00:00:00Z"}],
        "usageItems": [{"metric": "m", "quantity": 1, "priceConfig": {"model": "flat", "unitPrice": 9}}],
    }}
    (tmp_path / "a.sim.json").write_text(json.dumps(scenario))
    scenario["inputs"] |= {"periodEnd": "31st of January"}
    (tmp_path / "b.sim.json").write_text(json.dumps(scenario))
    rows = files.read_scenarios(spark, str(tmp_path))
    # the credit ends before the last second of the period
    assert {r.name: r.invoice.total for r in scenarios.simulate(rows).collect()}["a"] == 9
    broken = {(r.scenario, r.path) for r in validate.scenario_violations(rows).collect()}
    assert ("b", "inputs.periodEnd") in broken and ("a", "inputs.periodEnd") not in broken


def test_json_array_and_replay_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"tenantId":"t","metric":"m","customerRef":"c","quantity":1.5,"ts":"2024-01-01T00:00:00Z","meta":{"k":1}},{"tenant_id":"t","metric":"m"}]')
    rows = files.read_events_json(spark, str(tmp_path / "a.json")).orderBy(F.size("errors")).collect()
    assert rows[0].quantity == D("1.5") and rows[0].meta == '{"k":1}' and rows[0].errors == [] and len(rows[1].errors) == 3
    (tmp_path / "r.jsonl").write_text('{"customer":"c","meter":"m","qty":1,"ts":"2025-01-01T00:00:00Z"}\n\n{"customer":"c","meter":"m","qty":"2","ts":"2025-01-01T00:00:00Z","id":"x"}\n')
    rows = files.read_replay_jsonl(spark, str(tmp_path / "r.jsonl"), "tx").orderBy("quantity").collect()
    assert [(r.tenant_id, r.quantity, r.source, r.idempotency_key) for r in rows] == [("tx", D(1), "etl", None), ("tx", D(2), "etl", "x")]


def stream_rows(spark, rows):
    schema = (
        f"seq bigint, tenant_id string, metric string, customer_ref string, resource_id string, quantity {schemas.QTY}, "
        "ts timestamp, meta string, idempotency_key string, source string, inserted_at timestamp"
    )
    return frame(spark, [(i, "t", "m", "c", None, q, ts, None, None, None, ts) for i, (q, ts) in enumerate(rows)], schema)


def test_a_micro_batch_that_runs_twice_counts_once(spark, tmp_path):
    store = ingest.Store(str(tmp_path / "store")).prepare(spark)
    now = F.lit(datetime(2025, 10, 1))
    first = stream_rows(spark, [("5", datetime(2025, 9, 10)), ("5", datetime(2025, 9, 10))])
    second = stream_rows(spark, [("2", datetime(2025, 9, 1)), ("3", datetime(2025, 9, 9)), ("5", datetime(2025, 9, 10))])
    for batch_no, rows in [(0, first), (0, first), (1, second), (1, second)]:
        ingest.ingest_batch(rows, batch_no, store, now)
    counter = ingest.current_counters(spark, store).first()
    assert (counter.agg_sum, counter.agg_max, counter.agg_last) == (10, 5, 5)
    assert store.read(spark, "ledger").count() == 3 and store.read(spark, "adjustments").first().delta == 2


def test_own_keys_are_unique_over_months_and_batches(spark, tmp_path, monkeypatch):
    """Also across snapshots of the counters, one after every second batch here."""
    monkeypatch.setattr(ingest, "COMPACT_EVERY", 2)
    store = ingest.Store(str(tmp_path / "store")).prepare(spark)
    now = F.lit(datetime(2025, 12, 1))
    for batch_no in range(5):
        ts = datetime(2025, 3 + batch_no, 2)
        rows = stream_rows(spark, [("1", ts), ("2", ts), ("4", ts)]).withColumn(
            "idempotency_key", F.when(F.col("quantity") == 1, "own-1").when(F.col("quantity") == 2, F.lit(f"own-{batch_no}-b"))
        )
        ingest.ingest_batch(rows, batch_no, store, now)
    assert store.read(spark, "ledger").filter("idempotency_key = 'own-1'").count() == 1
    sums = {r.period_start.month: r.agg_sum for r in ingest.current_counters(spark, store).collect()}
    assert sums == {3: 7, 4: 6, 5: 6, 6: 6, 7: 6}
    assert store.read(spark, "snapshots").select("batch_no").distinct().count() == 2
    known = store.read(spark, "keys", 4).filter(F.col("bucket").isin([1, 2]))
    assert "PartitionFilters: [" in (text := known._jdf.queryExecution().executedPlan().toString()) and "bucket" in text


def test_late_rows_reach_their_windows(spark, tmp_path):
    """Rows that are far older than all earlier batches count like any other."""
    source = str(tmp_path / "source")
    for k, day in enumerate([20, 3, 11]):
        stream_rows(spark, [("1", datetime(2025, 9, day)), ("2", datetime(2025, 9, 20))]).coalesce(1).write.mode("append").parquet(source)
        stream = files.read_event_stream(spark, source, stream_rows(spark, []).schema.simpleString()[7:-1].replace(":", " "), 1)
        run = windows.keep_partials(stream, lambda batch: windows.usage_windows(batch, "1 day"), f"{tmp_path}/rows", f"{tmp_path}/state")
        run.awaitTermination()
    got = windows.merge_partials(spark, f"{tmp_path}/rows", ["window_start", "metric"], ("agg_sum", "n_events"), ("agg_max",))
    assert {r.window_start.day: (r.agg_sum, r.n_events, r.agg_max) for r in got.collect()} == {3: (1, 1, 1), 11: (1, 1, 1), 20: (7, 4, 2)}


@pytest.mark.parametrize(
    "stages, state",
    [
        (["email_sent"], "active"), (["past_due"], "past_due"), (["past_due", "email_sent", "blocked"], "blocked"),
        (["past_due", "recovered", "blocked"], "recovered"), (["past_due", "blocked", "recovered", "past_due"], "past_due"),
    ],
)
def test_billing_states(spark, stages, state):
    rows = frame(spark, [("t", "c", datetime(2025, 1, 1 + i), i, s) for i, s in enumerate(stages)], "tenant_id string, customer_ref string, ts timestamp, id bigint, stage string")
    assert windows.billing_state(rows).first().state == state
