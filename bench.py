"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tallymill.plans import catalog
from tallymill.session import local_session

HEADLINE = [
    "ingest_validate",
    "dedup_ledger",
    "counters",
    "counters_by_month",
    "usage_history_day",
    "lateness_class",
    "counters_adjusted",
    "reaggregate",
    "line_items",
    "invoices",
    "projection",
    "proration",
    "item_split",
    "credit_burn",
    "backfill_accounting",
    "replay_dry_run",
    "push_plan",
    "recon_reports",
    "suggested_adjustments",
    "alerts_threshold",
    "scenario_compare",
    "batch_rollup",
    "pricing_study",
    "billing_state",
    "events_5min",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    # one untimed run starts the executors and compiles the common code
    queries["counters"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    line = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
