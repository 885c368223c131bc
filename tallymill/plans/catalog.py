"""All registered queries."""

from __future__ import annotations

from tallymill.plans import import_queries, ledger_queries, rating_queries, recon_queries, scenario_queries, stream_queries  # noqa: F401  (they register their queries)
from tallymill.plans.registry import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
