"""Names of the queries, their builders and their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.session import pin_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def at_edge(df: DataFrame) -> DataFrame:
    """Results carry zone-free timestamps, like the given tables."""
    return df.select(
        *[F.col(n).cast("timestamp_ntz").alias(n) if t == "timestamp" else F.col(n) for n, t in df.dtypes]
    )


def query(name: str, oracle: str | None = None):
    """Registers ``build(spark, folder)`` under a name."""

    def register(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return at_edge(build(pin_utc(spark), folder))

        run.group = build.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register
