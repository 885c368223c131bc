"""The model's tables, derived from the given Parquet tables.

Every derivation here has the same rule as a common table expression in ``oracle.py``.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallymill import schemas
from tallymill.functions.period import hours, period_start
from tallymill.operators import dedup

NOW = "2024-01-30 00:00:00"
EVENT_TENANTS = ["t0", "t1", "t2"]
EVENT_METRICS = ["click", "view", "purchase", "error", "signup"]
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
FLAGS = ["A", "N", "R"]

_TABLES = {
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}


def frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Literal rows as a local relation, whose size Spark knows."""
    schema = T.StructType.fromDDL(ddl)

    def named(value, kind):
        if value is None:
            return None
        if isinstance(kind, T.StructType):
            return {f.name: named(v, f.dataType) for f, v in zip(kind.fields, value)}
        if isinstance(kind, T.ArrayType):
            return [named(v, kind.elementType) for v in value]
        return Decimal(value) if isinstance(kind, T.DecimalType) else value

    rows = [named(row, schema) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(schema))).to(schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_TABLES[name]).parquet(f"{folder}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Raw usage events as they arrive: every tenth twice, some late, some broken."""
    e = F.col("event_id")
    copies = F.when(e % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    delay = e % 97 + F.when(e % 211 == 0, 240).otherwise(0) + F.col("copy")
    return (
        table(spark, folder, "events")
        .withColumn("copy", F.explode(copies))
        .select(
            (e * 2 + F.col("copy")).alias("seq"),
            F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
            F.col("event_type").alias("metric"),
            F.concat(F.lit("cus_"), F.col("user_id").cast("string")).alias("customer_ref"),
            F.lit(None).cast("string").alias("resource_id"),
            F.when(e % 50 == 7, -1.0).otherwise(F.col("value")).cast(schemas.QTY).alias("quantity"),
            "ts",
            F.col("props").alias("meta"),
            F.lit(None).cast("string").alias("idempotency_key"),
            F.when(e % 50 == 9, "bogus").alias("source"),
            (F.col("ts") + hours(delay.cast("int"))).alias("inserted_at"),
        )
        .withColumn("batch_id", F.to_date("inserted_at"))
    )


def ingested(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return dedup.ingest(arrivals(spark, folder), now())


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """Accepted events of one month."""
    return ingested(spark, folder)[0]


def plain_events(spark: SparkSession, folder: str) -> DataFrame:
    """The events once each, unchecked: unique by customer, metric and millisecond."""
    e = F.col("event_id")
    return table(spark, folder, "events").select(
        e.alias("seq"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"),
        F.col("event_type").alias("metric"),
        F.concat(F.lit("cus_"), F.col("user_id").cast("string")).alias("customer_ref"),
        F.col("value").cast(schemas.QTY).alias("quantity"),
        "ts",
        F.format_string("ev%012d", e).alias("idempotency_key"),
        period_start(F.col("ts")).alias("period_start"),
        (F.col("ts") + hours((e % 97 + F.when(e % 211 == 0, 240).otherwise(0)).cast("int"))).alias("inserted_at"),
    ).withColumn("batch_id", F.to_date("inserted_at"))


def owners(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with their region as tenant and their nation as customer."""
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("customer_ref"), F.col("n_regionkey").alias("r_regionkey")
    )
    region = table(spark, folder, "region").withColumnRenamed("r_name", "tenant_id")
    return table(spark, folder, "customer").join(nation.join(region, "r_regionkey"), "c_nationkey").drop("r_regionkey")


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    """A usage ledger of 83 months: tenant = region, customer = nation, metric = return flag."""
    owned = owners(spark, folder).select("c_custkey", "tenant_id", "customer_ref")
    placed = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"
    )
    # no hints: Spark broadcasts what its size threshold allows and shuffles the rest
    owned = placed.join(owned, "c_custkey").drop("c_custkey")
    return lines.join(owned, "l_orderkey").select(
        "tenant_id",
        F.col("l_returnflag").alias("metric"),
        "customer_ref",
        F.col("l_quantity").cast(schemas.QTY).alias("quantity"),
        F.col("l_shipdate").alias("ts"),
        F.concat_ws(
            ":", F.lit("li"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate")
        ).alias("idempotency_key"),
        period_start(F.col("l_shipdate")).alias("period_start"),
    )


# ---- configuration, as rows that also become VALUES in the DuckDB text -------

AGGREGATION_OF = {
    "click": "sum", "view": "max", "purchase": "last", "error": "sum", "signup": "max",
    "A": "sum", "N": "max", "R": "last",
}


def _item(tenant: str, metric: str) -> str:
    return f"si_{tenant.replace(' ', '')}{metric}"


def mapping_rows(tenants: list[str], metrics: list[str]) -> list[tuple]:
    """(id, tenant, metric, aggregation, account, price, item, currency, active, shadow, shadow account/price/item).

    ``signup`` has no item; ``error`` and ``R`` are shadow mappings, with a shadow item only for the first tenant.
    """
    rows = []
    for tenant in tenants:
        for metric in metrics:
            shadow = metric in ("error", "R")
            target = shadow and tenant == tenants[0]
            rows.append(
                (
                    f"map_{tenant}_{metric}", tenant, metric, AGGREGATION_OF[metric], f"acct_{tenant}",
                    f"price_{metric}", None if metric == "signup" else _item(tenant, metric), "USD", True, shadow,
                    f"acct_test{tenant}" if target else None, f"price_test{metric}" if target else None,
                    f"si_test{tenant.replace(' ', '')}{metric}" if target else None,
                )
            )
    return rows


def mappings(spark: SparkSession, tenants: list[str] = EVENT_TENANTS, metrics: list[str] = EVENT_METRICS) -> DataFrame:
    return frame(spark, mapping_rows(tenants, metrics), schemas.MAPPINGS)


def shipment_mappings(spark: SparkSession) -> DataFrame:
    return mappings(spark, REGIONS, FLAGS)


# metric -> (model, tiers as (up_to, unit, flat), unit price, package size, minimum, maximum)
PRICES = {
    "click": ("tiered", [("100", "1.00", None), ("1000", "0.80", None), (None, "0.60", None)], None, None, "5", None),
    "view": ("volume", [("20", "1.00", None), ("60", "0.80", None), ("0", "0.55", None)], None, None, None, "90"),
    "purchase": ("graduated", [("10", "0.50", "10"), ("40", "0.30", "50"), (None, "0.20", "100")], None, None, None, None),
    "error": ("flat", None, "0.0125", None, "2.5", "40"),
    "signup": ("package", None, "5", "4", None, None),
    "A": ("tiered", [("200", "0.10", None), ("900", "0.08", None), (None, "0.05", None)], None, None, None, None),
    "N": ("volume", [("25", "1.25", None), ("45", "1.10", None), (None, "0.95", None)], None, None, "10", None),
    "R": ("graduated", [("5", "0.75", "2"), ("30", "0.60", "4"), (None, "0.45", "8")], None, None, None, "30"),
}

# pricing options of the studies: option -> metric -> the same tuple
OPTIONS = {
    "current": {m: PRICES[m] for m in FLAGS},
    "option_a": {
        m: ("volume", [("100", "0.12", None), ("500", "0.09", None), (None, "0.06", None)], None, None, None, None)
        for m in FLAGS
    },
    "option_b": {
        m: ("graduated", [("100", "0.05", "25"), ("1000", "0.03", "100"), (None, "0.02", "400")], None, None, None, None)
        for m in FLAGS
    },
}


def _dec(text: str | None) -> Decimal | None:
    return None if text is None else Decimal(text)


def price_struct(price: tuple) -> tuple:
    model, tiers, unit, size, low, high = price
    return (
        model, "USD", None if tiers is None else [tuple(_dec(x) for x in t) for t in tiers],
        _dec(unit), _dec(size), _dec(low), _dec(high),
    )


def price_configs(spark: SparkSession, metrics: list[str] = EVENT_METRICS) -> DataFrame:
    rows = [(m, price_struct(PRICES[m])) for m in metrics]
    return frame(spark, rows, f"metric string, price_config {schemas.PRICE_CONFIG}")


def pricing_options(spark: SparkSession) -> DataFrame:
    rows = [(o, m, price_struct(p)) for o, prices in OPTIONS.items() for m, p in prices.items()]
    return frame(spark, rows, f"option string, metric string, price_config {schemas.PRICE_CONFIG}")


# tenant, metric, counter name, key fields, lateness in seconds, period kind
SETTING_ROWS = [
    ("*", "click", "clicks", ["tenant_id", "metric", "customer_ref", "ts"], 86400, "daily"),
    ("*", "view", "views", ["tenant_id", "metric", "meta"], 172800, "monthly"),
    ("t1", "click", "t1_clicks", ["tenant_id", "customer_ref", "meta"], 259200, "monthly"),
]


def metric_settings(spark: SparkSession) -> DataFrame:
    return frame(spark, SETTING_ROWS, schemas.METRIC_SETTINGS)


def as_date(text: str) -> dt.date:
    return dt.date.fromisoformat(text)
