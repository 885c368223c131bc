"""Readers of event files, replay files, scenario files and the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill.functions.identity import blank_to_null
from tallymill.operators.validate import event_checks
from tallymill.schemas import EXPECTED_FILE, LEDGER, QTY, SCENARIO_FILE, TIER
from tallymill.sources import records

# Accepted column names of an event file, first match wins.
EVENT_COLUMNS = {
    "tenant_id": ["tenantId", "tenant_id"],
    "metric": ["metric"],
    "customer_ref": ["customerRef", "customer_ref"],
    "resource_id": ["resourceId", "resource_id"],
    "quantity": ["quantity"],
    "ts": ["ts", "timestamp", "created_at"],
    "meta": ["meta"],
    "idempotency_key": ["idempotencyKey", "idempotency_key"],
    "source": ["source"],
}
REPLAY_FILE = "id string, customer string, meter string, qty string, ts string, resourceId string, meta string"
BAD_META = "meta: not valid JSON"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The event ledger, in folders per period."""
    return spark.read.schema(LEDGER).parquet(path)


def _named(raw: DataFrame, names: list[str]) -> Column:
    present = [blank_to_null(F.trim(F.col(f"`{n}`"))) for n in names if n in raw.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def normalize_events(raw: DataFrame, source: str = "import") -> DataFrame:
    """Typed events from text columns, with ``errors`` for rows that do not pass.

    Values that do not parse become null and are reported; nothing is guessed.
    """
    named = raw.select(*[_named(raw, names).alias(c) for c, names in EVENT_COLUMNS.items()])
    typed = named.select(
        "tenant_id",
        "metric",
        "customer_ref",
        "resource_id",
        F.col("quantity").try_cast(QTY).alias("quantity"),
        F.try_to_timestamp("ts").alias("ts"),
        F.coalesce("meta", F.lit("{}")).alias("meta"),
        "idempotency_key",
        F.coalesce("source", F.lit(source)).alias("source"),
    )
    bad_meta = F.when(F.try_parse_json("meta").isNull(), F.lit(BAD_META))
    return typed.withColumn("errors", F.array_compact(F.array(*event_checks(), bad_meta)))


def split_valid(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, quarantined rows)."""
    good = F.size("errors") == 0
    return events.filter(good).drop("errors"), events.filter(~good)


_CSV_OPTIONS = {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true", "escape": '"'}


def _csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Text columns of CSV files with a header, split into byte ranges in either way of reading."""
    plain = spark.read.options(header=True, **_CSV_OPTIONS).csv(path)
    if not line_breaks:
        return plain
    found = records.read_records(spark, path, "\n", records.csv_step, plain='"')
    headers = records.first_of_each_file(found)
    body = found.join(headers, ["file", "range", "place"], "left_anti").filter(F.trim(F.regexp_replace("text", r"\s", "")) != "")
    schema = ", ".join(f"`{c}` string" for c in plain.columns)
    return body.select(F.from_csv(F.rtrim(F.col("text"), F.lit("\r")), schema, _CSV_OPTIONS).alias("r")).select("r.*")


def read_events_csv(spark: SparkSession, path: str, line_breaks: bool = False) -> DataFrame:
    """Event CSV with a header; any path that the session's file systems know.

    ``line_breaks``: quoted values may hold line breaks. Files are then read three times, but still split; without it,
    such a record would come apart. Header names themselves hold no line breaks.
    """
    return normalize_events(_csv(spark, path, line_breaks))


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    """Files that hold one JSON array of events each; a file that is none ends the read with an error.

    Arrays are cut into byte ranges at any comma, on one line or many, so a large array is read by several tasks.
    """
    names = [n for names in EVENT_COLUMNS.values() for n in names]
    schema = ", ".join(f"{n} string" for n in names)
    found = records.read_records(spark, path, ",", records.json_step, level=1)
    first = records.first_of_each_file(found).withColumn("first", F.lit(True))
    # the array's own brackets stand in its first and its last element
    opened = F.when(F.col("first"), F.regexp_replace("text", r"^[\s\uFEFF]*\[", "")).otherwise(F.col("text"))
    bare = found.join(first, ["file", "range", "place"], "left").select(
        F.when(F.col("depth") == 0, F.regexp_replace(opened, r"\]\s*$", "")).otherwise(opened).alias("text")
    )
    given = bare.filter(F.regexp_replace("text", r"\s", "") != "")
    # as an array of one, so that anything behind the element is an error too
    one = F.from_json(F.concat(F.lit("["), "text", F.lit("]")), f"array<struct<{schema.replace(' string', ': string')}>>", {"mode": "FAILFAST"})
    return normalize_events(given.select(F.explode(one).alias("r")).select("r.*"))


def _from_replay(rows: DataFrame, tenant: str) -> DataFrame:
    mapped = rows.select(
        F.lit(tenant).alias("tenantId"),
        F.col("meter").alias("metric"),
        F.col("customer").alias("customerRef"),
        "resourceId",
        F.col("qty").alias("quantity"),
        "ts",
        "meta",
        F.col("id").alias("idempotencyKey"),
        F.lit("etl").alias("source"),
    )
    return normalize_events(mapped, "etl")


def read_replay_jsonl(spark: SparkSession, path: str, tenant: str) -> DataFrame:
    return _from_replay(spark.read.schema(REPLAY_FILE).json(path), tenant)


def read_replay_csv(spark: SparkSession, path: str, tenant: str, line_breaks: bool = False) -> DataFrame:
    rows = _csv(spark, path, line_breaks)
    for name in ("id", "resourceId", "meta"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    return _from_replay(rows, tenant)


def _stem(suffix: str) -> Column:
    return F.regexp_replace(F.col("_metadata.file_name"), suffix.replace(".", r"\.") + "$", "")


def price_from_file(price: Column) -> Column:
    tiers = F.transform(
        price["tiers"],
        lambda t: F.struct(
            t["upTo"].alias("up_to"), t["unitPrice"].alias("unit_price"), t["flatPrice"].alias("flat_price")
        ),
    )
    return F.struct(
        price["model"].alias("model"),
        price["currency"].alias("currency"),
        tiers.cast(f"array<{TIER}>").alias("tiers"),
        price["unitPrice"].alias("unit_price"),
        price["packageSize"].alias("package_size"),
        price["minimumCharge"].alias("minimum_charge"),
        price["maximumCharge"].alias("maximum_charge"),
    )


def read_scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Scenario files ``*.sim.json``; the name is the file name without that ending.

    Times keep their time of day; one that cannot be read is null, which the scenario checks report.
    """
    raw = (
        spark.read.schema(SCENARIO_FILE)
        .option("multiLine", True)
        .option("pathGlobFilter", "*.sim.json")
        .json(folder)
    )
    i = F.col("inputs")
    usage = F.transform(
        i["usageItems"],
        lambda u: F.struct(
            u["metric"].alias("metric"), u["quantity"].alias("quantity"),
            price_from_file(u["priceConfig"]).alias("price_config"),
        ),
    )
    commitments = F.transform(
        i["commitments"],
        lambda c: F.struct(
            c["amount"].alias("amount"), c["applied"].alias("applied"),
            F.try_to_timestamp(c["startDate"]).alias("start_date"), F.try_to_timestamp(c["endDate"]).alias("end_date"),
        ),
    )
    credits = F.transform(
        i["credits"],
        lambda c: F.struct(c["amount"].alias("amount"), F.try_to_timestamp(c["expiresAt"]).alias("expires_on")),
    )
    return raw.select(
        _stem(".sim.json").alias("name"),
        i["customerId"].alias("customer_id"),
        F.try_to_timestamp(i["periodStart"]).alias("period_start"),
        F.try_to_timestamp(i["periodEnd"]).alias("period_end"),
        usage.alias("usage_items"),
        commitments.alias("commitments"),
        credits.alias("credits"),
        i["taxRate"].cast("decimal(7,4)").alias("tax_rate"),
        expected_from_file(F.col("expected")).alias("expected"),
        F.col("tolerances.absolute").alias("tol_absolute"),
        F.col("tolerances.relative").alias("tol_relative"),
    )


def expected_from_file(e: Column) -> Column:
    lines = F.transform(
        e["lineItems"],
        lambda x: F.struct(
            x["metric"].alias("metric"), x["quantity"].alias("quantity"),
            x["unitPrice"].alias("unit_price"), x["subtotal"].alias("subtotal"),
        ),
    )
    return F.struct(
        e["subtotal"].alias("subtotal"), e["tax"].alias("tax"), e["total"].alias("total"),
        e["currency"].alias("currency"), lines.alias("line_items"),
    )


def read_expected(spark: SparkSession, folder: str, suffix: str = ".expected.json") -> DataFrame:
    """Expected (or recorded) invoices ``*.expected.json`` with the scenario name."""
    raw = (
        spark.read.schema(EXPECTED_FILE).option("multiLine", True).option("pathGlobFilter", f"*{suffix}").json(folder)
    )
    return raw.select(_stem(suffix).alias("name"), expected_from_file(F.struct(*[F.col(c) for c in raw.columns])).alias("expected"))


def read_event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    """Arriving event files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
