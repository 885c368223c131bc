"""Scenario invoices and their comparison with expected results.

A scenario is one row with nested usage, commitments and credits, so simulating and
comparing are expressions of that row: no shuffle, whatever the number of scenarios.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import money
from tallymill.functions.compare import approx_equal, difference_text
from tallymill.schemas import MONEY, RATED_QTY, SUM

_DIFF = f"array<struct<field:string,expected:string,actual:string,difference:{SUM}>>"


def simulate(scenarios: DataFrame) -> DataFrame:
    """Adds ``invoice``: lines, subtotal, credits, tax, total, currency."""
    zero = F.lit(0).cast(SUM)

    def line(item):
        amounts = money.line_amounts(item["quantity"], item["price_config"])
        return F.struct(
            item["metric"].alias("metric"),
            item["quantity"].cast(RATED_QTY).alias("quantity"),
            amounts["unit_price"].cast(MONEY).alias("unit_price"),
            amounts["subtotal"].cast(RATED_QTY).alias("subtotal"),
        )

    lined = scenarios.withColumn("_lines", F.transform("usage_items", line))
    subtotal = F.aggregate("_lines", zero, lambda acc, x: (acc + x["subtotal"]).cast(SUM))
    summed = lined.withColumn("_subtotal", subtotal)
    active = F.filter(
        "commitments", lambda c: (c["start_date"] <= F.col("period_end")) & (c["end_date"] >= F.col("period_start"))
    )
    # commitments in the given order, each against what is left of the subtotal
    committed = F.aggregate(
        active,
        zero,
        lambda acc, c: (acc + F.least((c["amount"] - c["applied"]).cast(SUM), (F.col("_subtotal") - acc).cast(SUM))).cast(SUM),
    )
    valid = F.filter("credits", lambda c: c["expires_on"].isNull() | (c["expires_on"] >= F.col("period_end")))
    credited = F.aggregate(valid, zero, lambda acc, c: (acc + c["amount"]).cast(SUM))
    credits = (F.coalesce(committed, zero) + F.coalesce(credited, zero)).cast(SUM)
    taxable = F.greatest(F.lit(0).cast("decimal(28,6)"), (F.col("_subtotal") - credits).cast("decimal(28,6)"))
    priced = summed.withColumn("_credits", credits).withColumn("_taxable", taxable).withColumn(
        "_tax", F.col("_taxable") * F.coalesce("tax_rate", F.lit(0)).cast("decimal(7,4)") * F.lit("0.01").cast("decimal(2,2)")
    )
    currency = F.coalesce(F.get("usage_items", F.lit(0))["price_config"]["currency"], F.lit("USD"))
    invoice = F.struct(
        F.col("_lines").alias("line_items"),
        money.round_currency(F.col("_subtotal")).alias("subtotal"),
        money.round_currency(F.col("_credits")).alias("credits"),
        F.lit(0).cast(MONEY).alias("adjustments"),
        money.round_currency(F.col("_tax")).alias("tax"),
        money.round_currency(F.col("_taxable") + F.col("_tax")).alias("total"),
        currency.alias("currency"),
    )
    return priced.withColumn("invoice", invoice).select(*scenarios.columns, "invoice")


def number_text(value: Column) -> Column:
    return F.regexp_replace(value.cast("decimal(24,6)").cast("string"), r"\.?0+$", "")


def _differ(field: Column, expected: Column, actual: Column, differs: Column) -> Column:
    """One difference, or null when equal or when the expected value is not given."""
    return F.when(
        expected.isNotNull() & actual.isNotNull() & differs,
        F.struct(
            field.alias("field"),
            number_text(expected).alias("expected"),
            number_text(actual).alias("actual"),
            F.abs(actual.cast(RATED_QTY) - expected.cast(RATED_QTY)).cast(SUM).alias("difference"),
        ),
    )


def compare(simulated: DataFrame) -> DataFrame:
    """Adds ``differences`` and ``passed`` from invoice, expected and the tolerances of each row."""
    actual, wanted = F.col("invoice"), F.col("expected")
    tolerances = (F.col("tol_absolute"), F.col("tol_relative"))
    apart = lambda a, e: ~approx_equal(a, e, *tolerances)
    heads = [
        _differ(F.lit(name), wanted[name], actual[name], apart(actual[name], wanted[name]))
        for name in ("total", "subtotal", "tax")
    ]
    no_difference = F.lit(None).cast(SUM)
    currency = F.when(
        wanted["currency"].isNotNull() & (wanted["currency"] != actual["currency"]),
        F.struct(
            F.lit("currency").alias("field"), wanted["currency"].alias("expected"),
            actual["currency"].alias("actual"), no_difference.alias("difference"),
        ),
    )

    def line(item):
        name = F.concat(F.lit("lineItem."), item["metric"])
        same = F.get(F.filter(actual["line_items"], lambda x: x["metric"] == item["metric"]), F.lit(0))
        missing = F.struct(
            name.alias("field"), F.to_json(item).alias("expected"), F.lit(None).cast("string").alias("actual"),
            no_difference.alias("difference"),
        )
        found = F.array_compact(
            F.array(
                *[
                    _differ(F.concat(name, F.lit(f".{label}")), item[c], same[c], apart(same[c], item[c]))
                    for label, c in (("subtotal", "subtotal"), ("unitPrice", "unit_price"))
                ],
                _differ(F.concat(name, F.lit(".quantity")), item["quantity"], same["quantity"], same["quantity"] != item["quantity"]),
            )
        )
        return F.when(same.isNull(), F.array(missing)).otherwise(found)

    nothing = F.array().cast(_DIFF)
    lines = F.coalesce(F.flatten(F.transform(wanted["line_items"], line)), nothing)
    differences = F.concat(F.array_compact(F.array(*heads, currency)).cast(_DIFF), lines.cast(_DIFF))
    return simulated.withColumn("differences", F.coalesce(differences, nothing)).withColumn(
        "passed", F.when(wanted.isNotNull(), F.size("differences") == 0)
    )


def difference_rows(compared: DataFrame, key: str = "name") -> DataFrame:
    """One assertion row per difference, with its text."""
    # explode() would copy the whole comparison into a filter for empty arrays; the outer form does not
    rows = compared.select(key, F.explode_outer("differences").alias("d")).filter(F.col("d").isNotNull())
    return rows.select(
        key,
        F.col("d.field").alias("field"),
        F.col("d.expected").alias("expected"),
        F.col("d.actual").alias("actual"),
        F.col("d.difference").alias("difference"),
        difference_text(F.col("d.field"), F.col("d.expected"), F.col("d.actual")).alias("text"),
    )


def pair_expected(scenarios: DataFrame, expected: DataFrame) -> DataFrame:
    """Replaces the expected results by those recorded under the same name."""
    return scenarios.drop("expected").join(expected, "name", "left")


def report(compared: DataFrame) -> DataFrame:
    return compared.select("name", F.when(F.col("passed"), "OK").otherwise("DIFF").alias("status"), F.size("differences").alias("n_diffs"))


def report_totals(compared: DataFrame) -> DataFrame:
    return compared.agg(
        F.count("*").alias("total"), F.count_if(~F.col("passed")).alias("diffs"), F.count_if(F.col("passed")).alias("ok")
    )


def batch_rollup(runs: DataFrame) -> DataFrame:
    """Status and success rate per batch, from the statuses of its runs."""
    n = lambda s: F.count_if(F.col("status") == s)
    counted = runs.groupBy("tenant_id", F.get_json_object("metadata", "$.batchId").alias("batch_id")).agg(
        F.count("*").alias("total_runs"),
        n("completed").alias("completed"),
        n("failed").alias("failed"),
        n("pending").alias("pending"),
        n("running").alias("running"),
    )
    done = F.col("completed") + F.col("failed") == F.col("total_runs")
    status = (
        F.when(~done, "running")
        .when(F.col("failed") == 0, "completed")
        .when(F.col("failed") == F.col("total_runs"), "failed")
        .otherwise("partial")
    )
    rate = F.col("completed").cast("decimal(20,0)") * 100 / F.col("total_runs").cast("decimal(20,0)")
    return counted.withColumn("status", status).withColumn("success_rate", F.round(rate, 2).cast(MONEY))


def runs_of_batch(runs: DataFrame, batch_id: str) -> DataFrame:
    return runs.filter(F.get_json_object("metadata", "$.batchId") == batch_id)


def filter_scenarios(scenarios: DataFrame, tenant: str | None = None, tag: str | None = None) -> DataFrame:
    kept = scenarios if tenant is None else scenarios.filter(F.col("tenant_id") == tenant)
    return kept if tag is None else kept.filter(F.array_contains("tags", tag))


def known_scenarios(requested: DataFrame, scenarios: DataFrame, key: str = "scenario_id") -> tuple[DataFrame, DataFrame]:
    """(scenarios that were asked for, asked ids that do not exist)."""
    asked = requested.select(key).distinct()
    return scenarios.join(asked, key, "left_semi"), asked.join(scenarios.select(key), key, "left_anti")


def all_lines(simulated: DataFrame) -> DataFrame:
    """Line items of the invoices as rows."""
    return simulated.select("name", F.posexplode("invoice.line_items").alias("position", "l")).select(
        "name", "position", "l.metric", "l.quantity", "l.unit_price", "l.subtotal"
    )
