"""Golden prices and invoices."""

from datetime import date
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallymill.functions import money
from tallymill.operators import rating, whatif
from tallymill.plans.tables import frame
from tallymill.schemas import PRICE_CONFIG, RATED_QTY, TIER

STEPS = [("100", "1.00", None), ("1000", "0.80", None), (None, "0.60", None)]
GRADES = [("100", "0.50", "10"), ("1000", "0.30", "50"), (None, "0.20", "100")]


def total(spark, expression, quantity, tiers):
    rows = frame(spark, [(quantity, tiers)], f"q {RATED_QTY}, tiers array<{TIER}>")
    return rows.select(expression(F.col("q"), F.col("tiers"))).first()[0]


@pytest.mark.parametrize(
    "quantity, tiers, expected",
    [
        ("0", STEPS, "0"), ("50", STEPS, "50"), ("100", STEPS, "100"), ("1500", STEPS, "1120"), ("150.5", STEPS, "140.40"),
        ("33.333", [(None, "0.03", None)], "1.00"),
        ("350", [("100", "0.10", None), ("500", "0.08", None), (None, "0.05", None)], "30"),
        ("3500", [("1000", "0.10", None), (None, "0.05", None)], "225"),
        ("500", [("100", "1", None), ("200", "1", None)], "200"),  # units above a finite last tier are free
        ("500", [("0", "2", None), (None, "1", None)], "1000"),  # a bound of 0 is no bound
    ],
)
def test_tiered(spark, quantity, tiers, expected):
    assert total(spark, money.tiered_total, quantity, tiers) == D(expected)


@pytest.mark.parametrize("quantity, expected", [("50", "50"), ("500", "400"), ("1500", "900")])
def test_volume(spark, quantity, expected):
    assert total(spark, money.volume_total, quantity, STEPS) == D(expected)


def test_volume_above_all_tiers_uses_the_last(spark):
    assert total(spark, money.volume_total, "1500", STEPS[:2]) == D("1200")


@pytest.mark.parametrize("quantity, expected", [("0", "0"), ("50", "35"), ("1500", "580")])
def test_graduated(spark, quantity, expected):
    assert total(spark, money.graduated_total, quantity, GRADES) == D(expected)


def config(model, unit=None, size=None, low=None, high=None, tiers=None):
    return (model, "USD", tiers, unit, size, low, high)


@pytest.mark.parametrize(
    "quantity, price, subtotal, unit",
    [
        ("250", config("package", "5", "100"), "15", "5"),
        ("13", config("package", "5", "4"), "20", "5"),
        ("3", config("package", "5", "0"), "15", "5"),
        ("10", config("flat", "0.01", low="5"), "5", "0.01"),
        ("10000", config("flat", "0.01", high="50"), "50", "0.01"),
        ("0", config("flat", "0.01", low="5"), "5", "0.01"),
        ("7", config("flat", "10", low="50"), "70", "10"),
        ("350", config("tiered", tiers=[("100", "0.10", None), ("500", "0.08", None), (None, "0.05", None)]), "30", "0.09"),
        ("500", config("volume", tiers=STEPS), "400", "0.80"),
        ("9", config("stairs", "3"), "0", "0"),
        ("9", config("tiered"), "0", "0"),
    ],
)
def test_line(spark, quantity, price, subtotal, unit):
    rows = frame(spark, [(quantity, price)], f"quantity {RATED_QTY}, price_config {PRICE_CONFIG}")
    line = rating.rate_lines(rows).first()
    assert (line.subtotal, line.unit_price) == (D(subtotal), D(unit))


def invoice(spark, commitments, credits, tax=0, subtotal="10"):
    lines = frame(
        spark,
        [("t", "c", date(2024, 1, 1), date(2024, 1, 31), "m", "1", subtotal, config("flat", "1"))],
        f"tenant_id string, customer_ref string, period_start date, period_end date, position string, quantity {RATED_QTY}, "
        f"subtotal {RATED_QTY}, price_config {PRICE_CONFIG}",
    )
    held = frame(
        spark, [("t", "c", i, a, used, s, e) for i, (a, used, s, e) in enumerate(commitments)],
        f"tenant_id string, customer_ref string, position int, amount {RATED_QTY}, applied {RATED_QTY}, start_date date, end_date date",
    )
    given = frame(
        spark, [("t", "c", a, e) for a, e in credits], f"tenant_id string, customer_ref string, amount {RATED_QTY}, expires_on date"
    )
    return rating.invoices(lines, held, given, tax).first()


YEAR = (date(2024, 1, 1), date(2024, 12, 31))


def test_commitment(spark):
    got = invoice(spark, [("5", "0", *YEAR)], [])
    assert (got.credits, got.total) == (D(5), D(5))


def test_commitments_in_order_against_the_rest(spark):
    got = invoice(spark, [("3", "0", *YEAR), ("5", "0", *YEAR)], [], subtotal="6")
    assert (got.credits, got.total) == (D(6), D(0))


def test_overdrawn_commitment_gives_a_negative_credit(spark):
    got = invoice(spark, [("3", "5", *YEAR), ("4", "0", *YEAR)], [])
    assert (got.credits, got.total) == (D(2), D(8))


def test_commitment_of_another_period(spark):
    assert invoice(spark, [("5", "0", date(2024, 2, 1), date(2024, 12, 31))], []).credits == 0
    assert invoice(spark, [("5", "0", date(2023, 1, 1), date(2024, 1, 1))], []).credits == 5


def test_credits_expire_and_are_not_capped(spark):
    assert invoice(spark, [], [("3", None), ("2", date(2024, 1, 31)), ("9", date(2024, 1, 30))]).total == D(5)
    got = invoice(spark, [], [("30", None)])
    assert (got.credits, got.total) == (D(30), D(0))


def test_tax(spark):
    got = invoice(spark, [], [], 10)
    assert (got.tax, got.total) == (D(1), D(11))


def test_currency_of_the_first_line_whatever_its_length(spark):
    lines = frame(
        spark,
        [
            ("t", "c", date(2024, 1, 1), date(2024, 1, 31), n, "1", "2", (*config("flat", "1")[:1], currency, *config("flat", "1")[2:]))
            for n, currency in [(7, "USD"), (3, "POINTS-GOLD"), (5, None), (3, "POINTS-GOLD")]
        ],
        f"tenant_id string, customer_ref string, period_start date, period_end date, position int, quantity {RATED_QTY}, "
        f"subtotal {RATED_QTY}, price_config {PRICE_CONFIG}",
    )
    got = rating.invoices(lines).first()
    assert (got.currency, got.n_lines, got.total) == ("POINTS-GOLD", 4, D(8))


def test_plan_overage(spark):
    got = spark.range(1).select(whatif.overage_units(F.lit("12").cast(RATED_QTY), F.lit("10").cast(RATED_QTY))).first()[0]
    assert got == D(2)


def test_mixed_cadence_of_the_demo(spark):
    rows = spark.sql(
        "SELECT 20 AS days, 15 AS upgrade_day, 10 AS addon_day, 2900 AS base_before, 5900 AS base_after, 19900 AS addon, "
        "cast(10000 AS decimal(24,6)) AS used, 10000 AS included, 1 AS overage_cents"
    )
    got = whatif.mixed_cadence(rows).first()
    # 2900*15/20 + 5900*5/20 + 19900*10/365 = 2175 + 1475 + 545.2
    assert (got.days_before, got.days_after, got.total_cents) == (15, 5, 4195)
