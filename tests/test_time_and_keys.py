from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tallymill.functions import compare, identity, period


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def ts(text):
    return F.lit(text).cast("timestamp")


def day(text):
    return F.lit(text).cast("date")


def test_periods(spark):
    assert value(spark, period.period_start(ts("2024-02-29 23:59:59"))) == date(2024, 2, 1)
    assert value(spark, period.period_start(ts("2024-02-29 23:59:59"), "daily")) == date(2024, 2, 29)
    assert value(spark, period.period_end(day("2024-02-01"))) == date(2024, 2, 29)
    assert value(spark, period.period_end(day("2024-02-01"), "daily")) == date(2024, 2, 1)
    assert period.current_period(datetime(2024, 12, 5)) == ("2024-12-01", "2024-12-31")


@pytest.mark.parametrize(
    "moment, inside", [("2024-01-01 00:00:00", True), ("2024-01-31 23:59:59.999", True), ("2024-02-01 00:00:00", False)]
)
def test_in_period(spark, moment, inside):
    assert value(spark, period.in_period(ts(moment), day("2024-01-01"), day("2024-01-31"))) is inside


def test_too_late_is_strict(spark):
    late = lambda t: value(spark, period.too_late(ts(t), ts("2024-01-10 00:00:00"), period.hours(48)))
    assert late("2024-01-07 23:59:59") and not late("2024-01-08 00:00:00")


def test_proration(spark):
    args = (ts("2024-01-11 00:00:00"), ts("2024-01-21 00:00:00"))
    got = value(spark, period.prorate(F.lit("300").cast("decimal(20,6)"), *args, day("2024-01-01"), day("2024-01-31")))
    assert got == D("100.00")
    assert value(spark, period.proration_factor(*args, day("2024-01-01"), day("2024-01-31"))) == pytest.approx(10 / 31, abs=1e-6)
    nothing = period.prorate(F.lit("300").cast("decimal(20,6)"), *args, day("2024-01-01"), day("2024-01-01"))
    assert value(spark, nothing) is None


def test_bounds():
    now = datetime(2025, 1, 16, 14, 30)
    assert period.parse_bound("now", now) == now
    assert period.parse_bound("-PT24H", now) == datetime(2025, 1, 15, 14, 30)
    assert period.parse_bound("-P1D", now) == datetime(2025, 1, 15, 14, 30)
    assert period.parse_bound("2025-01-01T02:00:00+02:00", now) == datetime(2025, 1, 1)
    with pytest.raises(ValueError):
        period.parse_bound("yesterday", now)


def test_push_key(spark):
    key = identity.push_key(
        F.lit("123e4567-e89b-12d3-a456-426614174000"), F.lit("si_ABC123"), day("2025-01-01"), F.lit("100.5"), F.lit(False)
    )
    expected = "push:123e4567-e89b-12d3-a456-426614174000:si_ABC123:2025-01-01:100.500000"
    assert value(spark, key) == expected


@pytest.mark.parametrize(
    "key, valid",
    [
        ("evt_0123456789abcdef", True), ("evt_0123456789ABCDEF", False), ("evt_012", False),
        ("push:ab-12:si_A1:2025-01-01:1.000000", True), ("push:ab-12:si_A1:2025-01-01:1.000000:170", True),
        ("push-shadow:ab-12:si_A1:2025-01-01:1.000000", True), ("push:ab-12:si_A1:2025-01-01:1.0", False), (None, False),
    ],
)
def test_key_format(spark, key, valid):
    assert value(spark, identity.is_valid_key(F.lit(key).cast("string"))) is valid


@pytest.mark.parametrize(
    "a, e, same", [("100", "100.001", True), ("100", "100.04", True), ("100", "100.06", False), ("0.5", "0.5009", True), ("0.5", "0.502", False)]
)
def test_approx_equal(spark, a, e, same):
    number = lambda x: F.lit(x).cast("decimal(20,6)")
    assert value(spark, compare.approx_equal(number(a), number(e))) is same


def test_drift(spark):
    pct = lambda a, b: value(spark, compare.drift_pct(F.lit(a), F.lit(b)))
    assert pct(100, 0) == 1.0 and pct(0, 0) == 0.0 and pct(100512, 100320) == pytest.approx(192 / 100320)
