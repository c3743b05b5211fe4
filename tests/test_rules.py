"""Scalar rules: the reference's literal cases plus boundary and null rows."""

import math

import pytest
from pyspark.sql import functions as F

from assetpulse import config as C
from assetpulse.functions import rules as R

LEVEL_CASES = [
    # (failure_prob, rul_days, expected) — the six literal rows of the reference tests
    (0.9, 100.0, "CRITICAL"),
    (0.1, 10.0, "CRITICAL"),
    (0.5, 100.0, "WARNING"),
    (0.1, 200.0, "HEALTHY"),
    (0.76, 200.0, "CRITICAL"),
    (0.1, 55.0, "WARNING"),
    # boundaries: all comparisons strict
    (0.75, 200.0, "WARNING"),
    (0.45, 200.0, "HEALTHY"),
    (0.1, 15.0, "WARNING"),
    (0.1, 60.0, "HEALTHY"),
    # a missing value is not a signal
    (None, 100.0, "HEALTHY"),
    (None, 10.0, "CRITICAL"),
]


def test_basic_alert_level(spark):
    df = spark.createDataFrame(LEVEL_CASES, "failure_prob double, rul_days double, expected string")
    got = df.select(R.alert_level(df, C.BASIC_THRESHOLDS).alias("lvl"), "expected").collect()
    assert [r.lvl for r in got] == [r.expected for r in got]


def test_full_alert_level_extra_signals(spark):
    rows = [(0.1, 200.0, 0.71, 20.0, "CRITICAL"), (0.1, 200.0, 0.70, 20.0, "WARNING"),
            (0.1, 200.0, 0.1, 55.5, "CRITICAL"), (0.1, 200.0, 0.1, 55.0, "WARNING"),
            (0.1, 200.0, 0.55, 45.0, "HEALTHY"), (0.1, 200.0, 0.56, 20.0, "WARNING")]
    df = spark.createDataFrame(rows, "failure_prob double, rul_days double, vibration double, "
                                     "temperature double, expected string")
    got = df.select(R.alert_level(df, C.FULL_THRESHOLDS).alias("lvl"), "expected").collect()
    assert [r.lvl for r in got] == [r.expected for r in got]


def test_absent_columns_take_defaults(spark):
    df = spark.createDataFrame([(1,)], "x int")
    r = df.select(R.alert_level(df).alias("lvl"), R.health_score(df).alias("h"),
                  R.alert_score(df).alias("s")).first()
    assert r.lvl == "HEALTHY"
    # defaults p=0.5, index=0.5, anomaly=0.5, rul=180
    assert r.h == pytest.approx((0.4 * 0.5 + 0.25 * 0.5 + 0.2 * 0.5 + 0.15 * 180 / 365) * 100)
    assert r.s == pytest.approx(0.0)


def test_alert_score_range_and_maximum(spark):
    df = spark.createDataFrame([(0.5, 100.0, 0.3, 0), (1.0, 0.0, 1.0, 1), (0.0, 900.0, 0.0, 0)],
                               "failure_prob double, rul_days double, anomaly_score double, if_flag int")
    s = [r.s for r in df.select(R.alert_score(df).alias("s")).collect()]
    assert 0 <= s[0] <= 100
    assert s[1] == pytest.approx(100.0)
    assert s[2] == pytest.approx(0.0)


def test_health_score_within_bounds(telemetry):
    r = telemetry.select(R.health_score(telemetry).alias("h")).agg(F.min("h"), F.max("h")).first()
    assert 0 <= r[0] <= r[1] <= 100


def test_magnitude_formula(spark):
    df = spark.createDataFrame([(3.0, 4.0, 12.0), (0.0, 0.0, 0.0)], "x double, y double, z double")
    got = [r.m for r in df.select(R.magnitude(F.col("x"), F.col("y"), F.col("z")).alias("m")).collect()]
    assert got == [13.0, 0.0]


def test_rul_band_and_display_bands(spark):
    df = spark.createDataFrame([(14.9,), (15.0,), (59.0,), (60.0,), (119.0,), (120.0,), (None,)], "d double")
    got = [r.b for r in df.select(R.rul_band(F.col("d")).alias("b")).collect()]
    assert got == ["CRITICAL", "WARNING", "WARNING", "MONITOR", "MONITOR", "HEALTHY", "HEALTHY"]
    df2 = spark.createDataFrame([(70.0,), (69.9,), (40.0,), (39.9,)], "h double")
    assert [r.b for r in df2.select(R.health_band(F.col("h")).alias("b")).collect()] == \
        ["good", "fair", "fair", "poor"]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (2.0,), (0.5,)], "v double")
    got = [r.c for r in df.select(R.clip(F.col("v"), 0.0, 1.0).alias("c")).collect()]
    assert got == [None, 0.0, 1.0, 0.5]


def test_fault_text_unknown_code(spark):
    df = spark.createDataFrame([("C99", None, None), ("C1", "d", "a")], "c string, d string, a string")
    got = [r.t for r in df.select(R.fault_text(F.col("c"), F.col("d"), F.col("a")).alias("t")).collect()]
    assert got == ["Unknown fault type: C99", "d — a"]


def test_noise_is_deterministic_and_normal(spark):
    df = spark.range(20000).select(R.gaussian_noise(F.col("id"), 42, 8.0).alias("n"))
    a = df.agg(F.avg("n"), F.stddev("n")).first()
    b = df.agg(F.avg("n"), F.stddev("n")).first()
    assert a == b
    assert abs(a[0]) < 0.3 and math.isclose(a[1], 8.0, rel_tol=0.05)
