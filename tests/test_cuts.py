"""Splits by rank selection equal the splits by a sorted row index; row numbers of files; pause and reset of a feed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assetpulse.operators import order as O
from assetpulse.operators import selection as SEL
from assetpulse.sources import fixtures as FX
from assetpulse.sources import readers as RD
from assetpulse.streaming import feed as SF


def _ids(df, flag=True):
    return sorted(r[0] for r in df.where(F.col("is_test") == F.lit(flag)).select("id").collect())


@pytest.mark.parametrize("merged", [20_000, 8])
def test_time_cut_equals_sorted_split(spark, monkeypatch, merged):
    monkeypatch.setattr(SEL, "MERGED", merged)
    rng = random.Random(3)
    base = dt.datetime(1969, 12, 31, 23, 59, 58)
    rows = [(i, rng.choice([None, base + dt.timedelta(microseconds=rng.randint(0, 9) * 777_777)]) if i % 9 == 0
             else base + dt.timedelta(microseconds=500_001 * rng.randint(0, 40))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, t timestamp_ntz")
    for test in (0.0, 0.2, 0.5, 0.999, 1.0):
        got, n = O.time_cut(df, ["t", "id"], test)
        assert n == int(600 * (1 - test))
        assert _ids(got) == _ids(O.time_split(df, ["t", "id"], test))
    got, n = O.time_cut(df.limit(0), ["t", "id"])
    assert n == 0 and got.count() == 0


def test_time_cut_writes_and_moves_nothing(spark):
    got, n = O.time_cut(FX.base_readings(spark, "/root/testdata/sf0.001").select("event_time", "reading_id", "vibration"), ["event_time", "reading_id"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "Scan ExistingRDD" not in plan
    assert got.where(~F.col("is_test")).count() == n


@pytest.mark.parametrize("merged", [20_000, 40])
def test_stratified_cut_equals_sorted_split(spark, monkeypatch, merged):
    monkeypatch.setattr(O, "MERGED", merged)
    rng = random.Random(5)
    df = spark.createDataFrame([(i, rng.choice(["a"] * 40 + ["b"] * 5 + ["c", None])) for i in range(3000)] + [(5000, "single")],
                               "id long, label string")
    for test in (0.0, 0.2, 0.75, 1.0):
        assert _ids(O.stratified_cut(df, "label", "id", test)) == _ids(O.stratified_split(df, "label", "id", test))
    assert O.stratified_cut(df.limit(0), "label", "id").count() == 0


@pytest.mark.parametrize("merged", [20_000, 5])
def test_nth_on_large_numbers_ties_and_nan(spark, monkeypatch, merged):
    monkeypatch.setattr(SEL, "MERGED", merged)
    big = [2**62 + i for i in range(40)] + [7] * 50 + [None] * 10
    df = spark.createDataFrame([(x,) for x in big], "v long")
    want = sorted(big, key=lambda x: (x is not None, x))
    for rank in (0, 9, 10, 59, 60, 75, 99):
        value, below, same = SEL.nth(df, "v", rank, 100)
        assert (value, below, same) == (want[rank], want.index(want[rank]), want.count(want[rank]))
    d = spark.createDataFrame([(x,) for x in [1.0, 2.0, float("nan"), float("nan")]], "v double")
    assert SEL.nth(d, "v", 1, 4) == (2.0, 1, 1)


def test_row_numbers_do_not_depend_on_splits(spark, tmp_path):
    path = str(tmp_path / "numbered")
    (spark.range(5000).select(F.col("id").alias("n"), F.concat(F.lit("word "), F.col("id")).alias("w"))
          .repartitionByRange(3, "n").sortWithinPartitions("n").write.option("header", True).csv(path))
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("w", T.StringType())])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "4096"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = RD.read_readings(spark, path, "csv", schema)
            assert got.where(F.col("n") != F.col("reading_id")).count() == 0 and got.count() == 5000
            assert got.columns == ["n", "w", "reading_id"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_feed_pauses_resumes_and_resets(spark, telemetry):
    ws = SF.workspace(spark, "test-lifecycle")
    SF.write_feed_files(telemetry, f"{ws}/source", 6)
    feed = lambda: SF.read_feed(spark, f"{ws}/source", telemetry.schema, 2)
    assert SF.run_alert_triggers(feed(), f"{ws}/sink", f"{ws}/chk", stop_before=1)
    first = spark.read.parquet(f"{ws}/sink")
    assert [r[0] for r in first.select("batch").distinct().collect()] == [0]
    part = first.count()
    assert not SF.run_alert_triggers(feed(), f"{ws}/sink", f"{ws}/chk")
    whole = spark.read.parquet(f"{ws}/sink")
    assert not SF.run_alert_triggers(feed(), f"{ws}/reset", f"{ws}/chk2")
    again = spark.read.parquet(f"{ws}/reset")
    assert 0 < part < whole.count() == again.count() == whole.select("reading_id").distinct().count()
    assert whole.drop("batch").exceptAll(again.drop("batch")).count() == 0
