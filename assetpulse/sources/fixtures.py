"""Readings and vibration samples derived from the driver's tables.

The reference's own inputs are not available, so the readings table is
derived from ``events`` (one reading per event; ``event_id`` and ``ts`` are
unique) and ``nation`` (the site names). All derivations are column
expressions over the scan, so the work grows with ``events``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules as R
from ..operators import stats as S
from ..schema import READINGS_SCHEMA


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _unit(event_id: Column, mul: int, add: int, mod: int) -> Column:
    """Deterministic pseudo-uniform in [0, 1) from the event id."""
    return ((event_id * F.lit(mul) + F.lit(add)) % F.lit(mod)).cast("double") / F.lit(float(mod))


def base_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor readings without the rule-made fault columns (25 columns)."""
    ev = table(spark, sf_dir, "events")
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("_nk"), F.col("n_name").alias("site_id"))
    k = F.from_json("props", "k int")["k"]
    eid = F.col("event_id")
    u1, u2, u3, u4 = _unit(eid, 7919, 13, 1009), _unit(eid, 6271, 29, 1013), \
        _unit(eid, 4801, 47, 1019), _unit(eid, 3571, 71, 1021)
    b = ev.select(
        eid.alias("reading_id"), F.col("ts").alias("event_time"), "user_id", "value",
        k.alias("_k"), u1.alias("_u1"), u2.alias("_u2"), u3.alias("_u3"), u4.alias("_u4"))
    kd = F.col("_k").cast("double")
    out = b.join(nation, (F.col("user_id") % 25) == F.col("_nk")).select(
        "reading_id", "event_time",
        F.concat(F.lit("B"), F.col("user_id").cast("string")).alias("asset_id"),
        "site_id",
        F.when(F.col("_k") < 50, "FREE").otherwise("OCCUPIED").alias("occupancy_state"),
        F.concat(F.lit("H"), (F.col("_k") % 5).cast("string")).alias("hmi_alert_code"),
        (F.col("value") / 200).alias("vibration"),
        (F.lit(5.0) + kd * F.lit(0.42) + F.col("value") * F.lit(0.04)).alias("temperature"),
        (F.lit(30.0) + F.lit(70.0) * F.col("_u1")).alias("humidity"),
        (F.lit(5.0) * F.col("_u2")).alias("resistance"),
        (F.lit(100.0) * F.col("_u3")).alias("cpu_load"),
        (F.col("_u4") * F.col("_u1")).alias("anomaly_score"),
        (F.col("_u3") * F.col("_u3")).alias("failure_prob"),
        (F.lit(1.0) - F.col("_u2") * F.col("_u4")).alias("health_index"),
        ((F.col("reading_id") * 37) % 1825).cast("double").alias("age_days"),
        (F.lit(210.0) + F.lit(40.0) * F.col("_u4")).alias("voltage"),
        (F.lit(2.0) + F.lit(8.0) * F.col("_u1")).alias("current_a"),
        (F.lit(100.0) * F.col("_u2")).alias("timer_on"),
        (F.lit(100.0) * F.col("_u3")).alias("timer_ch"),
        (F.lit(50.0) * F.col("_u4")).alias("signal_delay"),
        (F.lit(30.0) * F.col("_u1")).alias("clearance_s"),
        (F.lit(600.0) * F.col("_u2")).alias("headway_s"),
        (kd * F.lit(0.4)).alias("ambient_temp"),
        (F.lit(200.0) * F.col("_u3")).alias("dust"),
        (F.lit(5.0) + F.lit(360.0) * F.col("_u2")).alias("rul_days"),
    )
    return out


def cascade_spec(rules=C.FAULT_CASCADE) -> dict[str, list[float]]:
    spec: dict[str, list[float]] = {}
    for _, clauses in rules:
        for colname, _, q in clauses:
            spec.setdefault(colname, [])
            if q not in spec[colname]:
                spec[colname].append(q)
    return spec


def with_fault_labels(df: DataFrame, quantile_method: str = "exact",
                      stats: dict | None = None) -> DataFrame:
    """F12 + J2: fault code from the quantile cascade, then its maintenance action.

    The ten thresholds are computed once (exact) and enter the cascade as
    literals."""
    spec = cascade_spec()
    if stats is None:
        stats = S.quantile_values(df, spec, quantile_method)
    q = S.quantile_lookup(stats, spec)
    spark = df.sparkSession
    actions = spark.createDataFrame(C.MAINTENANCE_ACTIONS, "fault_code string, maintenance_action string")
    labelled = df.withColumn("fault_code", R.fault_cascade(q))
    # Catalogue of ten codes: a constant, size-proven broadcast.
    return labelled.join(F.broadcast(actions), "fault_code", "left")


TELEMETRY_COLUMNS = READINGS_SCHEMA.names


def telemetry(spark: SparkSession, sf_dir: str, quantile_method: str = "exact") -> DataFrame:
    """The readings table (27 columns) used by every telemetry query."""
    base = base_readings(spark, sf_dir)
    out = with_fault_labels(base, quantile_method)
    return out.select(*TELEMETRY_COLUMNS)


def vibration_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accelerometer samples with source-style headers (acc_x/acc_y/acc_z, ...)."""
    ev = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    k = F.from_json("props", "k int")["k"].cast("double")
    return ev.select(
        eid.alias("sample_id"), F.col("ts").alias("event_time"),
        F.concat(F.lit("B"), F.col("user_id").cast("string")).alias("asset_id"),
        (F.col("value") / 100).alias("acc_x"),
        ((k - F.lit(50.0)) / F.lit(50.0)).alias("acc_y"),
        (F.lit(1.0) + ((eid * 7919 + 13) % 1009).cast("double") / F.lit(5045.0)).alias("acc_z"),
        (F.lit(20.0) + ((eid * 6271 + 29) % 1013).cast("double") / F.lit(50.0)).alias("temperature"),
        (F.lit(40.0) + ((eid * 4801 + 47) % 1019).cast("double") / F.lit(25.0)).alias("humidity"),
    )
