"""Lookups (J1-J3, J6): catalogue joins and class weights.

Catalogues are ten-row constants, so a broadcast hash join is size-proven;
the reading side is never shuffled for them. A catalogue given by a user as a
table goes through ``dimension_join``, which only broadcasts below a row cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C

BROADCAST_ROW_CAP = 1_000_000


def fault_catalog(spark: SparkSession, catalog=C.FAULT_CATALOG) -> DataFrame:
    return spark.createDataFrame(
        catalog, "fault_code string, fault_description string, recommended_action string, base_priority string")


def maintenance_actions(spark: SparkSession, actions=C.MAINTENANCE_ACTIONS) -> DataFrame:
    return spark.createDataFrame(actions, "fault_code string, maintenance_action string")


def severities(spark: SparkSession, sev=C.FAULT_SEVERITY) -> DataFrame:
    return spark.createDataFrame(sev, "fault_code string, severity double")


def dimension_join(df: DataFrame, dim: DataFrame, on, how: str = "left",
                   known_rows: int | None = None) -> DataFrame:
    """Join a dimension: broadcast when its row count is known to be small,
    otherwise leave the strategy to Catalyst/AQE (shuffle join, runtime
    broadcast when the measured size allows)."""
    if known_rows is not None and known_rows <= BROADCAST_ROW_CAP:
        return df.join(F.broadcast(dim), on, how)
    return df.join(dim, on, how)


def describe_faults(df: DataFrame, code_col: str = "fault_code", catalog=C.FAULT_CATALOG) -> DataFrame:
    """Add description, action and base priority; misses get the fallback."""
    spark = df.sparkSession
    cat = fault_catalog(spark, catalog).withColumnRenamed("fault_code", "_code")
    unk_d, unk_a, unk_p = C.UNKNOWN_FAULT
    joined = dimension_join(df, cat, F.col(code_col) == F.col("_code"), "left", known_rows=len(catalog))
    return (joined
            .withColumn("fault_description", F.coalesce(F.col("fault_description"), F.lit(unk_d)))
            .withColumn("recommended_action", F.coalesce(F.col("recommended_action"), F.lit(unk_a)))
            .withColumn("base_priority", F.coalesce(F.col("base_priority"), F.lit(unk_p)))
            .drop("_code"))


def map_actions(df: DataFrame, code_col: str = "fault_code", actions=C.MAINTENANCE_ACTIONS) -> DataFrame:
    """Maintenance action per fault code; a miss gives null."""
    spark = df.sparkSession
    m = maintenance_actions(spark, actions).withColumnRenamed("fault_code", "_code") \
        .withColumnRenamed("maintenance_action", "_action")
    out = dimension_join(df.drop("maintenance_action") if "maintenance_action" in df.columns else df,
                         m, F.col(code_col) == F.col("_code"), "left", known_rows=len(actions))
    return out.withColumnRenamed("_action", "maintenance_action").drop("_code")


def add_severity(df: DataFrame, code_col: str = "fault_code", sev=C.FAULT_SEVERITY) -> DataFrame:
    """Severity per fault code (null for an unknown code)."""
    spark = df.sparkSession
    s = severities(spark, sev).withColumnRenamed("fault_code", "_code")
    return dimension_join(df, s, F.col(code_col) == F.col("_code"), "left", known_rows=len(sev)).drop("_code")


def class_weights(df: DataFrame, label: str, weight_col: str = "weight") -> DataFrame:
    """J6: 'balanced' weights n / (k * n_class) per row.

    The per-class count table has one row per class (a categorical label);
    its total n and class count k are window sums over that small table, and
    it is broadcast back to the rows.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    every_class = Window.partitionBy()  # over the per-class table only
    w = counts.select(label, (F.sum("_nc").over(every_class)
                              / (F.count(F.lit(1)).over(every_class) * F.col("_nc"))).alias(weight_col))
    return df.join(F.broadcast(w), label, "left")
