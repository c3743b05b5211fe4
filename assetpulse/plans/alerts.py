"""The ranked maintenance alert log, and M14: the preprocessing chain.

Both are single lazy DataFrame chains; Catalyst fuses the rule expressions
into one codegen stage with the scan, and the catalogue is a broadcast join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import rules as R
from ..operators import lookups as L

ALERT_LEVELS_SHOWN = ["CRITICAL", "WARNING"]


def score_alerts(df: DataFrame, thresholds: dict = C.FULL_THRESHOLDS) -> DataFrame:
    """F7 + F10 on every row (no filter)."""
    return (df.withColumn("alert_level_full", R.alert_level(df, thresholds))
              .withColumn("alert_score", R.alert_score(df)))


def alert_log(df: DataFrame, thresholds: dict = C.FULL_THRESHOLDS, catalog=C.FAULT_CATALOG,
              sort: bool = True) -> DataFrame:
    """4-signal level, urgency score, catalogue lookup, CRITICAL/WARNING
    only, most urgent first (ties broken by reading id).

    The level filter runs before the score and the lookup, so only alerting
    rows reach the join; the sort is a distributed range sort.
    """
    lvl = df.withColumn("alert_level_full", R.alert_level(df, thresholds))
    kept = lvl.where(F.col("alert_level_full").isin(ALERT_LEVELS_SHOWN))
    scored = kept.withColumn("alert_score", R.alert_score(kept))
    out = L.describe_faults(scored, "fault_code", catalog)
    if sort:
        out = out.orderBy(F.col("alert_score").desc(), F.col("reading_id"))
    return out


def preprocess(df: DataFrame, encode: bool = True) -> DataFrame:
    """Label codes for the categoricals, health score, 2-signal alert level."""
    from ..ml.features import label_encode  # local import: ML package is optional here
    out = df
    if encode:
        cats = [c for c in C.CATEGORICAL_COLUMNS if c in df.columns]
        out, _ = label_encode(out, cats)
    return (out.withColumn("health_score", R.health_score(out))
               .withColumn("alert_level_basic", R.alert_level(out, C.BASIC_THRESHOLDS)))
