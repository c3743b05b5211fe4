"""Roll-ups, top-k and dashboard projections.

Group-bys run as partial (map-side) + final aggregation, so a hot asset or
site is pre-aggregated in every task before the shuffle: the shuffle carries
one row per (task, group), not the readings. Top-k uses
TakeOrderedAndProject (each task keeps k rows). Null group keys are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R


def _count_if(cond) -> F.Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def asset_summary(df: DataFrame, level_col: str = "alert_level_basic",
                  flag_col: str = "if_flag") -> DataFrame:
    """A1: per asset mean health (1 dp), vibration (3), RUL (1), CRITICAL and
    WARNING counts, flagged anomalies."""
    return (df.where(F.col("asset_id").isNotNull())
            .groupBy(F.col("asset_id").alias("block_id"))
            .agg(F.round(F.avg("health_score"), 1).alias("avg_health"),
                 F.round(F.avg("vibration"), 3).alias("avg_vibration"),
                 F.round(F.avg("rul_days"), 1).alias("avg_rul"),
                 _count_if(F.col(level_col) == "CRITICAL").alias("n_critical"),
                 _count_if(F.col(level_col) == "WARNING").alias("n_warning"),
                 F.coalesce(F.sum(F.col(flag_col)), F.lit(0)).cast("long").alias("n_anomalies")))


def site_summary(df: DataFrame, level_col: str = "alert_level_basic") -> DataFrame:
    """A2: per site mean health, distinct assets, non-HEALTHY readings.

    The distinct count is an exact ``count(DISTINCT)``: Spark expands it into
    a (site, asset) pre-aggregation, so a hot site is still split by asset.
    """
    return (df.where(F.col("site_id").isNotNull())
            .groupBy(F.col("site_id").alias("location_id"))
            .agg(F.round(F.avg("health_score"), 1).alias("avg_health"),
                 F.countDistinct("asset_id").alias("n_blocks"),
                 _count_if(F.col(level_col) != "HEALTHY").alias("n_alerts")))


def distribution(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """A3/A4/A5: count per value (null values dropped), most frequent first."""
    return (df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias(name or col))
            .agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(name or col)))


def alert_summary(log: DataFrame, level_col: str = "alert_level_full") -> DataFrame:
    """Total alerts, CRITICAL, WARNING, mean score."""
    return log.agg(F.count(F.lit(1)).alias("total_alerts"),
                   _count_if(F.col(level_col) == "CRITICAL").alias("n_critical"),
                   _count_if(F.col(level_col) == "WARNING").alias("n_warning"),
                   F.avg("alert_score").alias("avg_score"))


def kpi(summary: DataFrame) -> DataFrame:
    """Over the (selected) asset rows: count, mean of the rounded per-asset
    means (unweighted, as the dashboard shows it), and sums."""
    return summary.agg(F.count(F.lit(1)).alias("n_blocks"),
                       F.avg("avg_health").alias("avg_health"),
                       F.sum("n_critical").alias("total_critical"),
                       F.sum("n_warning").alias("total_warning"),
                       F.sum("n_anomalies").alias("total_anomalies"),
                       F.avg("avg_rul").alias("avg_rul"))


def top_alerts(log: DataFrame, k: int = 50) -> DataFrame:
    """O3/O4 + P8: the k most urgent alerts as display cards, with their rank.

    ``orderBy().limit(k)`` plans as TakeOrderedAndProject; the rank window then
    runs over k rows only.
    """
    top = log.orderBy(F.col("alert_score").desc(), F.col("reading_id")).limit(k)
    w = Window.orderBy(F.col("alert_score").desc(), F.col("reading_id"))
    return top.select(
        F.row_number().over(w).cast("long").alias("rank"),
        F.coalesce(F.col("asset_id"), F.lit("")).alias("block_id"),
        F.coalesce(F.col("site_id"), F.lit("")).alias("location"),
        F.coalesce(F.col("alert_level_full"), F.lit("")).alias("level"),
        F.round(F.coalesce(F.col("alert_score"), F.lit(0.0)), 1).alias("score"),
        F.coalesce(F.col("fault_description"), F.lit("")).alias("fault"),
        F.coalesce(F.col("recommended_action"), F.lit("")).alias("action"),
        F.round(F.coalesce(F.col("failure_prob"), F.lit(0.0)), 3).alias("failure_prob"),
        F.round(F.coalesce(F.col("rul_days"), F.lit(0.0)), 1).alias("rul"))


def level_counts(cards: DataFrame) -> DataFrame:
    """Level counts over the shown (top-k) alerts only."""
    return cards.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


def filter_level(log: DataFrame, level: str = "ALL", col: str = "alert_level_full") -> DataFrame:
    """P5: ALL passes everything, otherwise equality on the level."""
    return log if level == "ALL" else log.where(F.col(col) == level)


def filter_assets(df: DataFrame, assets: DataFrame | list | None = None,
                  sites: DataFrame | list | None = None) -> DataFrame:
    """Keep the chosen assets / sites. Lists become ``isin``; a table of
    keys becomes a left-semi join (no row duplication, no size limit)."""
    out = df
    for col, sel in (("asset_id", assets), ("site_id", sites)):
        if sel is None:
            continue
        if isinstance(sel, DataFrame):
            keys = sel.select(F.col(sel.columns[0]).alias("_key"))
            out = out.join(keys, F.col(col) == F.col("_key"), "left_semi")
        else:
            out = out.where(F.col(col).isin(list(sel)))
    return out


def asset_detail(summary: DataFrame) -> DataFrame:
    """O7 + P7: asset roll-up in natural-number order of the asset id.

    Positions come from the distributed row index (the summary has one row
    per asset, which can be millions), not from an unpartitioned window."""
    from .order import row_index
    num = F.regexp_extract("block_id", r"(\d+)", 1)
    keyed = summary.withColumn("_num", F.when(num == "", None).otherwise(num.cast("long")))
    idx = row_index(keyed, [F.col("_num").asc_nulls_first(), F.col("block_id")], "_pos")
    return idx.select((F.col("_pos") + 1).cast("long").alias("position"), "block_id", "avg_health",
                      "avg_vibration", "avg_rul", "n_critical", "n_warning", "n_anomalies")


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width bins from min to max (last bin closed), zero-filled.

    min/max are computed once (one aggregate) and enter the bin expression as
    literals; the ``bins`` grid rows come from a ``sequence``.
    """
    st = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
    lo, hi = F.lit(st["lo"]).cast("double"), F.lit(st["hi"]).cast("double")
    step = (hi - lo) / F.lit(bins)
    b = F.when(step > 0, F.least(F.lit(bins - 1), F.floor((F.col(col) - lo) / step).cast("int"))) \
        .otherwise(F.lit(0))
    counts = df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin",
                    (lo + (hi - lo) * F.col("bin") / F.lit(bins)).alias("bin_lo"),
                    (lo + (hi - lo) * (F.col("bin") + 1) / F.lit(bins)).alias("bin_hi"),
                    F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


#: What ``time_series`` shows beside the time.
TIME_SERIES_COLUMNS = ["vibration", "temperature", "health_score", "failure_prob"]


def time_series(indexed: DataFrame, step: int = 3, index_col: str = "row_idx") -> DataFrame:
    """P9 + W3: every ``step``-th reading: formatted time and rounded metrics."""
    return (indexed.where(F.col(index_col) % step == 0)
            .select(index_col, R.format_time(F.col("event_time")).alias("timestamp"),
                    F.round("vibration", 3).alias("vibration"),
                    F.round("temperature", 1).alias("temperature"),
                    F.round("health_score", 1).alias("health_score"),
                    F.round("failure_prob", 3).alias("failure_prob")))


def vibration_series(indexed: DataFrame, step: int = 3, index_col: str = "row_idx") -> DataFrame:
    """Every ``step``-th sample: magnitude and rolling mean (4 dp), flag,
    temperature and humidity (1 dp) only when the samples carry them."""
    cols = [index_col, F.round("accel_magnitude", 4).alias("accel_magnitude"),
            F.round("rolling_mag", 4).alias("rolling_mag"), F.col("vibr_anomaly")]
    if "Temp" in indexed.columns:
        cols.append(F.round("Temp", 1).alias("temp"))
    if "Hum" in indexed.columns:
        cols.append(F.round("Hum", 1).alias("hum"))
    return indexed.where(F.col(index_col) % step == 0).select(*cols)


def split_by_flag(df: DataFrame, value_col: str, flag_col: str) -> DataFrame:
    """P10: value in ``normal`` when the flag is 0, in ``anomalous`` when 1."""
    return df.withColumns({
        "normal": F.when(F.col(flag_col) == 0, F.col(value_col)),
        "anomalous": F.when(F.col(flag_col) == 1, F.col(value_col)),
    })
