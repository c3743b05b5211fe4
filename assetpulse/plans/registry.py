"""Named queries: each takes (spark, sf_dir) and returns a DataFrame.

The driver runs each one at sf0.01 next to its DuckDB SQL in
``assetpulse.checks.oracle_sql``. Every query reads the whole driver tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from .. import schema as SC
from ..functions import rules as R
from ..ml import features as FE
from ..operators import lookups as L
from ..operators import metrics as M
from ..operators import order as O
from ..operators import rollups as RU
from ..operators import stats as S
from ..session import cut_lineage, materialise
from ..sources import fixtures as FX
from . import alerts as AL
from .relabel import relabel
from .vibration import vibration_features

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TIME_ORDER = ["event_time", "reading_id"]


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# --- shared inputs -----------------------------------------------------------

def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Readings + health score + both alert levels."""
    return with_levels(FX.telemetry(spark, sf))


def with_levels(t: DataFrame) -> DataFrame:
    return (t.withColumn("alert_level_basic", R.alert_level(t, C.BASIC_THRESHOLDS))
             .withColumn("alert_level_full", R.alert_level(t, C.FULL_THRESHOLDS))
             .withColumn("health_score", R.health_score(t)))


def with_edge_flag(df: DataFrame, q: float = 0.92) -> DataFrame:
    """Rule flag used where the SQL check needs a deterministic anomaly flag:
    edge anomaly score above its table quantile ``q`` (top 8 %)."""
    st = S.quantile_values(df, {"anomaly_score": [q]})
    (name, thr), = st.items()
    return df.withColumn("edge_flag", (F.col("anomaly_score") > F.lit(thr)).cast("int"))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Scored readings with the rule flag; their roll-ups need no fault code."""
    return with_edge_flag(with_levels(FX.base_readings(spark, sf)))


def block_summary(spark: SparkSession, sf: str) -> DataFrame:
    return RU.asset_summary(readings(spark, sf), flag_col="edge_flag")


def pseudo_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic stand-in predictions (label, hashed error) so the metric
    operators get an exact SQL check independent of any trained model."""
    t = FX.telemetry(spark, sf)
    u = O.hash_unit(F.col("reading_id"), "pred")
    wrong = F.concat(F.lit("C"), (F.lit(1) + F.floor(u * 40).cast("int")).cast("string"))
    return t.select("reading_id", F.col("fault_code").alias("actual"),
                    F.when(u < 0.25, wrong).otherwise(F.col("fault_code")).alias("predicted"))


# --- scans and the flagship ----------------------------------------------------

@query("scan_readings")
def q_scan_readings(spark, sf):
    """S1 + O1: the readings table in time order."""
    return FX.telemetry(spark, sf).orderBy(*TIME_ORDER)


@query("csv_readings")
def q_csv_readings(spark, sf):
    """Readings written as CSV files with vendor headers and without an id, in time order; read back with row numbers."""
    from ..sources.readers import read_readings
    from ..streaming.feed import workspace
    path = f"{workspace(spark, 'csv')}/readings"
    t = FX.base_readings(spark, sf)
    names = {ours: vendor for vendor, ours in SC.READING_ALIASES.items() if ours in t.columns}
    text = t.select("reading_id", *[(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") if c == "event_time" else F.col(c)).alias(v) for c, v in names.items()])
    (text.repartitionByRange(names["event_time"], "reading_id").sortWithinPartitions(names["event_time"], "reading_id")
         .drop("reading_id").write.option("header", True).csv(path))
    back = read_readings(spark, path, "csv", text.drop("reading_id").schema)
    return back.select("reading_id", "event_time", "asset_id", "site_id", "vibration", "rul_days")


@query("alert_log")
def q_alert_log(spark, sf):
    """F7 -> F10 -> J1 -> P4 -> O2."""
    return AL.alert_log(FX.telemetry(spark, sf))


# --- rules (F) -------------------------------------------------------------------

@query("health_score")
def q_health_score(spark, sf):
    """F4 + F5."""
    return with_levels(FX.base_readings(spark, sf)).select("reading_id", "health_score")


@query("alert_level_basic")
def q_alert_level_basic(spark, sf):
    """F6."""
    return with_levels(FX.base_readings(spark, sf)).select("reading_id", "alert_level_basic")


@query("alert_level_full")
def q_alert_level_full(spark, sf):
    """F7."""
    return with_levels(FX.base_readings(spark, sf)).select("reading_id", "alert_level_full")


@query("alert_score")
def q_alert_score(spark, sf):
    """F10 on every reading (no forest flag column: default 0)."""
    t = FX.base_readings(spark, sf)
    return t.select("reading_id", R.alert_score(t).alias("alert_score"))


@query("rul_band")
def q_rul_band(spark, sf):
    """F8."""
    return FX.base_readings(spark, sf).select("reading_id", "rul_days", R.rul_band(F.col("rul_days")).alias("rul_band"))


@query("health_band")
def q_health_band(spark, sf):
    """F9 on the per-asset roll-up."""
    return block_summary(spark, sf).select(
        "block_id", "avg_health", R.health_band(F.col("avg_health")).alias("health_band"),
        "avg_rul", R.rul_display_band(F.col("avg_rul")).alias("rul_band"))


@query("fault_cascade")
def q_fault_cascade(spark, sf):
    """F12 (A10 quantiles broadcast + priority cascade)."""
    return FX.telemetry(spark, sf).select("reading_id", "fault_code")


@query("maintenance_map")
def q_maintenance_map(spark, sf):
    """J2."""
    t = FX.base_readings(spark, sf)
    spec = FX.cascade_spec()
    st = S.quantile_values(t, spec)
    coded = t.withColumn("fault_code", R.fault_cascade(S.quantile_lookup(st, spec)))
    return L.map_actions(coded).select("reading_id", "fault_code", "maintenance_action")


@query("fault_catalog_join")
def q_fault_catalog_join(spark, sf):
    """J1 on every reading."""
    return L.describe_faults(FX.telemetry(spark, sf)).select(
        "reading_id", "fault_code", "fault_description", "recommended_action", "base_priority")


@query("fault_description")
def q_fault_description(spark, sf):
    """'description — action' text."""
    t = FX.telemetry(spark, sf)
    cat = L.fault_catalog(spark).withColumnRenamed("fault_code", "_code")
    j = t.join(F.broadcast(cat), F.col("fault_code") == F.col("_code"), "left")
    return j.select("reading_id", R.fault_text(F.col("fault_code"), F.col("fault_description"),
                                               F.col("recommended_action")).alias("fault_text"))


@query("sensor_quantiles")
def q_sensor_quantiles(spark, sf):
    """A10: the ten cascade quantiles, exact, by a distributed sort."""
    return S.quantiles(FX.base_readings(spark, sf), FX.cascade_spec())


@query("rul_recompute")
def q_rul_recompute(spark, sf):
    """F11 + F13 (noise 0 for the check)."""
    return relabel(FX.base_readings(spark, sf)).select("reading_id", F.col("rul_days").alias("rul_days_new"))


@query("prob_blend")
def q_prob_blend(spark, sf):
    """J3 + F14 (noise 0 for the check)."""
    return relabel(FX.base_readings(spark, sf)).select("reading_id", "fault_code", F.col("failure_prob").alias("failure_prob_new"))


@query("relabel")
def q_relabel(spark, sf):
    """F12 -> J2 -> F13 -> F14 (noise 0 for the check)."""
    return relabel(FX.base_readings(spark, sf)).select(*FX.TELEMETRY_COLUMNS)


# --- vibration samples -------------------------------------------------------------

def _vib(spark, sf):
    return vibration_features(FX.vibration_raw(spark, sf))


@query("vibration_alias")
def q_vibration_alias(spark, sf):
    """S3: vendor headers -> x, y, z, Temp, Hum."""
    from ..sources.readers import normalise_vibration
    return normalise_vibration(FX.vibration_raw(spark, sf)).select(
        "sample_id", "event_time", "asset_id", "x", "y", "z", "Temp", "Hum")


@query("vibration_folder")
def q_vibration_folder(spark, sf):
    """S2 + S3: samples written as CSV files with three spellings and orders of the header, read back as one table."""
    from ..sources.readers import read_vibration
    from ..streaming.feed import workspace
    path = f"{workspace(spark, 'samples')}/samples"
    raw = FX.vibration_raw(spark, sf).withColumn("event_time", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    spelled = {"acc": [("sample_id", "sample_id"), ("event_time", "Timestamp"), ("acc_x", "acc_x"), ("acc_y", "acc_y"), ("acc_z", "acc_z"),
                       ("temperature", "temperature"), ("humidity", "humidity")],
               "accel": [("acc_z", "Accel_Z"), ("acc_y", "Accel_Y"), ("acc_x", "Accel_X"), ("humidity", "Hum"), ("temperature", "Temp"),
                         ("event_time", "time"), ("sample_id", "sample_id")],
               "short": [("event_time", "TIME_S"), ("acc_x", " X "), ("sample_id", "sample_id"), ("acc_y", "Y"), ("acc_z", "Z"),
                         ("humidity", "HUM"), ("temperature", "TEMP")]}
    for k, (name, cols) in enumerate(spelled.items()):
        part = raw.where(F.pmod("sample_id", F.lit(3)) == k).select(*[F.col(c).alias(n) for c, n in cols])
        part.write.option("header", True).csv(f"{path}/{name}")
    back = read_vibration(spark, path, "csv")
    return back.select(F.col("sample_id").cast("long"), F.to_timestamp_ntz("Time").alias("event_time"), "x", "y", "z", "Temp", "Hum")


@query("vibration_features")
def q_vibration_features(spark, sf):
    """F1 + W1 (global halo rolling mean) + F2 + F3."""
    return _vib(spark, sf).select("sample_id", "accel_magnitude", F.round("rolling_mag", 9).alias("rolling_mag"),
                                  F.round("vibr_zscore", 8).alias("vibr_zscore"), "vibr_anomaly")


@query("vibration_downsampled")
def q_vibration_downsampled(spark, sf):
    """P11 + W3: every 3rd sample by position."""
    idx = O.row_index(_vib(spark, sf), ["event_time", "sample_id"])
    return RU.vibration_series(idx, C.DOWNSAMPLE_STEP)


@query("vibration_split")
def q_vibration_split(spark, sf):
    """P10: magnitude split into normal / anomalous series."""
    return RU.split_by_flag(_vib(spark, sf), "accel_magnitude", "vibr_anomaly").select(
        "sample_id", "normal", "anomalous")


@query("vibration_histogram")
def q_vibration_histogram(spark, sf):
    """20 equal-width bins of the magnitude, zero-filled."""
    v = FX.vibration_raw(spark, sf)
    from ..sources.readers import normalise_vibration
    v = normalise_vibration(v).withColumn("accel_magnitude", R.magnitude(F.col("x"), F.col("y"), F.col("z")))
    return RU.histogram(v, "accel_magnitude", 20)


# --- roll-ups, top-k, selectors -------------------------------------------------------

@query("block_summary")
def q_block_summary(spark, sf):
    """A1."""
    return block_summary(spark, sf)


@query("location_summary")
def q_location_summary(spark, sf):
    """A2."""
    return RU.site_summary(readings(spark, sf))


@query("alert_distribution")
def q_alert_distribution(spark, sf):
    """A3."""
    return RU.distribution(scored(spark, sf), "alert_level_basic")


@query("failure_distribution")
def q_failure_distribution(spark, sf):
    """A4."""
    return RU.distribution(FX.telemetry(spark, sf), "fault_code")


@query("maintenance_distribution")
def q_maintenance_distribution(spark, sf):
    """A5."""
    return RU.distribution(FX.telemetry(spark, sf), "maintenance_action")


@query("alert_summary")
def q_alert_summary(spark, sf):
    """A6."""
    s = RU.alert_summary(AL.alert_log(FX.telemetry(spark, sf), sort=False))
    return s.withColumn("avg_score", F.round("avg_score", 9))


@query("kpi_rollup")
def q_kpi_rollup(spark, sf):
    """A7 over A1."""
    k = RU.kpi(block_summary(spark, sf))
    return k.withColumn("avg_health", F.round("avg_health", 9)).withColumn("avg_rul", F.round("avg_rul", 9))


@query("alerts_top50")
def q_alerts_top50(spark, sf):
    """O3 + P8."""
    return RU.top_alerts(AL.alert_log(FX.telemetry(spark, sf), sort=False), 50)


@query("alerts_topk")
def q_alerts_topk(spark, sf):
    """O4 (k = 5)."""
    return RU.top_alerts(AL.alert_log(FX.telemetry(spark, sf), sort=False), 5)


@query("shown_level_counts")
def q_shown_level_counts(spark, sf):
    """Level counts of the 50 shown alerts."""
    return RU.level_counts(RU.top_alerts(AL.alert_log(FX.telemetry(spark, sf), sort=False), 50))


@query("alerts_by_level")
def q_alerts_by_level(spark, sf):
    """P5: CRITICAL only."""
    log = AL.alert_log(FX.telemetry(spark, sf), sort=False)
    return RU.filter_level(log, "CRITICAL").select(
        "reading_id", "asset_id", "site_id", "alert_level_full", "alert_score", "fault_description")


@query("selected_blocks")
def q_selected_blocks(spark, sf):
    """Assets of the sites in one region (left-semi join on a key table)."""
    nation, region = FX.table(spark, sf, "nation"), FX.table(spark, sf, "region")
    sites = (nation.join(region.where(F.col("r_name") == "AMERICA"),
                         F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
             .select(F.col("n_name").alias("site_id")))
    return RU.asset_summary(RU.filter_assets(readings(spark, sf), sites=sites), flag_col="edge_flag")


@query("block_detail")
def q_block_detail(spark, sf):
    """O7 + P7: asset roll-up in natural-number order."""
    return RU.asset_detail(block_summary(spark, sf))


@query("time_series_downsampled")
def q_time_series_downsampled(spark, sf):
    """P9 + W3 + F16: every 3rd reading in time order."""
    idx = O.row_index(_columns(with_levels(FX.base_readings(spark, sf)), *RU.TIME_SERIES_COLUMNS), TIME_ORDER)
    return RU.time_series(idx, C.DOWNSAMPLE_STEP)


# --- order layer ---------------------------------------------------------------------

def _columns(df: DataFrame, *more: str) -> DataFrame:
    """The time order and these columns: ordered operators write what they are given to the shared folder."""
    return df.select(*TIME_ORDER, *more)


@query("rolling_mean_30")
def q_rolling_mean_30(spark, sf):
    """W1 per asset (halo plan: no task holds a whole asset)."""
    r = O.rolling(_columns(FX.base_readings(spark, sf), "asset_id", "vibration"), "vibration", "vib_roll30", TIME_ORDER, by="asset_id", w=30)
    return r.select("reading_id", "asset_id", F.round("vib_roll30", 10).alias("vib_roll30"))


@query("sequences_30")
def q_sequences_30(spark, sf):
    """The 30 readings before each reading of the same asset (own row excluded)."""
    s = O.preceding_list(_columns(FX.base_readings(spark, sf), "asset_id", "vibration", "rul_days"), ["vibration"], "seq", TIME_ORDER, by="asset_id",
                         n=C.SEQUENCE_LENGTH)
    return s.select("reading_id", "asset_id", F.size("seq").cast("long").alias("seq_len"),
                    F.col("seq")[0]["vibration"].alias("first_vibration"),
                    F.col("seq")[C.SEQUENCE_LENGTH - 1]["vibration"].alias("last_vibration"),
                    F.col("rul_days").alias("target"))


@query("time_split")
def q_time_split(spark, sf):
    """First 80 % of readings in time order train, rest test."""
    return O.time_split(_columns(FX.base_readings(spark, sf)), TIME_ORDER, 0.2).select("reading_id", "row_idx", "is_test")


@query("stratified_split")
def q_stratified_split(spark, sf):
    """Exact 20 % per fault class by hashed rank."""
    return O.stratified_cut(FX.telemetry(spark, sf).select("reading_id", "fault_code"), "fault_code", "reading_id", 0.2).select(
        "reading_id", "fault_code", "is_test")


@query("rul_scatter")
def q_rul_scatter(spark, sf):
    """First 200 test points (time order) of actual vs predicted RUL."""
    both = relabel(FX.base_readings(spark, sf).withColumn("actual", F.col("rul_days"))).select(
        *TIME_ORDER, F.col("actual").alias("rul_days"), F.col("rul_days").alias("rul_new"))
    split, _ = O.time_cut(both, TIME_ORDER, 0.2)
    first = O.first_n(split.where(F.col("is_test")), TIME_ORDER, 200)
    test = first.withColumn("position", (F.row_number().over(Window.orderBy(*TIME_ORDER)) - 1).cast("long"))  # of 200 rows
    return test.select(
        "position", F.round("rul_days", 1).alias("actual"), F.round("rul_new", 1).alias("predicted"))


# --- features and chains ------------------------------------------------------------

@query("label_encode")
def q_label_encode(spark, sf):
    """M1: alphabetical integer codes."""
    out, _ = FE.label_encode(FX.telemetry(spark, sf), C.CATEGORICAL_COLUMNS)
    return out.select("reading_id", *[f"{c}_enc" for c in C.CATEGORICAL_COLUMNS])


@query("standard_scale")
def q_standard_scale(spark, sf):
    """M3: population z-scores of the 8 forest features."""
    out = FE.standard_scale_expr(FX.base_readings(spark, sf), SC.ANOMALY_FEATURES)
    return out.select("reading_id", *[F.round(f"{c}_std", 9).alias(f"{c}_std") for c in SC.ANOMALY_FEATURES])


MINMAX_CHECK_COLS = ["vibration", "temperature", "humidity", "age_days", "rul_days"]


@query("minmax_scale")
def q_minmax_scale(spark, sf):
    """M4: min-max fitted on the time-split training rows, applied to all."""
    t = O.time_cut(_columns(FX.base_readings(spark, sf), *MINMAX_CHECK_COLS), TIME_ORDER, 0.2)[0].withColumn("_train", ~F.col("is_test"))
    out = FE.minmax_scale_expr(t, MINMAX_CHECK_COLS, "_train")
    return out.select("reading_id", "is_test", *[F.round(f"{c}_mm", 9).alias(f"{c}_mm") for c in MINMAX_CHECK_COLS])


@query("feature_projection")
def q_feature_projection(spark, sf):
    """The RUL features present in the table."""
    return FE.project_features(FX.telemetry(spark, sf), SC.RUL_FEATURES, keep=["reading_id"])


@query("feature_fill")
def q_feature_fill(spark, sf):
    """All classifier features in trained order, absent ones as 0."""
    return FE.fill_features(FX.telemetry(spark, sf), SC.FAULT_FEATURES, keep=["reading_id"])


@query("class_weights")
def q_class_weights(spark, sf):
    """Balanced class weights per reading."""
    w = L.class_weights(FX.telemetry(spark, sf), "fault_code")
    return w.select("reading_id", "fault_code", F.round("weight", 10).alias("weight"))


@query("preprocess")
def q_preprocess(spark, sf):
    """Encodings + health score + 2-signal level."""
    return AL.preprocess(FX.telemetry(spark, sf))


# --- metrics ----------------------------------------------------------------------------

@query("anomaly_eval")
def q_anomaly_eval(spark, sf):
    """A11 on the rule flag."""
    return M.anomaly_eval(readings(spark, sf), "edge_flag")


@query("regression_metrics")
def q_regression_metrics(spark, sf):
    """A12 of the recomputed RUL against the input RUL."""
    d = relabel(FX.base_readings(spark, sf).withColumn("y", F.col("rul_days"))).select("y", F.col("rul_days").alias("p"))
    m = M.regression_metrics(d, "y", "p")
    return m.select(*[F.round(c, 9).alias(c) for c in m.columns])


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    """A13, dense over the label union."""
    return M.confusion(pseudo_predictions(spark, sf), "actual", "predicted")


@query("classification_report")
def q_classification_report(spark, sf):
    """A14."""
    r = M.class_report(pseudo_predictions(spark, sf), "actual", "predicted")
    return r.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("accuracy")
def q_accuracy(spark, sf):
    """A15."""
    a = M.accuracy(pseudo_predictions(spark, sf), "actual", "predicted")
    return a.select(F.round("accuracy", 12).alias("accuracy"))


# --- models (rows-only checks: not SQL-expressible) -------------------------------------

def model_input(spark, sf, noise: bool = True) -> DataFrame:
    """Relabelled readings with their forest flag (as the supervised models are trained in the pipeline).

    Written once: splits, scalers and learners read them many times, a few columns each.
    """
    from ..ml import iforest
    return materialise(relabel(iforest.fit_transform(FX.base_readings(spark, sf))[1], noise=noise), "model-input")


@query("isolation_forest")
def q_isolation_forest(spark, sf):
    """M5 + M6: distributed isolation forest, 200 trees, 8 % contamination."""
    from ..ml import iforest
    t = FX.telemetry(spark, sf)
    _, scored = iforest.fit_transform(t)
    return scored.select("reading_id", "if_score", "if_label", "if_flag")


@query("anomaly_eval_forest")
def q_anomaly_eval_forest(spark, sf):
    """A11 on the forest flags."""
    from ..ml import iforest
    t = FX.telemetry(spark, sf)
    return M.anomaly_eval(iforest.fit_transform(t)[1], "if_flag")


@query("rul_model_eval")
def q_rul_model_eval(spark, sf):
    """M7: boosted-tree RUL on a time split; MAE / RMSE / R² of the test rows."""
    from ..ml import models as ML
    res = ML.fit_rul(model_input(spark, sf))
    return res.metrics.select(F.lit("GBTRegressor").alias("model"), "*",
                              F.lit(res.train_time_s).alias("train_time_s"))


@query("feature_importance")
def q_feature_importance(spark, sf):
    """M13 + O5: RUL model importances, descending."""
    from ..ml import models as ML
    res = ML.fit_rul(model_input(spark, sf))
    return ML.feature_importance(spark, res.model, res.features)


@query("fault_model_eval")
def q_fault_model_eval(spark, sf):
    """M9: random forest (balanced weights, stratified split) — per-class report."""
    from ..ml import models as ML
    res = ML.fit_fault(model_input(spark, sf))
    acc, report, _ = ML.fault_metrics(res.predictions)
    return report.withColumn("accuracy", F.lit(acc.first()[0]))


@query("fault_confusion")
def q_fault_confusion(spark, sf):
    """A13 on the forest's test predictions (real labels)."""
    from ..ml import models as ML
    res = ML.fit_fault(model_input(spark, sf))
    return ML.fault_metrics(res.predictions)[2]


@query("fault_predictions")
def q_fault_predictions(spark, sf):
    """Predicted fault, confidence and text for the test rows."""
    from ..ml import models as ML
    res = ML.fit_fault(model_input(spark, sf))
    return res.predictions.select("reading_id", "fault_code", "predicted_fault", "confidence", "fault_text")


# --- streaming (batch twins in SQL) ------------------------------------------------------

STREAM_FILES = 10
STREAM_FILES_PER_TRIGGER = 2


def _stream_state(spark, sf):
    from ..streaming import feed as SF
    t = FX.telemetry(spark, sf)
    ws = SF.workspace(spark, "feed")
    SF.write_feed_files(t, f"{ws}/source", STREAM_FILES)
    sdf = SF.read_feed(spark, f"{ws}/source", t.schema, STREAM_FILES_PER_TRIGGER)
    SF.run_state_feed(sdf, f"{ws}/state", f"{ws}/chk_state")
    return SF.current_lists(spark, f"{ws}/state")


@query("stream_alerts")
def q_stream_alerts(spark, sf):
    """R1 + R2 (+ R6 availableNow): alert feed of a file stream, deduplicated."""
    from ..streaming import feed as SF
    t = FX.telemetry(spark, sf)
    ws = SF.workspace(spark, "alerts")
    SF.write_feed_files(t, f"{ws}/source", STREAM_FILES)
    sdf = SF.read_feed(spark, f"{ws}/source", t.schema, STREAM_FILES_PER_TRIGGER)
    SF.run_alert_feed(sdf, f"{ws}/sink", f"{ws}/chk")
    return spark.read.parquet(f"{ws}/sink")


@query("stream_lifecycle")
def q_stream_lifecycle(spark, sf):
    """Alerts of a feed that was paused before its third trigger and resumed, and of one reset; how often each was delivered."""
    from ..streaming import feed as SF
    t = FX.telemetry(spark, sf)
    ws = SF.workspace(spark, "lifecycle")
    SF.write_feed_files(t, f"{ws}/source", STREAM_FILES)
    feed = lambda: SF.read_feed(spark, f"{ws}/source", t.schema, STREAM_FILES_PER_TRIGGER)
    SF.run_alert_triggers(feed(), f"{ws}/sink", f"{ws}/chk", stop_before=2)
    SF.run_alert_triggers(feed(), f"{ws}/sink", f"{ws}/chk")
    SF.run_alert_triggers(feed(), f"{ws}/reset", f"{ws}/chk_reset")
    runs = [spark.read.parquet(f"{ws}/{name}").withColumn("run", F.lit(name)) for name in ("sink", "reset")]
    return runs[0].unionByName(runs[1]).groupBy("reading_id", "asset_id", "alert_level").agg(
        F.count_if(F.col("run") == "sink").alias("n_resumed"), F.count_if(F.col("run") == "reset").alias("n_reset"))


@query("stream_last50")
def q_stream_last50(spark, sf):
    """The newest 50 readings of the feed (from per-asset bounded state)."""
    from ..streaming import feed as SF
    return SF.last_readings(_stream_state(spark, sf))


@query("stream_asset_last50")
def q_stream_asset_last50(spark, sf):
    """R3 per asset: each asset's newest 50 readings with their rank."""
    from ..streaming import feed as SF
    return SF.last_readings(_stream_state(spark, sf), per_asset=True)


@query("stream_last4")
def q_stream_last4(spark, sf):
    """The newest 4 alerts, newest first."""
    from ..streaming import feed as SF
    return SF.last_alerts(_stream_state(spark, sf))


@query("stream_latest")
def q_stream_latest(spark, sf):
    """The latest reading of each asset."""
    from ..streaming import feed as SF
    return SF.latest(_stream_state(spark, sf))


@query("fault_predictions_reloaded")
def q_fault_predictions_reloaded(spark, sf):
    """K3 + M10 + P3: raw readings scored by a classifier that was saved and loaded again."""
    from ..ml import models as ML
    from ..streaming.feed import workspace
    path = f"{workspace(spark, 'fault-model')}/model"
    ML.save_fault(spark, ML.fit_fault(model_input(spark, sf)), path)
    out = ML.load_fault(spark, path).predict(FX.telemetry(spark, sf))
    return out.select("reading_id", "predicted_fault", F.round("confidence", 6).alias("confidence"), "fault_text")


# --- pipeline / dashboard (rows-only) ---------------------------------------------------

@query("dashboard_sections")
def q_dashboard_sections(spark, sf):
    """M17 + K2 + S5: full pipeline, sections written as JSON and read back."""
    from ..streaming.feed import workspace
    from .dashboard import run_batch_job, save_sections, section_counts
    res = run_batch_job(spark, relabel(FX.telemetry(spark, sf), noise=True), FX.vibration_raw(spark, sf))
    root = workspace(spark, "dashboard")
    save_sections(res, root)
    return section_counts(spark, root, res.sections)


DOCUMENT_CHUNK_ROWS = 40


@query("document_chunks")
def q_document_chunks(spark, sf):
    """K2 + S5: the asset summary written as an ordered document in chunks, checked against its manifest and read back."""
    from ..sources.sinks import read_chunked, write_chunked
    from ..streaming.feed import workspace
    path = f"{workspace(spark, 'document')}/block_summary"
    write_chunked(block_summary(spark, sf), path, ["block_id"], DOCUMENT_CHUNK_ROWS)
    return read_chunked(spark, path)


@query("model_comparison")
def q_model_comparison(spark, sf):
    """One row per trained model (boosted RUL, forest classifier)."""
    from ..ml import models as ML
    from .dashboard import model_comparison
    inp = model_input(spark, sf)
    return model_comparison(spark, ML.fit_rul(inp), ML.fit_fault(inp))


@query("window_model_comparison")
def q_window_model_comparison(spark, sf):
    """The rows of the windowed models (boosted RUL, perceptron classifier), of one scored table."""
    from .dashboard import fit_windowed, windowed_rows
    return M.comparison(spark, windowed_rows(*fit_windowed(model_input(spark, sf))))


@query("window_rul_eval")
def q_window_rul_eval(spark, sf):
    """RUL from the previous 30 readings of the asset (window summaries + GBT)."""
    from ..ml import sequence_models as SM
    _, metrics, _, secs = SM.fit_window_rul(model_input(spark, sf))
    return metrics.select(F.lit("WindowGBT").alias("model"), "*", F.lit(secs).alias("train_time_s"))


@query("window_fault_eval")
def q_window_fault_eval(spark, sf):
    """Fault class from the previous 30 readings (flattened window, perceptron)."""
    from ..ml import sequence_models as SM
    _, acc, _, secs = SM.fit_window_fault(model_input(spark, sf))
    return acc.select(F.lit("WindowMLP").alias("model"), "accuracy", F.lit(secs).alias("train_time_s"))


def _reloaded_window_predictions(spark, sf, fit, name):
    """Every reading with 30 predecessors, scored by a windowed model that was saved and loaded, from an empty store."""
    from dataclasses import replace

    from ..ml import sequence_models as SM
    from ..streaming.feed import workspace
    path = f"{workspace(spark, name)}/model"
    inp = model_input(spark, sf)
    fit(inp)[0].save(path)
    model = SM.WindowModel.load(spark, path)
    return replace(model, store=model.store.limit(0)).predict(inp)


@query("window_rul_predictions")
def q_window_rul_predictions(spark, sf):
    """M11 predict + K3: readings with a window and whether their predicted RUL and band are there."""
    from ..ml import sequence_models as SM
    out = _reloaded_window_predictions(spark, sf, SM.fit_window_rul, "window-rul")
    return out.select("reading_id", "asset_id", (F.col("rul_pred").isNotNull() & F.col("rul_pred_band").isNotNull()).alias("predicted"))


@query("window_fault_predictions")
def q_window_fault_predictions(spark, sf):
    """M12 predict + K3: readings with a window and whether they have a fault and a softmax confidence in (0, 1]."""
    from ..ml import sequence_models as SM
    out = _reloaded_window_predictions(spark, sf, SM.fit_window_fault, "window-fault")
    return out.select("reading_id", "asset_id", (F.col("predicted_fault").isNotNull() & (F.col("confidence") > 0) & (F.col("confidence") <= 1)).alias("predicted"))


def _shap(spark, sf, noise: bool = True):
    """Contributions of every test row, written once: the views read them more than once."""
    from ..ml import models as ML
    from ..ml import shap as SH
    res = ML.fit_fault(model_input(spark, sf, noise))
    return cut_lineage(SH.shap_long(spark, res.model, res.predictions, res.features))


@query("shap_long")
def q_shap_long(spark, sf):
    """X1 + J7: contributions of every test row (predicted class)."""
    return _shap(spark, sf)


@query("shap_additivity")
def q_shap_additivity(spark, sf):
    """X1 check (noise 0): base + contributions equals the model's probability for every test row."""
    from ..ml import shap as SH
    return SH.additivity(_shap(spark, sf, noise=False))


@query("shap_importance")
def q_shap_importance(spark, sf):
    """Mean |contribution| per feature."""
    from ..ml import shap as SH
    return SH.importance(_shap(spark, sf))


@query("shap_points")
def q_shap_points(spark, sf):
    """Beeswarm points with per-feature scaled colour value."""
    from ..ml import shap as SH
    return SH.points(_shap(spark, sf))


@query("shap_waterfall")
def q_shap_waterfall(spark, sf):
    """Top-12 contributions per explained row with running totals."""
    from ..ml import shap as SH
    return SH.waterfall(_shap(spark, sf), 12)
