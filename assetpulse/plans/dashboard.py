"""The batch pipeline and the dashboard sections.

preprocess (M14) -> isolation forest flags (M5/M6) -> RUL model (M7) ->
fault model (M9) -> alert log (M15) -> sections (A1-A9, O3, P9-P11, W8,
A13-A16, M13). The scored readings are checkpointed once to the shared
checkpoint folder (lineage cut; every section reads that table), and each
section is a DataFrame whose size is bounded by design (per asset, per
site, per class, top-k, or a stride of the series) except the two
downsampled series, which stay distributed and are written as JSON lines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..operators import metrics as M
from ..operators import order as O
from ..operators import rollups as RU
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources import sinks as K
from . import alerts as AL
from .vibration import vibration_features

TIME_ORDER = ["event_time", "reading_id"]


@dataclass
class BatchResult:
    sections: dict[str, DataFrame]
    scored: DataFrame
    alert_log: DataFrame
    models: dict = field(default_factory=dict)


def run_batch_job(spark: SparkSession, readings: DataFrame, vibration_raw: DataFrame,
                  gbt_iters: int = C.RUL_GBT["iters"], rf_trees: int = C.FAULT_RF["trees"],
                  forest_trees: int = C.IFOREST["trees"], windowed: bool = False, window_iters: int | None = None) -> BatchResult:
    """Scores, models, alert log and sections of one run.

    ``windowed`` trains M11 (``window_iters`` boosting iterations, by default ``gbt_iters``)
    and M12 too: two more rows of ``model_comparison``, their scatter and all accuracies.
    """
    from ..ml import iforest
    from ..ml import models as ML
    ensure_checkpoint_dir(spark)
    pre = AL.preprocess(readings)
    forest, flagged = iforest.fit_transform(pre, trees=forest_trees)
    scored = cut_lineage(flagged.drop("if_label"))
    rul = ML.fit_rul(scored, iters=gbt_iters)
    fault = ML.fit_fault(scored.drop("fault_code_enc", "hmi_alert_code_enc"), trees=rf_trees)
    log = AL.alert_log(scored, sort=False)
    vib = vibration_features(vibration_raw)
    acc, report, cm = ML.fault_metrics(fault.predictions)
    models = {"forest": forest, "rul": rul, "fault": fault}
    accuracies = [("RandomForestClassifier", acc)]
    window_sections, window_rows = {}, []
    if windowed:
        window_rul, window_fault = fit_windowed(scored, gbt_iters if window_iters is None else window_iters)
        models |= {"window_rul": window_rul[0], "window_fault": window_fault[0]}
        window_rows = windowed_rows(window_rul, window_fault)
        accuracies.append(("WindowMLP", window_fault[1]))
        window_sections["window_rul_scatter"] = scatter_points(window_rul[2], "label", "pred")
    comparison = model_comparison(spark, rul, fault, window_rows)
    named = [a.select(F.lit(name).alias("model"), "accuracy") for name, a in accuracies]
    window_sections["model_accuracies"] = named[0] if len(named) == 1 else named[0].unionByName(named[1])
    summary = RU.asset_summary(scored, flag_col="if_flag")
    scatter = scatter_points(rul.predictions, "rul_days", "rul_pred", rul.n_train)
    sections = {
        "block_summary": summary,
        "location_summary": RU.site_summary(scored),
        "time_series": RU.time_series(O.row_index(scored.select(*TIME_ORDER, *RU.TIME_SERIES_COLUMNS), TIME_ORDER), C.DOWNSAMPLE_STEP),
        "alerts": RU.top_alerts(log, 50),
        "vibration_accel": RU.vibration_series(O.row_index(vib, ["event_time", "sample_id"]), C.DOWNSAMPLE_STEP),
        "model_comparison": comparison,
        "classification_report": report,
        "confusion_matrix": cm,
        "rul_scatter": scatter,
        "feature_importance": ML.feature_importance(spark, fault.model, fault.features),
        "alert_distribution": RU.distribution(scored, "alert_level_basic"),
        "failure_distribution": RU.distribution(scored, "fault_code"),
        "maintenance_distribution": RU.distribution(scored, "maintenance_action"),
        "kpi": RU.kpi(summary),
        "alert_summary": RU.alert_summary(log),
        **window_sections,
    }
    return BatchResult(sections, scored, log, models)


def scatter_points(predictions: DataFrame, actual: str, predicted: str, first_position: int = 0) -> DataFrame:
    """The first 200 test rows in time order, rounded as displayed."""
    first = O.first_n(predictions.select(*TIME_ORDER, actual, predicted), TIME_ORDER, 200)
    position = F.row_number().over(Window.orderBy(*TIME_ORDER)) + F.lit(first_position - 1)  # of 200 rows
    return first.select(F.round(actual, 1).alias("actual"), F.round(predicted, 1).alias("predicted"),
                        position.cast("long").alias("row_idx"))


def fit_windowed(scored: DataFrame, iters: int = C.RUL_GBT["iters"]):
    """M11 and M12 on one scored table."""
    from ..ml import sequence_models as SM
    return SM.fit_window_rul(scored, iters=iters), SM.fit_window_fault(scored.drop("fault_code_enc", "hmi_alert_code_enc"))


def windowed_rows(window_rul, window_fault) -> list[dict]:
    """The rows of the windowed models (of ``fit_windowed``)."""
    m = window_rul[1].first()
    layers = window_fault[0].model.stages[-1]
    return [
        {"model": "WindowGBT", "task": "RUL Prediction", "metric": "MAE", "value": round(m.mae, 2), "r2": round(m.r2, 4),
         "rmse": round(m.rmse, 2), "train_time_s": round(window_rul[3], 2)},
        {"model": "WindowMLP", "task": "Fault Classification", "metric": "Accuracy",
         "value": round(window_fault[1].first()[0] * 100, 2), "train_time_s": round(window_fault[3], 2),
         "epochs": layers.getMaxIter()},
    ]


# Sections whose size does not grow with the readings (per class, top-k,
# distributions): they may also be gathered into one document.
BOUNDED_SECTIONS = ["alerts", "model_comparison", "classification_report",
                    "confusion_matrix", "rul_scatter", "feature_importance", "alert_distribution",
                    "failure_distribution", "maintenance_distribution", "kpi", "alert_summary", "window_rul_scatter",
                    "model_accuracies"]

# Sections that grow with the assets, the sites or the readings, and their order: documents in chunks.
CHUNKED_SECTIONS = {"block_summary": "block_id", "location_summary": "location_id", "time_series": "row_idx",
                    "vibration_accel": "row_idx"}


def model_comparison(spark: SparkSession, rul, fault, more: list[dict] | None = None) -> DataFrame:
    """One row per trained model (metric values rounded as displayed), ``more`` rows after them."""
    from ..ml import models as ML
    rul_m = rul.metrics.first()
    acc = ML.fault_metrics(fault.predictions)[0].first()[0]
    return M.comparison(spark, [
        {"model": "GBTRegressor", "task": "RUL Prediction", "metric": "MAE", "value": round(rul_m.mae, 2),
         "r2": round(rul_m.r2, 4), "rmse": round(rul_m.rmse, 2), "train_time_s": round(rul.train_time_s, 2)},
        {"model": "RandomForestClassifier", "task": "Fault Classification", "metric": "Accuracy",
         "value": round(acc * 100, 2), "train_time_s": round(fault.train_time_s, 2)},
        *(more or []),
    ])


def save_run(result: BatchResult, root: str) -> None:
    """M17's outputs: the sections, the alert log as sorted CSV (K1) and every trained model (K3)."""
    from ..ml import models as ML
    spark = result.scored.sparkSession
    save_sections(result, root)
    K.write_table(result.alert_log, f"{root}/alert_log", fmt="csv", sort_by=[F.col("alert_score").desc(), "reading_id"])
    result.models["forest"].save(spark, f"{root}/models/forest")
    ML.save_model(result.models["rul"].model, f"{root}/models/rul")
    ML.save_fault(spark, result.models["fault"], f"{root}/models/fault")
    for name in ("window_rul", "window_fault"):
        if name in result.models:
            result.models[name].save(f"{root}/models/{name}")


def save_sections(result: BatchResult, root: str) -> None:
    """K2: each section as JSON lines under ``root/<section>``, plus one JSON
    document row holding every bounded section (``root/document``), plus the
    sections that may grow as ordered chunks with a manifest (``root/chunked``)."""
    K.write_sections(result.sections, root)
    spark = next(iter(result.sections.values())).sparkSession
    # Read back with the known schemas (no schema-inference pass per section).
    written = {n: spark.read.schema(result.sections[n].schema).json(f"{root}/{n}")
               for n in BOUNDED_SECTIONS if n in result.sections}
    document(written).write.mode("overwrite").json(f"{root}/document")
    for name, key in CHUNKED_SECTIONS.items():
        if name in result.sections:
            rows = spark.read.schema(result.sections[name].schema).json(f"{root}/{name}")
            K.write_chunked(rows, f"{root}/chunked/{name}", [key])


def document(sections: dict[str, DataFrame]) -> DataFrame:
    """One row, one JSON-array column per bounded section (the per-sample
    series stay distributed as JSON lines). ``save_sections`` passes the
    sections as written, so they are read back rather than recomputed."""
    names = [n for n in BOUNDED_SECTIONS if n in sections]
    parts = [K.section_document(sections[n], n).select(F.lit(n).alias("section"), F.col(n).alias("doc"))
             for n in names]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # one (section, json) row per bounded section, pivoted into a single row
    return rows.groupBy().pivot("section", names).agg(F.first("doc"))


def section_counts(spark: SparkSession, root: str, sections) -> DataFrame:
    """S5 round trip: read every written section back and count its rows.

    ``sections`` is the dict of section DataFrames (their schemas are used for
    the read, no inference pass) or a list of names (schemas inferred)."""
    if isinstance(sections, dict):
        readers = {n: spark.read.schema(df.schema) for n, df in sections.items()}
    else:
        readers = {n: spark.read for n in sections}
    parts = [r.json(f"{root}/{n}").agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(n).alias("section"), "n_rows") for n, r in readers.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
