"""M17 end to end on the smallest tables: every section is produced, written
as JSON and read back (the reference's artefact checks, as row counts)."""

import math
import uuid

from assetpulse.ml import iforest
from assetpulse.ml import models as ML
from assetpulse.ml import sequence_models as SM
from assetpulse.plans.dashboard import CHUNKED_SECTIONS, run_batch_job, save_run, save_sections, section_counts
from assetpulse.plans.relabel import relabel
from assetpulse.session import ensure_checkpoint_dir
from assetpulse.sources import fixtures as FX
from assetpulse.sources import readers as RD
from assetpulse.sources import sinks as K

SF = "/root/testdata/sf0.001"


def test_pipeline_sections(spark):
    res = run_batch_job(spark, relabel(FX.telemetry(spark, SF), noise=True), FX.vibration_raw(spark, SF),
                       gbt_iters=5, rf_trees=10, forest_trees=50)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-dash-{uuid.uuid4().hex[:8]}"
    save_sections(res, root)
    counts = {r.section: r.n_rows for r in section_counts(spark, root, list(res.sections)).collect()}
    assert set(counts) == set(res.sections)
    assert counts["alerts"] == 50 and counts["model_comparison"] == 2
    assert counts["block_summary"] == res.scored.select("asset_id").distinct().count()
    side = math.isqrt(counts["confusion_matrix"])
    assert side * side == counts["confusion_matrix"] and side >= 2  # dense over the label union
    assert all(n > 0 for n in counts.values())
    doc = spark.read.json(f"{root}/document")
    assert doc.count() == 1 and "alerts" in doc.columns and "time_series" not in doc.columns
    flags = res.scored.agg({"if_flag": "avg"}).first()[0]
    assert 0.04 <= flags <= 0.12


def test_run_with_windowed_models_and_its_outputs(spark):
    res = run_batch_job(spark, relabel(FX.telemetry(spark, SF), noise=True), FX.vibration_raw(spark, SF),
                        gbt_iters=3, rf_trees=5, forest_trees=20, windowed=True)
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-run-{uuid.uuid4().hex[:8]}"
    save_run(res, root)
    rows = {r.model: r for r in spark.read.json(f"{root}/model_comparison").collect()}
    assert set(rows) == {"GBTRegressor", "RandomForestClassifier", "WindowGBT", "WindowMLP"}
    assert rows["WindowGBT"].metric == "MAE" and rows["WindowMLP"].epochs > 0
    accuracy = {r.model: r.accuracy for r in spark.read.json(f"{root}/model_accuracies").collect()}
    assert all(abs(100 * accuracy[m] - rows[m].value) <= 0.0051 for m in ("RandomForestClassifier", "WindowMLP"))
    scatter = spark.read.json(f"{root}/window_rul_scatter")
    assert 0 < scatter.count() <= 200 and set(scatter.columns) == {"actual", "predicted", "row_idx"}
    log = RD.read_alert_log(spark, f"{root}/alert_log", res.alert_log.schema)
    assert log.count() == res.alert_log.count() > 0
    for name, key in CHUNKED_SECTIONS.items():
        back = K.read_chunked(spark, f"{root}/chunked/{name}")
        assert back.count() == spark.read.text(f"{root}/{name}").count() > 0 and key in back.columns
    forest = iforest.IsolationForestModel.load(spark, f"{root}/models/forest")
    assert forest.transform(res.scored.drop("if_score", "if_label", "if_flag")).select("if_flag").count() == res.scored.count()
    assert ML.predict_rul(ML.load_model(f"{root}/models/rul"), res.scored.limit(5)).count() == 5
    assert ML.load_fault(spark, f"{root}/models/fault").predict(res.scored.limit(5)).count() == 5
    for name in ("window_rul", "window_fault"):
        assert SM.WindowModel.load(spark, f"{root}/models/{name}").task == name.split("_")[1]
