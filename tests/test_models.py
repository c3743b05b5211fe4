"""Models: the reference's band checks (flag rate, positive RUL, accuracy in
0-1), persistence round-trips, and feature-importance shape."""

import uuid

import pytest
from pyspark.sql import functions as F

from assetpulse.ml import iforest
from assetpulse.ml import models as ML
from assetpulse.plans.relabel import relabel
from assetpulse.session import ensure_checkpoint_dir
from assetpulse.sources import fixtures as FX

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def readings(spark):
    return FX.telemetry(spark, SF).persist()


@pytest.fixture(scope="module")
def forest(readings):
    return iforest.fit(readings, trees=100)


def _fresh(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-{name}-{uuid.uuid4().hex[:8]}"


def test_forest_flag_rate(forest, readings):
    out = forest.transform(readings)
    rate = out.agg(F.avg("if_flag")).first()[0]
    assert 0.06 <= rate <= 0.10
    assert out.count() == readings.count()
    assert set(r[0] for r in out.select("if_label").distinct().collect()) <= {-1, 1}


def test_forest_node_table_bounded(forest):
    assert len(forest.nodes) <= 100 * (2 * forest.psi - 1)
    assert forest.nodes["depth"].max() <= 8


def test_forest_save_load_same_scores(spark, forest, readings):
    path = _fresh(spark, "iforest")
    forest.save(spark, path)
    again = iforest.IsolationForestModel.load(spark, path)
    a = forest.transform(readings).select("reading_id", "if_score").orderBy("reading_id").toPandas()
    b = again.transform(readings).select("reading_id", "if_score").orderBy("reading_id").toPandas()
    assert (a.if_score.values == b.if_score.values).all()


def test_rul_model_quality_and_roundtrip(spark, readings):
    res = ML.fit_rul(relabel(readings, noise=True), iters=10)
    m = res.metrics.first()
    assert m.mae > 0 and m.rmse >= m.mae and m.r2 > 0.5
    preds = res.predictions.select("rul_pred").toPandas()
    assert (preds.rul_pred > 0).mean() > 0.8
    imp = ML.feature_importance(spark, res.model, res.features).toPandas()
    assert len(imp) == len(res.features) and imp.importance.sum() == pytest.approx(1.0, abs=1e-3)
    path = _fresh(spark, "gbt")
    ML.save_model(res.model, path)
    again = ML.load_model(path)
    a = ML.predict_rul(res.model, res.predictions.drop("rul_pred")).select("rul_pred").toPandas()
    b = ML.predict_rul(again, res.predictions.drop("rul_pred")).select("rul_pred").toPandas()
    assert (a.values == b.values).all()


def test_fault_classifier_accuracy_and_labels(spark, readings):
    res = ML.fit_fault(relabel(readings, noise=True), trees=20, depth=8)
    acc, report, cm = ML.fault_metrics(res.predictions)
    a = acc.first()[0]
    assert 0 <= a <= 1 and a > 0.8
    assert res.labels == sorted(res.labels)  # alphabetical: C1, C10, C2, ...
    labels = {r[0] for r in res.predictions.select("predicted_fault").distinct().collect()}
    assert labels <= set(res.labels)
    assert cm.count() == len({r[0] for r in cm.select("actual").distinct().collect()}) ** 2
    conf = res.predictions.agg(F.min("confidence"), F.max("confidence")).first()
    assert 0 < conf[0] <= conf[1] <= 1


def test_saved_classifier_scores_raw_readings(spark, readings):
    res = ML.fit_fault(relabel(readings, noise=True), trees=10, depth=5)
    path = _fresh(spark, "fault")
    ML.save_fault(spark, res, path)
    again = ML.load_fault(spark, path)
    raw = readings.drop("hmi_alert_code_enc", res.features[0]).withColumn(
        "hmi_alert_code", F.when(F.col("reading_id") % 7 == 0, F.lit("never seen")).otherwise(F.col("hmi_alert_code")))
    a = ML.predict_fault(res, raw)
    b = again.predict(raw)
    assert a.select("reading_id", "predicted_fault", "confidence").exceptAll(b.select("reading_id", "predicted_fault", "confidence")).isEmpty()
    assert b.count() == raw.count()
    # Rows with all features get what the fit gave its test rows.
    old = res.predictions.select("reading_id", "predicted_fault")
    new = again.predict(res.predictions.select(*[c for c in res.predictions.columns if c in readings.columns]))
    assert old.exceptAll(new.select("reading_id", "predicted_fault")).isEmpty()


def test_fit_transform_equals_fit_then_transform(readings):
    model, out = iforest.fit_transform(readings, trees=50, seed=7)
    again = iforest.fit(readings, trees=50, seed=7)
    assert again.offset == model.offset
    a = out.select("reading_id", "if_flag").orderBy("reading_id").toPandas()
    b = again.transform(readings).select("reading_id", "if_flag").orderBy("reading_id").toPandas()
    assert (a.if_flag.values == b.if_flag.values).all()


@pytest.mark.parametrize("name", ["rul_model_eval", "feature_importance", "model_comparison", "window_rul_eval", "dashboard_sections",
                                  "fault_model_eval", "fault_confusion", "fault_predictions", "fault_predictions_reloaded",
                                  "shap_long", "shap_importance", "shap_points", "shap_waterfall"])
def test_registered_queries_train_the_configured_models(spark, monkeypatch, name):
    """What the learners are asked for, without training them: the sizes of ``config``."""
    from assetpulse import config as C
    from assetpulse.ml import sequence_models as SM
    from assetpulse.plans import registry

    class Asked(Exception):
        pass

    def asked(**given):
        raise Asked(given.get("maxIter", given.get("numTrees")))

    flagged = FX.telemetry(spark, "/root/testdata/sf0.001").withColumn("if_flag", F.lit(0)).withColumn("if_score", F.lit(0.0))
    monkeypatch.setattr(iforest, "fit_transform", lambda df, **_: (None, df.withColumn("if_flag", F.lit(0)).withColumn("if_score", F.lit(0.0))))
    monkeypatch.setattr(registry, "model_input", lambda *_, **__: relabel(flagged))
    for place, learner in ((ML, "GBTRegressor"), (SM, "GBTRegressor"), (ML, "RandomForestClassifier")):
        monkeypatch.setattr(place, learner, asked)
    with pytest.raises(Asked) as got:
        registry.QUERIES[name](spark, "/root/testdata/sf0.001")
    boosted = name in ("rul_model_eval", "feature_importance", "model_comparison", "window_rul_eval", "dashboard_sections")
    assert got.value.args[0] == (C.RUL_GBT["iters"] if boosted else C.FAULT_RF["trees"])
