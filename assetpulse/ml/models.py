"""MLlib models: boosted-tree RUL regression (M7/M8), random-forest fault
classifier (M9/M10), feature importance (M13), persistence (K3).

Training data splits are computed by Spark (time split W4, stratified split
W5), scalers are fitted on the training rows only inside the ``Pipeline``,
and every metric is an aggregate over the scored test rows (A12-A15).
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import MinMaxScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from .. import schema as SC
from ..operators import lookups as L
from ..operators import metrics as M
from ..operators import order as O
from ..functions import rules as R
from ..session import even_tasks, materialise
from . import features as FE
from . import forest

TIME_ORDER = ["event_time", "reading_id"]


@dataclass
class RulResult:
    model: PipelineModel
    features: list[str]
    metrics: DataFrame          # one row: mae, rmse, r2
    predictions: DataFrame      # test rows with rul_pred
    train_time_s: float
    n_train: int = 0


@dataclass
class FaultResult:
    model: PipelineModel
    features: list[str]
    labels: list[str]           # code -> fault label (alphabetical)
    predictions: DataFrame      # test rows with predicted label
    train_time_s: float
    hmi_labels: list[str] = field(default_factory=list)  # code -> HMI alert code (alphabetical)


@dataclass
class FaultModel:
    """All that scoring raw readings needs: pipeline, trained feature order, both label lists."""

    model: PipelineModel
    features: list[str]
    labels: list[str]
    hmi_labels: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        """M10 on raw readings: HMI code encoded in the training order, absent features and nulls 0.0.

        Returns the columns of ``df`` with the predicted label, confidence and text;
        the features as the model saw them stay inside. No rows give no rows.
        """
        enc = "hmi_alert_code_enc"
        src = df.withColumn("_raw", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
        if "hmi_alert_code" in df.columns:
            src = src.withColumn(enc, FE.encode_label(F.col("hmi_alert_code"), self.hmi_labels))
        out = label_predictions(self.model, FE.fill_features(src, self.features, ["_raw"]), self.labels)
        made = ["pred_code", "predicted_fault", "confidence", "fault_text"]
        return out.select(*[F.col(f"_raw.`{c}`") for c in df.columns if c not in made], *made)


def fit_cached(prepare: list, learner, train: DataFrame, *cols: str) -> PipelineModel:
    """The fitted stages and the learner; its ``features`` and ``cols`` are assembled once and kept while it trains.

    Learners run hundreds of passes over the kept rows, so these are dealt over the cores first.
    """
    ready = Pipeline(stages=prepare).fit(train)
    data = ready.transform(even_tasks(train)).select("features", *cols).persist()
    try:
        return PipelineModel([*ready.stages, learner.fit(data)])
    finally:
        data.unpersist()


def fit_forest(prepare: list, learner: RandomForestClassifier, train: DataFrame) -> PipelineModel:
    """The fitted stages and the learner's forest, grown tree by tree on their binned ``features`` (``ml.forest``)."""
    ready = Pipeline(stages=prepare).fit(train)
    data = ready.transform(train).select("features", learner.getLabelCol(), learner.getWeightCol())
    return PipelineModel([*ready.stages, forest.fit(learner, data)])


def fit_rul(df: DataFrame, features: list[str] | None = None, iters: int = C.RUL_GBT["iters"],
            step: float = C.RUL_GBT["step"], depth: int = C.RUL_GBT["depth"], test: float = C.RUL_GBT["test"],
            seed: int = C.RUL_GBT["seed"], target: str = SC.RUL_TARGET, max_bins: int = 128) -> RulResult:
    """M7: time split (no shuffle), min-max scale on train, boosted trees."""
    feats = FE.select_features(df, features or SC.RUL_FEATURES)
    split, n_train = O.time_cut(df, TIME_ORDER, test)
    train = split.where(~F.col("is_test"))
    test_rows = split.where(F.col("is_test"))
    prepare = [VectorAssembler(inputCols=feats, outputCol="raw_features", handleInvalid="keep"),
               MinMaxScaler(inputCol="raw_features", outputCol="features")]
    learner = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="rul_pred", maxIter=iters,
                           stepSize=step, maxDepth=depth, seed=seed, maxBins=max_bins, maxMemoryInMB=64)
    t0 = time.perf_counter()
    model = fit_cached(prepare, learner, train, target)
    secs = time.perf_counter() - t0
    # The last rows in time may all lie in one file split; each is walked through every tree.
    pred = model.transform(even_tasks(test_rows)).drop("raw_features", "features").persist()
    return RulResult(model, feats, M.regression_metrics(pred, target, "rul_pred"), pred, secs, n_train)


def predict_rul(model: PipelineModel, df: DataFrame) -> DataFrame:
    """M8: score rows; adds ``rul_pred`` and its band (F8)."""
    out = model.transform(df).drop("raw_features", "features")
    return out.withColumn("rul_pred_band", R.rul_band(F.col("rul_pred")))


def fit_fault(df: DataFrame, features: list[str] | None = None, trees: int = C.FAULT_RF["trees"],
              depth: int = C.FAULT_RF["depth"], test: float = C.FAULT_RF["test"],
              seed: int = C.FAULT_RF["seed"], label_col: str = "fault_code") -> FaultResult:
    """M9: label codes (M1), stratified split (W5), balanced weights (J6),
    standard scaling fitted on train, random forest."""
    enc, models = FE.label_encode(df, [label_col, "hmi_alert_code"])
    labels = list(models[label_col].labels)
    feats = FE.select_features(enc, features or SC.FAULT_FEATURES)
    # Written once: the key hashes of the split and the label codes are dear to make again for every pass.
    split = materialise(O.stratified_cut(enc, label_col, "reading_id", test), "fault-split")
    train = L.class_weights(split.where(~F.col("is_test")), label_col, "weight")
    test_rows = split.where(F.col("is_test"))
    target = f"{label_col}_enc"
    prepare = [VectorAssembler(inputCols=feats, outputCol="raw_features", handleInvalid="keep"),
               StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True)]
    learner = RandomForestClassifier(featuresCol="features", labelCol=target, weightCol="weight", numTrees=trees,
                                     maxDepth=depth, seed=seed, predictionCol="pred_code",
                                     probabilityCol="probability", rawPredictionCol="raw_prediction")
    t0 = time.perf_counter()
    model = fit_forest(prepare, learner, train.withColumn(target, F.col(target).cast("double")))
    secs = time.perf_counter() - t0
    # Several metrics read the scored test rows: keep them once (recomputable
    # from lineage on executor loss; the split depends on the rows alone).
    pred = label_predictions(model, test_rows, labels).persist()
    return FaultResult(model, feats, labels, pred, secs, list(models["hmi_alert_code"].labels))


def label_predictions(model: PipelineModel, df: DataFrame, labels: list[str]) -> DataFrame:
    """Predicted label (M2), confidence = max class probability, text.

    Every tree is walked for every row, so rows of a small file are dealt over the cores first.
    """
    out = forest.score(model.stages[-1], PipelineModel(model.stages[:-1]).transform(even_tasks(df)))
    out = (out.withColumn("predicted_fault", FE.decode_label(F.col("pred_code"), labels))
              .withColumn("confidence", F.array_max(vector_to_array(F.col("probability")))))
    cat = L.fault_catalog(df.sparkSession).select(
        F.col("fault_code").alias("_code"), F.col("fault_description").alias("_d"),
        F.col("recommended_action").alias("_a"))
    out = out.join(F.broadcast(cat), F.col("predicted_fault") == F.col("_code"), "left")
    return (out.withColumn("fault_text", R.fault_text(F.col("predicted_fault"), F.col("_d"), F.col("_a")))
               .drop("_code", "_d", "_a", "raw_features", "features"))


def predict_fault(fitted: FaultResult | FaultModel, df: DataFrame) -> DataFrame:
    """M10 on raw readings."""
    return FaultModel(fitted.model, fitted.features, fitted.labels, fitted.hmi_labels).predict(df)


def fault_metrics(pred: DataFrame, label_col: str = "fault_code"):
    """A13-A15 on real labels (not positions)."""
    return (M.accuracy(pred, label_col, "predicted_fault"),
            M.class_report(pred, label_col, "predicted_fault"),
            M.confusion(pred, label_col, "predicted_fault"))


def feature_importance(spark: SparkSession, model: PipelineModel, names: list[str], digits: int = 4) -> DataFrame:
    """Impurity importance per feature, descending (a table of #features rows)."""
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = [(n, float(round(v, digits))) for n, v in zip(names, imp)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.col("importance").desc(), F.col("feature"))


def save_model(model: PipelineModel, path: str) -> None:
    """K3: MLlib persistence (metadata + Parquet model data)."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_fault(spark: SparkSession, fitted: FaultResult | FaultModel, path: str) -> None:
    """K3: the pipeline, and beside it one row with the feature order and both label lists."""
    save_model(fitted.model, f"{path}/pipeline")
    row = {"features": fitted.features, "labels": fitted.labels, "hmi_labels": fitted.hmi_labels}
    spark.createDataFrame([(json.dumps(row),)], "bundle string").coalesce(1).write.mode("overwrite").text(f"{path}/bundle")


def load_fault(spark: SparkSession, path: str) -> FaultModel:
    return FaultModel(load_model(f"{path}/pipeline"), **json.loads(spark.read.text(f"{path}/bundle").first()[0]))
