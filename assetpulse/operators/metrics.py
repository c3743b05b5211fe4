"""Model metrics as aggregates.

Each metric is one or two aggregates over (label, prediction) columns; the
only tables that grow are per class (bounded by the class count).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def anomaly_eval(df: DataFrame, flag_col: str = "if_flag", prob_col: str = "failure_prob",
                 prob_limit: float = 0.5) -> DataFrame:
    """Flagged count, rate, and share of flagged rows with prob > limit."""
    flagged = F.col(flag_col) == 1
    n_flag = F.sum(F.when(flagged, 1).otherwise(0))
    both = F.sum(F.when(flagged & (F.col(prob_col) > prob_limit), 1).otherwise(0))
    n = F.count(F.lit(1))
    return df.agg(n_flag.cast("long").alias("n_anomalies"),
                  F.when(n > 0, n_flag / n).otherwise(F.lit(0.0)).alias("anomaly_rate"),
                  F.when(n_flag > 0, both / n_flag).otherwise(F.lit(0.0)).alias("precision_vs_high_prob"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    """MAE, RMSE, R² in one pass; the total sum of squares is n times the
    population variance (merged by deviations, so numerically stable)."""
    err = F.col(p) - F.col(y)
    agg = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(err)).alias("sae"),
        F.sum(err * err).alias("sse"),
        (F.count(y) * F.var_pop(y)).alias("sst"))
    sst = F.col("sst")
    return agg.select((F.col("sae") / F.col("n")).alias("mae"),
                      F.sqrt(F.col("sse") / F.col("n")).alias("rmse"),
                      F.when(sst > 0, F.lit(1.0) - F.col("sse") / sst).otherwise(F.lit(0.0)).alias("r2"))


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Long-form confusion matrix, dense over the union of labels."""
    counts = df.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("l")).distinct()
    # Every (actual, predicted) label pair: built from the label set (bounded
    # by the class count) by exploding it twice, not from the rows.
    arr = labels.agg(F.collect_list("l").alias("ls"))
    grid = (arr.select(F.explode("ls").alias("actual"), "ls")
            .select("actual", F.explode("ls").alias("predicted")))
    return (grid.join(counts, ["actual", "predicted"], "left")
            .select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def class_report(df: DataFrame, y: str, p: str) -> DataFrame:
    """Per class precision / recall / f1 / support, plus macro and
    weighted averages (zero division -> 0). One scan of the predictions; the
    averages work on the per-class table (one row per class)."""
    # One pass: each row counts once for its actual label (support, hit) and
    # once for its predicted label; one groupBy gives all per-class counts.
    hit = (F.col(y) == F.col(p)).cast("long")
    roles = F.explode(F.array(
        F.struct(F.col(y).alias("label"), F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("q"),
                 hit.alias("h")),
        F.struct(F.col(p).alias("label"), F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("q"),
                 F.lit(0).cast("long").alias("h"))))
    per = (df.select(roles.alias("r")).select("r.*").where(F.col("label").isNotNull())
           .groupBy("label").agg(F.sum("h").alias("tp"), F.sum("a").alias("support"), F.sum("q").alias("npred")))
    prec = F.when(F.col("npred") > 0, F.col("tp") / F.col("npred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    per = per.select("label", prec.alias("precision"), rec.alias("recall"), "support")
    f1 = F.when((F.col("precision") + F.col("recall")) > 0,
                F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))) \
        .otherwise(F.lit(0.0))
    per = per.withColumn("f1", f1).select("label", "precision", "recall", "f1", F.col("support").cast("long"))
    tot = F.sum("support")
    macro = per.agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.cast("long").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("label"),
                       (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"),
                       tot.cast("long").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    """Share of rows where prediction equals label."""
    return df.agg(F.avg(F.when(F.col(y) == F.col(p), 1.0).otherwise(0.0)).alias("accuracy"))


def comparison(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """One row per model (task, metric, value, r2, rmse, train time, epochs);
    absent fields are null. ``rows`` are the few metric dicts of the trained models."""
    schema = ("model string, task string, metric string, value double, r2 double, rmse double, "
              "train_time_s double, epochs int")
    norm = [(r.get("model"), r.get("task"), r.get("metric"), _f(r.get("value")), _f(r.get("r2")),
             _f(r.get("rmse")), _f(r.get("train_time_s")),
             None if r.get("epochs") is None else int(r["epochs"])) for r in rows]
    return spark.createDataFrame(norm, schema)


def _f(v):
    return None if v is None else float(v)
