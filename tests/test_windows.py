"""Windowed models: prediction behind carried readings, in one batch or several."""

import random
import uuid

from pyspark.sql import functions as F

from assetpulse.ml import sequence_models as SM
from assetpulse.operators import order as O
from assetpulse.session import ensure_checkpoint_dir
from assetpulse.sources import fixtures as FX

SF = "/root/testdata/sf0.001"
N = 5


def test_last_n_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.7 else f"a{rng.randrange(4)}", rng.randrange(50)) for i in range(500)] + [(900, "one", 3)]
    got = O.last_n(spark.createDataFrame(rows, "rid long, asset string, t long"), "asset", ["t", "rid"], 7, salts=4).collect()
    want = []
    for a in {r[1] for r in rows}:
        want += sorted((r for r in rows if r[1] == a), key=lambda r: (r[2], r[0]))[-7:]
    assert sorted(map(tuple, got)) == sorted(want)


def _batches(spark):
    t = FX.telemetry(spark, SF).withColumn("asset_id", F.concat(F.lit("B"), (F.col("reading_id") % 4).cast("string"))).persist()
    cuts = t.approxQuantile("reading_id", [0.5, 0.75], 0.0)
    order = t.withColumn("event_time", F.to_timestamp(F.from_unixtime(F.col("reading_id") * 60)))
    return order.where(F.col("reading_id") <= cuts[0]), order.where((F.col("reading_id") > cuts[0]) & (F.col("reading_id") <= cuts[1])), order.where(
        F.col("reading_id") > cuts[1])


def _check(spark, model, first, second, third):
    later = second.unionByName(third)
    once = model.predict(later)
    columns = once.columns
    twice = model.predict(second).unionByName(model.advance(second).predict(third))
    assert once.count() == later.count()  # every asset has N carried readings
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/test-window-{uuid.uuid4().hex[:8]}"
    model.save(path)
    again = SM.WindowModel.load(spark, path)
    assert again.predict(later).select(*columns).exceptAll(once).isEmpty()
    assert model.predict(second.limit(0)).count() == 0
    fresh = SM.replace(model, store=model.store.limit(0))
    assert fresh.predict(first).count() == first.count() - N * first.select("asset_id").distinct().count()


def test_window_rul_predicts_in_batches(spark):
    first, second, third = _batches(spark)
    model, _, _, _ = SM.fit_window_rul(first, n=N, iters=3)
    _check(spark, model, first, second, third)
    assert model.predict(second).columns[-2:] == ["rul_pred", "rul_pred_band"]


def test_window_fault_predicts_with_confidence(spark):
    first, second, third = _batches(spark)
    model, _, _, _ = SM.fit_window_fault(first, n=N, hidden=6, iters=5)
    _check(spark, model, first, second, third)
    seen = model.predict(second).agg(F.min("confidence"), F.max("confidence")).first()
    assert 0 < seen[0] <= seen[1] <= 1
    assert {r[0] for r in model.predict(second).select("predicted_fault").distinct().collect()} <= set(model.labels)
