"""What a step moves, stores or spreads, on rows of the tests' own: figures that grow with the table."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from assetpulse import session
from assetpulse.ml import iforest, models
from assetpulse.ml import sequence_models as SM
from assetpulse.operators import order as O
from assetpulse.operators import selection as SEL
from assetpulse.plans import registry as RG
from assetpulse.sources import fixtures as FX
from assetpulse.streaming import feed

SF = "/root/testdata/sf0.001"


def _readings(spark, n=240, assets=3):
    t = FX.telemetry(spark, SF).limit(n)
    return t.withColumn("asset_id", F.concat(F.lit("B"), (F.col("reading_id") % assets).cast("string"))).persist()


def test_flattened_windows_are_not_moved_for_the_split(spark, monkeypatch):
    """Only the readings are put in order: the flattened windows are neither sorted nor written."""
    moved, index = [], O.row_index

    def seen(df, *args, **kwargs):
        moved.append(set(df.columns))
        return index(df, *args, **kwargs)
    monkeypatch.setattr(O, "row_index", seen)
    SM.fit_window_fault(_readings(spark), n=4, hidden=3, iters=2)
    assert len(moved) == 1 and "raw" not in moved[0]


def test_window_split_is_the_sorted_split(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=rng.randrange(60)), f"a{i % 3}", float(i)) for i in range(200)]
    data = O.preceding_list(spark.createDataFrame(rows, "reading_id long, event_time timestamp_ntz, asset_id string, v double"),
                            ["v"], "seq", SM.TIME_ORDER, n=6, bucket_rows=20)
    assert data.count() == 200 - 3 * 6
    ids = lambda df: sorted(r[0] for r in df.where("is_test").select("reading_id").collect())
    assert ids(SM._time_cut(data, 0.2)) == ids(O.time_split(data, SM.TIME_ORDER, 0.2))


def test_brackets_are_narrowed_together(spark, monkeypatch):
    """Ten quantiles whose brackets do not fit one merge take a few passes, not two each."""
    monkeypatch.setattr(SEL, "MERGED", 60)
    values = np.random.default_rng(2).normal(size=(20_000, 2))
    df = spark.createDataFrame(pd.DataFrame(values, columns=["a", "b"])).persist()
    passes = []

    class Counted:
        def agg(self, *x):
            passes.append("agg")
            return df.agg(*x)

        def select(self, *x):
            passes.append("select")
            return df.select(*x)
    qs = [0.1, 0.3, 0.5, 0.7, 0.9]
    got = SEL.table_statistics(Counted(), {"a": qs, "b": qs})[0]
    for i, c in enumerate("ab"):
        for q in qs:
            assert got[c, q] == pytest.approx(np.quantile(values[:, i], q), abs=1e-12)
    assert len(passes) <= 6


def test_few_tasks_are_dealt_out_and_many_merged(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(session, "ROWS_PER_TASK", 1_000)
    one = spark.range(0, 9_000, 1, 1)
    dealt = session.even_tasks(one)
    sizes = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(sizes) == cores and max(sizes) < 2 * 9_000 / cores
    assert dealt.exceptAll(one).isEmpty() and dealt.count() == 9_000
    assert session.even_tasks(spark.range(0, 9_000, 1, 90)).rdd.getNumPartitions() == cores
    assert session.even_tasks(spark.range(0, 900, 1, 2)).rdd.getNumPartitions() == 2  # few rows stay as they are
    assert session.even_tasks(one.limit(0)).count() == 0


def test_scored_rows_are_dealt_over_the_cores(spark, monkeypatch):
    """Rows of one file split are scored by as many tasks as there are cores; no row is lost or doubled."""
    monkeypatch.setattr(session, "ROWS_PER_TASK", 50)
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 2_000, 1, 1).select(F.col("id").alias("reading_id"), *[
        (F.col("id") * k % 97).cast("double").alias(f) for k, f in ((7, "vibration"), (31, "temperature"))])
    rows = rows.withColumn("fault_code", F.when(F.col("vibration") > 40, "C1").otherwise("C3")).withColumn(
        "hmi_alert_code", F.lit("H1")).withColumn("event_time", F.timestamp_seconds("reading_id"))
    fault = models.fit_fault(rows, trees=3, depth=3)
    assert fault.predictions.rdd.getNumPartitions() >= cores
    out = models.predict_fault(fault, rows)
    assert out.rdd.getNumPartitions() >= cores
    assert sorted(r[0] for r in out.select("reading_id").collect()) == list(range(2_000))
    rul = models.fit_rul(rows.withColumn("rul_days", F.col("temperature")), iters=2)
    assert rul.predictions.rdd.getNumPartitions() >= min(cores, 2) and rul.predictions.count() == 2_000 - rul.n_train


def test_forest_walk_and_what_goes_through_python(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)).round(1)
    grown = [iforest._grow(x[rng.choice(300, 32)], rng, 5) for _ in range(7)]
    names = ["node", "feature", "threshold", "left", "right", "size", "depth"]
    nodes = pd.concat([pd.DataFrame(g, columns=names).assign(tree=t) for t, g in enumerate(grown)])

    def path(tree, row):
        node = tree[0]
        while node[1] >= 0:
            node = tree[node[3] if row[node[1]] < node[2] else node[4]]
        return node[6] + iforest.c_factor(node[5])
    want = np.array([sum(path(t, row) for t in grown) / len(grown) for row in x])
    assert iforest.ForestArrays.from_nodes(nodes).mean_path(x) == pytest.approx(want, abs=1e-12)
    stats = iforest.FE.ScalerStats("standard", ["a", "b", "c"], dict.fromkeys("abc", 0.0), dict.fromkeys("abc", 1.0))
    model = iforest.IsolationForestModel(["a", "b", "c"], stats, nodes, 32, 0.0, 0.08)
    out = model.raw_scores(spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(other="kept")))
    assert out.columns == ["a", "b", "c", "other", "if_raw"] and {r.other for r in out.collect()} == {"kept"}
    assert "MapInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_lists_merge_arrivals_without_a_call_for_each_asset(spark):
    """Two triggers with a redelivered reading equal the newest of all rows; untouched assets are not emitted."""
    start, rng = 1_700_000_000_000_000, random.Random(6)
    rows = [(f"a{i % 3}", i, start + rng.randrange(10_000), float(i), 1.0, rng.choice(["HEALTHY", "WARNING"]), "C1", 0.5, "x") for i in range(400)]
    kind = "asset_id string, reading_id long, t_us long, vibration double, temperature double, alert_level string, fault_code string, failure_prob double, maintenance_action string"
    none = spark.createDataFrame([], feed.OUT_SCHEMA)
    first = feed.merge_lists(none, spark.createDataFrame(rows[:250], kind)).persist()
    again = [r for r in first.where("asset_id = 'a0' and kind = 'reading' and rank = 1").collect()][0]
    later = [r for r in rows[250:] if r[0] != "a2"] + [("a0", again.reading_id, again.t_us, -1.0, 1.0, "HEALTHY", "C1", 0.5, "x")]
    out = feed.merge_lists(first, spark.createDataFrame(later, kind))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Pandas" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert {r.asset_id for r in got} == {"a0", "a1"}
    for a in ("a0", "a1"):
        mine = sorted((r for r in rows if r[0] == a), key=lambda r: (-r[2], -r[1]))
        for what, want in (("reading", mine[:feed.LAST_READINGS]), ("alert", [r for r in mine if r[5] == "WARNING"][:feed.LAST_ALERTS])):
            kept = sorted((r for r in got if (r.asset_id, r.kind) == (a, what)), key=lambda r: r["rank"])
            assert [r.reading_id for r in kept] == [r[1] for r in want] and [r["rank"] for r in kept] == list(range(1, len(want) + 1))
            if what == "reading":
                assert [r.vibration for r in kept] == [r[3] for r in want]


def test_learners_train_on_rows_dealt_over_the_cores(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 500)
    seen = []

    class Learner:
        def fit(self, data):
            seen.append([len(p) for p in data.rdd.glom().collect()])
            return VectorAssembler(inputCols=["y"], outputCol="made")
    rows = spark.range(0, 4_000, 1, 1).select(F.col("id").cast("double").alias("v"), F.lit(1.0).alias("y"))
    models.fit_cached([VectorAssembler(inputCols=["v"], outputCol="features")], Learner(), rows, "y")
    sizes, = seen
    assert sum(sizes) == 4_000 and len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2 * 4_000 / len(sizes)


def test_model_input_is_scored_and_relabelled_once(spark):
    """Later passes scan stored columns: the forest, the site join and the label join are not run again for each."""
    plan = RG.model_input(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Join" not in plan and "InMemoryTableScan" not in plan and "Python" not in plan


def test_forest_fit_reads_its_table_once_dealt_over_the_cores(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    seen, fit = [], iforest.fit

    def watched(df, **kwargs):
        seen.append((df.storageLevel.useMemory, df.rdd.getNumPartitions()))
        return fit(df, **kwargs)
    monkeypatch.setattr(iforest, "fit", watched)
    rows = _readings(spark).coalesce(1)
    out = iforest.fit_transform(rows, trees=3)[1]
    assert seen[0][0] and seen[0][1] > 1 and out.count() == rows.count()


def test_triggers_read_only_what_arrived_and_folds_wait_for_rows(spark, monkeypatch):
    """A trigger's folder holds its own rows; with many assets, listed rows are not written again at every trigger."""
    rows = _readings(spark, 240, 40).withColumn("reading_id", F.monotonically_increasing_id())
    folds, compact = [], feed.compact
    monkeypatch.setattr(feed, "compact", lambda spark, sink, i: (folds.append(i), compact(spark, sink, i)))
    ws = feed.workspace(spark, "test-own")
    feed.write_feed_files(rows, f"{ws}/source", 12)
    feed.run_state_feed(feed.read_feed(spark, f"{ws}/source", rows.schema, 1), f"{ws}/state", f"{ws}/chk", compact_every=1)
    # Nothing falls out of a list, so a trigger that emitted its assets' lists would repeat what was listed before.
    lists = feed.current_lists(spark, f"{ws}/state")
    assert lists.where("kind = 'reading'").count() == 240
    last = feed._written(spark, f"{ws}/state", "batch")[-1]
    own = spark.read.schema(feed.OUT_SCHEMA).parquet(f"{ws}/state/batch={last:08d}").where("kind = 'reading'").count()
    assert own < 60 and last == 11
    assert folds[0] == 0 and len(folds) < 12  # a fold waits for a quarter of the snapshot's rows
