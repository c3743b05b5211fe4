"""Order layer: row index, halo windows, splits, sequences, quantiles —
checked against brute force in pandas/numpy on small inputs, including a hot
key that holds most rows and buckets smaller than the data (halo crossing)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assetpulse.operators import order as O
from assetpulse.operators import stats as S


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 900
    asset = np.where(rng.random(n) < 0.6, "HOT", rng.choice(["A", "B", "C"], n))
    pdf = pd.DataFrame({"rid": np.arange(n), "t": rng.permutation(n).astype(np.int64),
                        "asset": asset, "v": rng.normal(size=n)})
    return pdf, spark.createDataFrame(pdf).repartition(5)


def test_row_index_matches_sort(skewed):
    pdf, df = skewed
    got = O.row_index(df, ["t", "rid"], num_partitions=6).select("rid", "row_idx").toPandas()
    exp = pdf.sort_values(["t", "rid"]).reset_index(drop=True)
    exp["row_idx"] = np.arange(len(exp))
    m = got.merge(exp[["rid", "row_idx"]], on="rid", suffixes=("", "_e"))
    assert len(m) == len(pdf) and (m.row_idx == m.row_idx_e).all()


@pytest.mark.parametrize("by", ["asset", None])
def test_halo_rolling_mean_equals_pandas(skewed, by):
    pdf, df = skewed
    got = O.rolling(df, "v", "roll", ["t", "rid"], by=by, w=30, bucket_rows=40).select("rid", "roll").toPandas()
    srt = pdf.sort_values(["t", "rid"])
    if by:
        srt["exp"] = srt.groupby(by)["v"].transform(lambda s: s.rolling(30, min_periods=1).mean())
    else:
        srt["exp"] = srt["v"].rolling(30, min_periods=1).mean()
    m = got.merge(srt[["rid", "exp"]], on="rid")
    assert len(m) == len(pdf)
    assert np.allclose(m["roll"], m["exp"], atol=1e-12)


def test_preceding_list_counts_and_content(skewed):
    pdf, df = skewed
    got = O.preceding_list(df, ["v"], "seq", ["t", "rid"], by="asset", n=30, bucket_rows=35).toPandas()
    sizes = pdf.groupby("asset").size()
    assert len(got) == int(sum(max(0, s - 30) for s in sizes))
    srt = pdf.sort_values(["t", "rid"])
    hot = srt[srt.asset == "HOT"].reset_index(drop=True)
    target = hot.iloc[45]
    seq = got[got.rid == target.rid].iloc[0]["seq"]
    assert [r["v"] for r in seq] == hot["v"].iloc[15:45].tolist()


def test_sequence_shape_like_reference(spark):
    # 100 rows x 5 features, window 30 -> 70 sequences of 30 x 5
    pdf = pd.DataFrame({"rid": range(100), "t": range(100), **{f"f{i}": np.arange(100.0) + i for i in range(5)}})
    df = spark.createDataFrame(pdf)
    got = O.preceding_list(df, [f"f{i}" for i in range(5)], "seq", ["t", "rid"], by=None, n=30).toPandas()
    assert len(got) == 70
    assert all(len(s) == 30 and len(s[0]) == 5 for s in got["seq"])


def test_time_split_counts(skewed):
    _, df = skewed
    out = O.time_split(df, ["t", "rid"], 0.2)
    assert out.where("is_test").count() == 900 - int(900 * 0.8)
    assert out.where("not is_test").agg(F.max("t")).first()[0] < out.where("is_test").agg(F.min("t")).first()[0]


def test_stratified_split_exact_share(skewed):
    pdf, df = skewed
    out = O.stratified_split(df, "asset", "rid", 0.2).toPandas()
    for a, g in out.groupby("asset"):
        assert g.is_test.sum() == int(np.floor(len(g) * 0.2 + 0.5))


def test_every_nth(skewed):
    _, df = skewed
    assert O.every_nth(df, ["t", "rid"], 3).count() == 300


@pytest.mark.parametrize("method", ["sort", "exact", "auto"])
def test_quantiles_equal_numpy_linear(skewed, method):
    pdf, df = skewed
    spec = {"v": [0.3, 0.6, 0.75, 0.8], "t": [0.5, 0.85]}
    row = S.quantiles(df, spec, method=method).first().asDict()
    for c, qs in spec.items():
        for q in qs:
            assert row[f"{c}_q{int(round(q * 1000)):03d}"] == pytest.approx(np.quantile(pdf[c], q), abs=1e-12)


def test_preceding_stats_equal_numpy(skewed):
    pdf, df = skewed
    got = O.preceding_stats(df, ["v"], ["t", "rid"], by="asset", n=30, bucket_rows=35).toPandas()
    srt = pdf.sort_values(["t", "rid"])
    hot = srt[srt.asset == "HOT"].reset_index(drop=True)
    win = hot["v"].iloc[10:40].to_numpy()
    row = got[got.rid == hot.rid.iloc[40]].iloc[0]
    i = np.arange(30)
    assert row.v_mean == pytest.approx(win.mean())
    assert row.v_sd == pytest.approx(win.std(ddof=1))
    assert row.v_min == win.min() and row.v_max == win.max() and row.v_last == win[-1]
    assert row.v_slope == pytest.approx(np.polyfit(i, win, 1)[0])
    assert len(got) == int(sum(max(0, s - 30) for s in pdf.groupby("asset").size()))


def test_time_split_approx_close_to_exact(telemetry):
    out = O.time_split_approx(telemetry, "event_time", 0.2)
    n = telemetry.count()
    share = out.where("is_test").count() / n
    assert abs(share - 0.2) < 0.01
    assert out.where("not is_test").agg(F.max("event_time")).first()[0] < \
        out.where("is_test").agg(F.min("event_time")).first()[0]


def test_halo_groups_are_bounded_under_skew(skewed):
    pdf, df = skewed  # one asset holds ~60 % of the rows
    w, bucket = 30, 64
    both = O._halo(df, ["t", "rid"], "asset", w, bucket)
    sizes = both.groupBy("_bucket", "asset").count().toPandas()
    assert sizes["count"].max() <= bucket + w - 1
    hot = int((pdf.asset == "HOT").sum())
    assert hot > bucket  # the hot asset really is split over several groups
    own = both.where("not _halo")
    assert own.count() == len(pdf) and own.select("rid").distinct().count() == len(pdf)


def test_quantiles_of_a_hot_value_with_nulls_and_nans(spark):
    rng = np.random.default_rng(3)
    v = np.where(rng.random(4000) < 0.9, 0.0, rng.normal(size=4000))
    rows = [(float(x), None if i % 7 == 0 else (float("nan") if i % 11 == 0 else float(x))) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "a double, b double").repartition(7)
    row = S.quantiles(df, {"a": [0.02, 0.5, 0.99], "b": [0.05, 0.97]}).first().asDict()
    b = np.array([x for _, x in rows if x is not None and x == x])
    for name, data, q in [("a_q020", v, 0.02), ("a_q500", v, 0.5), ("a_q990", v, 0.99), ("b_q050", b, 0.05), ("b_q970", b, 0.97)]:
        assert row[name] == pytest.approx(np.quantile(data, q), abs=1e-12)


def test_stratified_split_keeps_rows_without_class(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else f"c{i % 3}") for i in range(100)], "rid long, label string")
    out = O.stratified_split(df, "label", "rid", 0.2)
    assert out.count() == 100 and out.where("label is null and is_test").count() == 5


def test_slope_does_not_depend_on_the_position(spark):
    df = spark.createDataFrame([(i, float((i * 37) % 11)) for i in range(300)], "rid long, v double")
    got = {r.rid: r.v_slope for r in O.preceding_stats(df, ["v"], ["rid"], by=None, n=30, bucket_rows=40).collect()}
    for rid, slope in got.items():
        win = [(k * 37) % 11 for k in range(rid - 30, rid)]
        assert slope == pytest.approx(np.polyfit(np.arange(30), win, 1)[0], abs=1e-9)


@pytest.mark.parametrize("merged,accuracy", [(20_000, 2_000), (40, 2_000), (60, 50)])
def test_selection_equals_pandas(spark, monkeypatch, merged, accuracy):
    import numpy as np
    import pandas as pd
    from assetpulse.operators import selection as SEL
    monkeypatch.setattr(SEL, "MERGED", merged)
    monkeypatch.setattr(SEL, "ACCURACY", accuracy)
    rng = np.random.default_rng(3)
    n = 3000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "tied": rng.integers(0, 4, n).astype(float), "hot": np.where(rng.random(n) < 0.6, 7.0, rng.normal(size=n)),
                        "some": np.where(rng.random(n) < 0.9, np.nan, rng.normal(size=n)), "none": np.full(n, np.nan)})
    df = spark.createDataFrame(pdf).withColumn("some", F.when(~F.isnan("some"), F.col("some"))).repartition(5)
    qs = [0.0, 0.001, 0.25, 0.5, 0.92, 0.9999, 1.0]
    got, more = SEL.table_statistics(df, {c: qs for c in pdf}, {"top": F.max("a")})
    for c in pdf:
        for q in qs:
            want = pdf[c].dropna().quantile(q) if pdf[c].notna().any() else None
            assert got[c, q] == (None if want is None else pytest.approx(want, abs=1e-12)), (c, q)
    assert more == {"top": pdf["a"].max()}
    empty, _ = SEL.table_statistics(df.limit(0), {"a": [0.5]})
    assert empty == {("a", 0.5): None}
