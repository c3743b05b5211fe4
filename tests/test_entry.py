"""Driver contract and a fast oracle pass at sf0.001 (the driver runs sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E

FAST_KEYS = ["alert_log", "health_score", "block_summary", "location_summary", "alerts_top50",
             "vibration_features", "rolling_mean_30", "sequences_30", "time_split", "stratified_split",
             "relabel", "label_encode", "classification_report", "sensor_quantiles"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "alert_score" in df.columns


def test_every_oracle_key_is_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


@pytest.mark.parametrize("key", FAST_KEYS)
def test_matches_duckdb_small(spark, key):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ["events", "nation", "region"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    s = E.queries()[key](spark, sf).toPandas()
    d = con.execute(E.oracle_sql()[key]).df()
    assert sorted(s.columns) == sorted(d.columns)
    cols = sorted(s.columns)
    rs = sorted(tuple(str(_norm(x)) for x in r) for r in s[cols].astype(object).itertuples(index=False))
    rd = sorted(tuple(str(_norm(x)) for x in r) for r in d[cols].astype(object).itertuples(index=False))
    assert rs == rd
