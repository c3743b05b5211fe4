"""Property tests: the Column rules against plain-Python statements of the
same rules on generated rows (missing values and exact thresholds included)."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from assetpulse import config as C
from assetpulse.functions import rules as R

EDGES = [0.45, 0.55, 0.70, 0.75, 15.0, 45.0, 55.0, 60.0, 120.0, 365.0]
num = st.one_of(st.none(), st.sampled_from(EDGES),
                st.floats(min_value=-50, max_value=600, allow_nan=False, allow_infinity=False))
row = st.tuples(num, num, num, num, num, num)


def py_level(p, rul, vib, temp, full):
    gt = lambda v, t: v is not None and v > t  # a missing value is no signal
    lt = lambda v, t: v is not None and v < t
    crit = gt(p, 0.75) or lt(rul, 15) or (full and (gt(vib, 0.70) or gt(temp, 55)))
    if crit:
        return "CRITICAL"
    warn = gt(p, 0.45) or lt(rul, 60) or (full and (gt(vib, 0.55) or gt(temp, 45)))
    return "WARNING" if warn else "HEALTHY"


def py_clip(v, lo, hi):
    return None if v is None else min(max(v, lo), hi)


def py_health(p, idx, anom, rul):
    if None in (p, idx, anom, rul):
        return None
    raw = (0.40 * (1 - p) + 0.25 * idx + 0.20 * (1 - anom) + 0.15 * py_clip(rul / 365, 0, 1)) * 100
    return py_clip(raw, 0, 100)


def py_score(p, rul, anom):
    urg = 1.0 if rul is None else max(0.0, min(1.0, 1 - rul / 365))  # NaN-skipping min/max
    if p is None or anom is None:
        return None
    return py_clip(0.40 * p * 100 + 0.30 * urg * 100 + 0.15 * anom * 100 + 0.15 * 0 * 100, 0, 100)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=1, max_size=40))
def test_rules_match_python(spark, rows):
    df = spark.createDataFrame(rows, "failure_prob double, rul_days double, vibration double, "
                                     "temperature double, health_index double, anomaly_score double")
    got = df.select(R.alert_level(df, C.BASIC_THRESHOLDS).alias("b"), R.alert_level(df, C.FULL_THRESHOLDS).alias("f"),
                    R.health_score(df).alias("h"), R.alert_score(df).alias("s"),
                    R.rul_band(df["rul_days"]).alias("band")).collect()
    for (p, rul, vib, temp, idx, anom), g in zip(rows, got):
        assert g.b == py_level(p, rul, vib, temp, False)
        assert g.f == py_level(p, rul, vib, temp, True)
        eh = py_health(p, idx, anom, rul)
        assert (g.h is None and eh is None) or math.isclose(g.h, eh, rel_tol=1e-12, abs_tol=1e-12)
        es = py_score(p, rul, anom)
        assert (g.s is None and es is None) or math.isclose(g.s, es, rel_tol=1e-12, abs_tol=1e-12)
        eb = "HEALTHY" if rul is None else next((n for lim, n in C.RUL_BANDS if rul < lim), "HEALTHY")
        assert g.band == eb
