"""Scalar rules as native Column expressions (no Python per row).

Every function returns a ``Column``; nothing here triggers a job, so the
expressions stay inside whole-stage codegen wherever they are used.
Null handling follows the reading semantics: a comparison with a missing
value is false, arithmetic with a missing value stays missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def col_or(df: DataFrame, name: str, default) -> Column:
    """The column if the table has it, else a literal default (absent inputs only)."""
    return F.col(name) if name in df.columns else F.lit(default)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; a null stays null (unlike least/greatest, which skip nulls)."""
    return F.when(x < F.lit(lo), F.lit(lo)).when(x > F.lit(hi), F.lit(hi)).otherwise(x)


def magnitude(x: Column, y: Column, z: Column) -> Column:
    """Euclidean norm of an acceleration sample."""
    return F.sqrt(x * x + y * y + z * z)


def zscore(v: Column, mean: Column, sd: Column) -> Column:
    """F2: (v - mean) / sd, 0.0 when the deviation is not positive."""
    return F.when(sd > 0, (v - mean) / sd).otherwise(F.lit(0.0))


def z_flag(z: Column, limit: float = C.Z_LIMIT) -> Column:
    """|z| above the limit -> 1 else 0."""
    return F.when(F.abs(z) > F.lit(limit), 1).otherwise(0).cast("int")


def rul_norm(rul: Column, horizon: float = C.RUL_HORIZON_DAYS) -> Column:
    """RUL as a share of the horizon, clipped to [0, 1]."""
    return clip(rul / F.lit(horizon), 0.0, 1.0)


def health_score(df: DataFrame, weights: dict = C.HEALTH_WEIGHTS,
                 defaults: dict = C.HEALTH_DEFAULTS) -> Column:
    """weighted health 0..100 (higher is healthier)."""
    p = col_or(df, "failure_prob", defaults["failure_prob"])
    idx = col_or(df, "health_index", defaults["health_index"])
    anom = col_or(df, "anomaly_score", defaults["anomaly_score"])
    rul = col_or(df, "rul_days", defaults["rul_days"])
    raw = (F.lit(weights["failure_prob"]) * (F.lit(1.0) - p)
           + F.lit(weights["health_index"]) * idx
           + F.lit(weights["anomaly_score"]) * (F.lit(1.0) - anom)
           + F.lit(weights["rul"]) * rul_norm(rul)) * F.lit(100.0)
    return clip(raw, 0.0, 100.0)


def _level_expr(signals: list[tuple[Column, str, float]]) -> Column:
    cond = None
    for c, op, thr in signals:
        term = c > F.lit(thr) if op == ">" else c < F.lit(thr)
        cond = term if cond is None else (cond | term)
    return cond


def alert_level(df: DataFrame, thresholds: dict = C.BASIC_THRESHOLDS,
                defaults: dict = C.ALERT_LEVEL_DEFAULTS) -> Column:
    """CRITICAL / WARNING / HEALTHY from the signals named in ``thresholds``.

    Each level lists any of ``failure_prob`` (>), ``rul`` (<), ``vibration`` (>)
    and ``temp`` (>); all comparisons are strict. The basic rule uses the first
    two, the full rule all four.
    """
    sources = {
        "failure_prob": (col_or(df, "failure_prob", defaults["failure_prob"]), ">"),
        "rul": (col_or(df, "rul_days", defaults["rul_days"]), "<"),
        "vibration": (col_or(df, "vibration", defaults["vibration"]), ">"),
        "temp": (col_or(df, "temperature", defaults["temperature"]), ">"),
    }
    out = None
    for level in ("CRITICAL", "WARNING"):
        sig = [(sources[k][0], sources[k][1], v) for k, v in thresholds[level].items()]
        cond = _level_expr(sig)
        out = F.when(cond, F.lit(level)) if out is None else out.when(cond, F.lit(level))
    return out.otherwise(F.lit("HEALTHY"))


def rul_band(days: Column, bands=C.RUL_BANDS) -> Column:
    """F8: RUL days -> CRITICAL / WARNING / MONITOR / HEALTHY."""
    out = None
    for limit, name in bands:
        cond = days < F.lit(limit)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("HEALTHY"))


def health_band(score: Column, bands=C.HEALTH_BANDS) -> Column:
    """health score -> good / fair / poor."""
    out = None
    for limit, name in bands:
        cond = score >= F.lit(limit)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("poor"))


def rul_display_band(days: Column, bands=C.RUL_DISPLAY_BANDS) -> Column:
    """mean RUL -> poor / fair / good."""
    out = None
    for limit, name in bands:
        cond = days < F.lit(limit)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit("good"))


def alert_score(df: DataFrame, weights: dict = C.ALERT_SCORE_WEIGHTS,
                defaults: dict = C.ALERT_SCORE_DEFAULTS,
                horizon: float = C.RUL_HORIZON_DAYS) -> Column:
    """urgency 0..100 (higher is more urgent).

    The RUL urgency uses null-skipping ``least``/``greatest``: a missing RUL
    value counts as full urgency, as a max(0, min(1, NaN)) does in Python.
    """
    p = col_or(df, "failure_prob", defaults["failure_prob"])
    rul = col_or(df, "rul_days", defaults["rul_days"])
    anom = col_or(df, "anomaly_score", defaults["anomaly_score"])
    flag = col_or(df, "if_flag", defaults["if_flag"])
    urgency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(1.0) - rul / F.lit(horizon)))
    raw = (F.lit(weights["failure_prob"]) * p * F.lit(100.0)
           + F.lit(weights["rul"]) * urgency * F.lit(100.0)
           + F.lit(weights["anomaly_score"]) * anom * F.lit(100.0)
           + F.lit(weights["if_flag"]) * flag * F.lit(100.0))
    return clip(raw, 0.0, 100.0)


def minmax_norm(v: Column, lo: Column, hi: Column) -> Column:
    """(v - min) / (max - min); 0.0 for a constant column."""
    rng = hi - lo
    return F.when(rng > 0, (v - lo) / rng).otherwise(F.lit(0.0))


def fault_cascade(q: dict, rules=C.FAULT_CASCADE, default: str = C.DEFAULT_FAULT) -> Column:
    """first matching rule in priority order, else the default code.

    ``q`` maps (column, quantile) -> Column holding that table quantile (from a
    broadcast one-row statistics table).
    """
    out = None
    for code, clauses in rules:
        cond = None
        for colname, op, qq in clauses:
            thr = q[(colname, qq)]
            term = F.col(colname) > thr if op == ">" else F.col(colname) < thr
            cond = term if cond is None else (cond & term)
        out = F.when(cond, F.lit(code)) if out is None else out.when(cond, F.lit(code))
    return out.otherwise(F.lit(default))


def gaussian_noise(row_id: Column, seed: int, sd: float) -> Column:
    """Deterministic N(0, sd) per row id: Box-Muller over two hashed uniforms.

    Reproducible across runs, partitionings and executor retries (it depends
    on the row id only), unlike a stateful random generator.
    """
    if sd == 0:
        return F.lit(0.0)
    mask = F.lit((1 << 52) - 1)
    u1 = ((F.xxhash64(row_id, F.lit(seed)).bitwiseAND(mask)).cast("double") + F.lit(1.0)) / F.lit(float(1 << 52) + 1.0)
    u2 = (F.xxhash64(row_id, F.lit(seed + 7919)).bitwiseAND(mask)).cast("double") / F.lit(float(1 << 52))
    return F.lit(sd) * F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(6.283185307179586) * u2)


def recompute_rul(p_n: Column, vib_n: Column, age_n: Column, noise: Column,
                  cfg: dict = C.RUL_RECOMPUTE) -> Column:
    """RUL from normalised probability, vibration and age, plus noise."""
    proxy = (F.lit(cfg["w_prob"]) * (F.lit(1.0) - p_n)
             + F.lit(cfg["w_vib"]) * (F.lit(1.0) - vib_n)
             + F.lit(cfg["w_age"]) * (F.lit(1.0) - age_n))
    return F.round(clip(proxy * F.lit(cfg["scale"]) + noise, cfg["lo"], cfg["hi"]), cfg["digits"])


def blend_probability(severity: Column, p: Column, noise: Column, cfg: dict = C.PROB_BLEND) -> Column:
    """0.6 * severity + 0.4 * original probability + noise, clipped, rounded."""
    raw = F.lit(cfg["w_severity"]) * severity + F.lit(cfg["w_prob"]) * p + noise
    return F.round(clip(raw, 0.0, 1.0), cfg["digits"])


def fault_text(code: Column, description: Column, action: Column) -> Column:
    """'description — action', or 'Unknown fault type: <code>' for a miss."""
    return F.when(description.isNull(), F.concat(F.lit(C.UNKNOWN_FAULT_TEXT_PREFIX), code)).otherwise(
        F.concat(description, F.lit(C.FAULT_TEXT_SEPARATOR), action))


def format_time(ts: Column) -> Column:
    """F16: 'yyyy-MM-dd HH:mm:ss'."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def clock_hhmm(ts: Column) -> Column:
    """F16: HH:MM part of the formatted time."""
    return F.substring(format_time(ts), 12, 5)
