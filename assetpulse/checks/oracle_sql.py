"""Independent DuckDB SQL for each registered query (the correctness oracle).

Written by hand as plain SQL over the driver's tables; it shares no code with
the Spark side. Every query body reads the ``telemetry`` / ``vibration``
common table expressions defined here.
"""

from __future__ import annotations

def linear_quantiles(source: str, col: str, qs: dict[str, float]) -> str:
    """Quantiles by definition (pandas/numpy 'linear'): rank the non-null
    values, take the order statistics at floor/ceil of (n - 1) * q and
    interpolate lo + (hi - lo) * frac in double arithmetic."""
    parts = []
    for alias, q in qs.items():
        pos = f"((n - 1) * {q!r}e0)"
        frac = f"((max(n) - 1) * {q!r}e0 - floor((max(n) - 1) * {q!r}e0))"
        lo = f"max(CASE WHEN rk = CAST(floor({pos}) AS BIGINT) THEN v END)"
        hi = f"max(CASE WHEN rk = CAST(ceil({pos}) AS BIGINT) THEN v END)"
        parts.append(f"{lo} + ({hi} - {lo}) * {frac} AS {alias}")
    return (f"(SELECT {', '.join(parts)} FROM (SELECT {col} AS v, row_number() OVER (ORDER BY {col}) - 1 AS rk, "
            f"count(*) OVER () AS n FROM {source} WHERE {col} IS NOT NULL AND NOT isnan({col})) z)")


CASCADE_Q = " CROSS JOIN ".join([
    linear_quantiles("tel0", "vibration", {"v75": 0.75, "v60": 0.60}) + " qv",
    linear_quantiles("tel0", "resistance", {"r80": 0.80, "r60": 0.60, "r30": 0.30}) + " qr",
    linear_quantiles("tel0", "temperature", {"t80": 0.80}) + " qt",
    linear_quantiles("tel0", "cpu_load", {"c85": 0.85, "c70": 0.70}) + " qc",
    linear_quantiles("tel0", "humidity", {"h75": 0.75}) + " qh",
    linear_quantiles("tel0", "age_days", {"a75": 0.75}) + " qa",
])
EDGE_Q = linear_quantiles("telemetry", "anomaly_score", {"aq": 0.92})


# Readings derived from events + nation (same definitions as the Spark source).
TELEMETRY_CTES = """
ev_base AS (
  SELECT e.event_id, e.ts, e.user_id, e.value,
         CAST(substring(e.props, 7, length(e.props) - 7) AS INT) AS k,
         CAST((e.event_id * 7919 + 13) % 1009 AS DOUBLE) / 1009 AS u1,
         CAST((e.event_id * 6271 + 29) % 1013 AS DOUBLE) / 1013 AS u2,
         CAST((e.event_id * 4801 + 47) % 1019 AS DOUBLE) / 1019 AS u3,
         CAST((e.event_id * 3571 + 71) % 1021 AS DOUBLE) / 1021 AS u4
  FROM events e
),
tel0 AS (
  SELECT b.event_id AS reading_id, b.ts AS event_time,
         concat('B', CAST(b.user_id AS VARCHAR)) AS asset_id, n.n_name AS site_id,
         CASE WHEN b.k < 50 THEN 'FREE' ELSE 'OCCUPIED' END AS occupancy_state,
         concat('H', CAST(b.k % 5 AS VARCHAR)) AS hmi_alert_code,
         b.value / 200 AS vibration,
         5 + CAST(b.k AS DOUBLE) * 0.42e0 + b.value * 0.04e0 AS temperature,
         30 + 70 * b.u1 AS humidity,
         5 * b.u2 AS resistance,
         100 * b.u3 AS cpu_load,
         b.u4 * b.u1 AS anomaly_score,
         b.u3 * b.u3 AS failure_prob,
         1 - b.u2 * b.u4 AS health_index,
         CAST((b.event_id * 37) % 1825 AS DOUBLE) AS age_days,
         210 + 40 * b.u4 AS voltage, 2 + 8 * b.u1 AS current_a,
         100 * b.u2 AS timer_on, 100 * b.u3 AS timer_ch, 50 * b.u4 AS signal_delay,
         30 * b.u1 AS clearance_s, 600 * b.u2 AS headway_s,
         CAST(b.k AS DOUBLE) * 0.4e0 AS ambient_temp, 200 * b.u3 AS dust,
         5 + 360 * b.u2 AS rul_days
  FROM ev_base b JOIN nation n ON n.n_nationkey = b.user_id % 25
),
cascade_q AS (SELECT * FROM @CASCADE_Q@),
tel1 AS (
  SELECT t.*,
         CASE WHEN t.vibration > q.v75 THEN 'C1'
              WHEN t.resistance > q.r80 THEN 'C3'
              WHEN t.temperature > q.t80 THEN 'C5'
              WHEN t.cpu_load > q.c85 THEN 'C9'
              WHEN t.humidity > q.h75 THEN 'C10'
              WHEN t.cpu_load > q.c70 THEN 'C8'
              WHEN t.resistance > q.r60 THEN 'C2'
              WHEN t.vibration > q.v60 AND t.resistance < q.r30 THEN 'C6'
              WHEN t.age_days > q.a75 THEN 'C4'
              ELSE 'C7' END AS fault_code
  FROM tel0 t CROSS JOIN cascade_q q
),
telemetry AS (
  SELECT reading_id, event_time, asset_id, site_id, fault_code, occupancy_state, hmi_alert_code,
         CASE fault_code WHEN 'C1' THEN 'Immediate Replacement' WHEN 'C2' THEN 'Tighten Fasteners'
              WHEN 'C3' THEN 'Inspect Wiring' WHEN 'C4' THEN 'Re-tamp Ballast'
              WHEN 'C5' THEN 'Apply De-stressing' WHEN 'C6' THEN 'Re-gauge Track'
              WHEN 'C7' THEN 'Profile Grinding' WHEN 'C8' THEN 'Replace Relay'
              WHEN 'C9' THEN 'Restart PLC' WHEN 'C10' THEN 'Anti-corrosion Treatment' END AS maintenance_action,
         vibration, temperature, humidity, resistance, cpu_load, anomaly_score, failure_prob,
         health_index, age_days, voltage, current_a, timer_on, timer_ch, signal_delay, clearance_s,
         headway_s, ambient_temp, dust, rul_days
  FROM tel1
),
catalog(code, fault_description, recommended_action, base_priority) AS (
  VALUES ('C1', 'Rail Crack / Fracture', 'Immediate rail replacement; restrict speed to 20km/h', 'CRITICAL'),
         ('C2', 'Loose Fastener / Joint Failure', 'Tighten/replace fasteners; inspect adjacent joints', 'HIGH'),
         ('C3', 'Short Circuit in Track Circuit', 'Check track resistance; inspect bonding wires', 'CRITICAL'),
         ('C4', 'Ballast Degradation', 'Re-tamp ballast; schedule geometry correction', 'MEDIUM'),
         ('C5', 'Thermal Buckling Risk', 'Apply de-stressing procedure; monitor rail temp', 'HIGH'),
         ('C6', 'Gauge Widening', 'Re-gauge track; inspect sleeper anchors', 'HIGH'),
         ('C7', 'Wheel Impact Damage (Flat Spot)', 'Profile grinding; inspect affected rail section', 'MEDIUM'),
         ('C8', 'Signalling Relay Malfunction', 'Replace relay module; test signal interlocking', 'CRITICAL'),
         ('C9', 'PLC / Controller Overload', 'Restart PLC; review scan cycle timing', 'MEDIUM'),
         ('C10', 'Corrosion / Environmental Damage', 'Apply anti-corrosion treatment; replace corroded section', 'HIGH')
),
scored AS (
  SELECT t.*,
         CASE WHEN failure_prob > 0.75 OR rul_days < 15 THEN 'CRITICAL'
              WHEN failure_prob > 0.45 OR rul_days < 60 THEN 'WARNING' ELSE 'HEALTHY' END AS alert_level_basic,
         CASE WHEN failure_prob > 0.75 OR rul_days < 15 OR vibration > 0.70 OR temperature > 55 THEN 'CRITICAL'
              WHEN failure_prob > 0.45 OR rul_days < 60 OR vibration > 0.55 OR temperature > 45 THEN 'WARNING'
              ELSE 'HEALTHY' END AS alert_level_full,
         CASE WHEN (0.40e0 * (1 - failure_prob) + 0.25e0 * health_index + 0.20e0 * (1 - anomaly_score)
                    + 0.15e0 * (CASE WHEN rul_days / 365e0 < 0 THEN 0e0 WHEN rul_days / 365e0 > 1 THEN 1e0
                                     ELSE rul_days / 365e0 END)) * 100e0 < 0 THEN 0e0
              WHEN (0.40e0 * (1 - failure_prob) + 0.25e0 * health_index + 0.20e0 * (1 - anomaly_score)
                    + 0.15e0 * (CASE WHEN rul_days / 365e0 < 0 THEN 0e0 WHEN rul_days / 365e0 > 1 THEN 1e0
                                     ELSE rul_days / 365e0 END)) * 100e0 > 100 THEN 100e0
              ELSE (0.40e0 * (1 - failure_prob) + 0.25e0 * health_index + 0.20e0 * (1 - anomaly_score)
                    + 0.15e0 * (CASE WHEN rul_days / 365e0 < 0 THEN 0e0 WHEN rul_days / 365e0 > 1 THEN 1e0
                                     ELSE rul_days / 365e0 END)) * 100e0 END AS health_score
  FROM telemetry t
),
alert_rows AS (
  SELECT s.*,
         LEAST(100e0, GREATEST(0e0, 0.40e0 * failure_prob * 100e0
              + 0.30e0 * GREATEST(0e0, LEAST(1e0, 1e0 - rul_days / 365e0)) * 100e0
              + 0.15e0 * anomaly_score * 100e0 + 0.15e0 * 0e0 * 100e0)) AS alert_score
  FROM scored s
  WHERE alert_level_full IN ('CRITICAL', 'WARNING')
),
alerts AS (
  SELECT a.reading_id, a.event_time, a.asset_id, a.site_id, a.fault_code, a.occupancy_state,
         a.hmi_alert_code, a.maintenance_action, a.vibration, a.temperature, a.humidity, a.resistance,
         a.cpu_load, a.anomaly_score, a.failure_prob, a.health_index, a.age_days, a.voltage, a.current_a,
         a.timer_on, a.timer_ch, a.signal_delay, a.clearance_s, a.headway_s, a.ambient_temp, a.dust,
         a.rul_days, a.alert_level_full, a.alert_score,
         COALESCE(c.fault_description, 'Unknown') AS fault_description,
         COALESCE(c.recommended_action, 'Inspect and diagnose') AS recommended_action,
         COALESCE(c.base_priority, 'LOW') AS base_priority
  FROM alert_rows a LEFT JOIN catalog c ON c.code = a.fault_code
),
edge_q AS (SELECT * FROM @EDGE_Q@),
readings AS (
  SELECT s.*, CASE WHEN s.anomaly_score > q.aq THEN 1 ELSE 0 END AS edge_flag
  FROM scored s CROSS JOIN edge_q q
),
block_sum AS (
  SELECT asset_id AS block_id,
         round(avg(health_score), 1) AS avg_health,
         round(avg(vibration), 3) AS avg_vibration,
         round(avg(rul_days), 1) AS avg_rul,
         CAST(sum(CASE WHEN alert_level_basic = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS n_critical,
         CAST(sum(CASE WHEN alert_level_basic = 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS n_warning,
         CAST(sum(edge_flag) AS BIGINT) AS n_anomalies
  FROM readings WHERE asset_id IS NOT NULL GROUP BY asset_id
),
top_alerts AS (
  SELECT row_number() OVER (ORDER BY alert_score DESC, reading_id) AS rank,
         asset_id AS block_id, site_id AS location, alert_level_full AS level,
         round(alert_score, 1) AS score, fault_description AS fault, recommended_action AS action,
         round(failure_prob, 3) AS failure_prob, round(rul_days, 1) AS rul
  FROM alerts
),
mm AS (
  SELECT min(failure_prob) AS p_lo, max(failure_prob) AS p_hi, min(vibration) AS v_lo,
         max(vibration) AS v_hi, min(age_days) AS a_lo, max(age_days) AS a_hi FROM telemetry
),
relab AS (
  SELECT t.*,
         round(CASE WHEN r.raw < 5 THEN 5e0 WHEN r.raw > 365 THEN 365e0 ELSE r.raw END, 2) AS rul_new,
         round(CASE WHEN r.pb < 0 THEN 0e0 WHEN r.pb > 1 THEN 1e0 ELSE r.pb END, 4) AS prob_new
  FROM telemetry t JOIN (
    SELECT t2.reading_id,
           (0.40e0 * (1 - CASE WHEN p_hi - p_lo > 0 THEN (failure_prob - p_lo) / (p_hi - p_lo) ELSE 0e0 END)
            + 0.30e0 * (1 - CASE WHEN v_hi - v_lo > 0 THEN (vibration - v_lo) / (v_hi - v_lo) ELSE 0e0 END)
            + 0.30e0 * (1 - CASE WHEN a_hi - a_lo > 0 THEN (age_days - a_lo) / (a_hi - a_lo) ELSE 0e0 END))
             * 340e0 + 0e0 AS raw,
           0.60e0 * (CASE fault_code WHEN 'C1' THEN 0.9e0 WHEN 'C3' THEN 0.85e0 WHEN 'C5' THEN 0.80e0
                          WHEN 'C9' THEN 0.75e0 WHEN 'C10' THEN 0.70e0 WHEN 'C8' THEN 0.65e0
                          WHEN 'C2' THEN 0.55e0 WHEN 'C6' THEN 0.50e0 WHEN 'C4' THEN 0.40e0
                          WHEN 'C7' THEN 0.30e0 END) + 0.40e0 * failure_prob + 0e0 AS pb
    FROM telemetry t2 CROSS JOIN mm
  ) r ON r.reading_id = t.reading_id
),
pseudo AS (
  SELECT reading_id, fault_code AS actual,
         CASE WHEN u < 0.25 THEN concat('C', CAST(1 + CAST(floor(u * 40) AS INTEGER) AS VARCHAR))
              ELSE fault_code END AS predicted
  FROM (SELECT reading_id, fault_code,
               CAST(CAST(('0x' || substring(md5('pred:' || CAST(reading_id AS VARCHAR)), 1, 8)) AS BIGINT) AS DOUBLE)
                 / 4294967296e0 AS u
        FROM telemetry) z
),
vibration AS (
  SELECT e.event_id AS sample_id, e.ts AS event_time, concat('B', CAST(e.user_id AS VARCHAR)) AS asset_id,
         e.value / 100 AS x,
         (CAST(substring(e.props, 7, length(e.props) - 7) AS DOUBLE) - 50) / 50 AS y,
         1 + CAST((e.event_id * 7919 + 13) % 1009 AS DOUBLE) / 5045 AS z,
         20 + CAST((e.event_id * 6271 + 29) % 1013 AS DOUBLE) / 50 AS Temp,
         40 + CAST((e.event_id * 4801 + 47) % 1019 AS DOUBLE) / 25 AS Hum
  FROM events e
),
vib_f AS (SELECT v.*, sqrt(x * x + y * y + z * z) AS accel_magnitude FROM vibration v),
vib_s AS (SELECT avg(accel_magnitude) AS m, stddev_samp(accel_magnitude) AS sd FROM vib_f),
vib_feat AS (
  SELECT f.*,
         avg(accel_magnitude) OVER (ORDER BY event_time, sample_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS rolling_mag,
         CASE WHEN s.sd > 0 THEN (accel_magnitude - s.m) / s.sd ELSE 0e0 END AS vibr_zscore
  FROM vib_f f CROSS JOIN vib_s s
)
"""


def with_ctes(body: str) -> str:
    body = body.strip()
    ctes = TELEMETRY_CTES.replace("@CASCADE_Q@", CASCADE_Q).replace("@EDGE_Q@", EDGE_Q)
    if body[:5].upper() == "WITH ":
        # The body's own CTEs follow the shared ones in the same WITH list.
        return "WITH " + ctes.strip() + ",\n" + body[5:]
    return "WITH " + ctes.strip() + "\n" + body


SQL: dict[str, str] = {}


def _decimal_round(sql: str) -> str:
    """Rewrite ``round(x, d)`` to round the decimal text of x half-up.

    That is Spark's definition of ``round`` on doubles (HALF_UP applied to
    the shortest decimal representation); DuckDB's double ``round`` can differ
    on values whose text ends in 5 one digit below the rounding position.
    """
    out, i, low = [], 0, sql
    while True:
        j = low.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_"):
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner_x = _decimal_round(sql[j + 6:comma]) if comma > 0 else None
        digits = sql[comma + 1:k - 1].strip() if comma > 0 else ""
        out.append(sql[i:j])
        if inner_x is not None and digits.isdigit():
            out.append(f"CAST(round(CAST(CAST(({inner_x}) AS VARCHAR) AS DECIMAL(38, 24)), {digits}) AS DOUBLE)")
        else:
            out.append(sql[j:k])
        i = k


def register(name: str, body: str) -> None:
    SQL[name] = _decimal_round(with_ctes(body))


register("alert_log", "SELECT * FROM alerts")
register("scan_readings", "SELECT * FROM telemetry")
register("csv_readings", """
SELECT row_number() OVER (ORDER BY event_time, reading_id) - 1 AS reading_id, event_time, asset_id, site_id, vibration, rul_days
FROM telemetry""")

# --- rules (F) -------------------------------------------------------------
register("health_score", "SELECT reading_id, health_score FROM scored")
register("alert_level_basic", "SELECT reading_id, alert_level_basic FROM scored")
register("alert_level_full", "SELECT reading_id, alert_level_full FROM scored")
register("alert_score", """
SELECT reading_id,
       LEAST(100e0, GREATEST(0e0, 0.40e0 * failure_prob * 100e0
            + 0.30e0 * GREATEST(0e0, LEAST(1e0, 1e0 - rul_days / 365e0)) * 100e0
            + 0.15e0 * anomaly_score * 100e0 + 0.15e0 * 0e0 * 100e0)) AS alert_score
FROM telemetry""")
register("rul_band", """
SELECT reading_id, rul_days,
       CASE WHEN rul_days < 15 THEN 'CRITICAL' WHEN rul_days < 60 THEN 'WARNING'
            WHEN rul_days < 120 THEN 'MONITOR' ELSE 'HEALTHY' END AS rul_band
FROM telemetry""")
register("health_band", """
SELECT block_id, avg_health,
       CASE WHEN avg_health >= 70 THEN 'good' WHEN avg_health >= 40 THEN 'fair' ELSE 'poor' END AS health_band,
       avg_rul,
       CASE WHEN avg_rul < 60 THEN 'poor' WHEN avg_rul < 120 THEN 'fair' ELSE 'good' END AS rul_band
FROM block_sum""")
register("fault_cascade", "SELECT reading_id, fault_code FROM telemetry")
register("maintenance_map", "SELECT reading_id, fault_code, maintenance_action FROM telemetry")
register("fault_catalog_join", """
SELECT t.reading_id, t.fault_code,
       COALESCE(c.fault_description, 'Unknown') AS fault_description,
       COALESCE(c.recommended_action, 'Inspect and diagnose') AS recommended_action,
       COALESCE(c.base_priority, 'LOW') AS base_priority
FROM telemetry t LEFT JOIN catalog c ON c.code = t.fault_code""")
register("fault_description", """
SELECT t.reading_id,
       CASE WHEN c.fault_description IS NULL THEN 'Unknown fault type: ' || t.fault_code
            ELSE c.fault_description || ' — ' || c.recommended_action END AS fault_text
FROM telemetry t LEFT JOIN catalog c ON c.code = t.fault_code""")
register("sensor_quantiles", """
SELECT v75 AS vibration_q750, v60 AS vibration_q600, r80 AS resistance_q800, r60 AS resistance_q600,
       r30 AS resistance_q300, t80 AS temperature_q800, c85 AS cpu_load_q850, c70 AS cpu_load_q700,
       h75 AS humidity_q750, a75 AS age_days_q750
FROM cascade_q""")
register("rul_recompute", "SELECT reading_id, rul_new AS rul_days_new FROM relab")
register("prob_blend", "SELECT reading_id, fault_code, prob_new AS failure_prob_new FROM relab")
register("relabel", """
SELECT reading_id, event_time, asset_id, site_id, fault_code, occupancy_state, hmi_alert_code,
       maintenance_action, vibration, temperature, humidity, resistance, cpu_load, anomaly_score,
       prob_new AS failure_prob, health_index, age_days, voltage, current_a, timer_on, timer_ch,
       signal_delay, clearance_s, headway_s, ambient_temp, dust, rul_new AS rul_days
FROM relab""")

# --- vibration samples (S2, S3, F1-F3, W1 global, P10, P11, A9) ------------
register("vibration_alias", "SELECT sample_id, event_time, asset_id, x, y, z, Temp, Hum FROM vibration")
register("vibration_folder", "SELECT sample_id, event_time, x, y, z, Temp, Hum FROM vibration")
register("vibration_features", """
SELECT sample_id, accel_magnitude, round(rolling_mag, 9) AS rolling_mag,
       round(vibr_zscore, 8) AS vibr_zscore,
       CASE WHEN abs(vibr_zscore) > 2.5 THEN 1 ELSE 0 END AS vibr_anomaly
FROM vib_feat""")
register("vibration_downsampled", """
SELECT row_idx, round(accel_magnitude, 4) AS accel_magnitude, round(rolling_mag, 4) AS rolling_mag,
       vibr_anomaly, round(Temp, 1) AS temp, round(Hum, 1) AS hum
FROM (SELECT *, row_number() OVER (ORDER BY event_time, sample_id) - 1 AS row_idx,
             CASE WHEN abs(vibr_zscore) > 2.5 THEN 1 ELSE 0 END AS vibr_anomaly FROM vib_feat) z
WHERE row_idx % 3 = 0""")
register("vibration_split", """
SELECT sample_id,
       CASE WHEN abs(vibr_zscore) > 2.5 THEN NULL ELSE accel_magnitude END AS normal,
       CASE WHEN abs(vibr_zscore) > 2.5 THEN accel_magnitude ELSE NULL END AS anomalous
FROM vib_feat""")
register("vibration_histogram", """
WITH st AS (SELECT min(accel_magnitude) AS lo, max(accel_magnitude) AS hi FROM vib_f),
cnt AS (
  SELECT CASE WHEN (hi - lo) / 20 > 0
              THEN LEAST(19, CAST(floor((accel_magnitude - lo) / ((hi - lo) / 20)) AS INTEGER)) ELSE 0 END AS bin,
         count(*) AS n
  FROM vib_f CROSS JOIN st WHERE accel_magnitude IS NOT NULL GROUP BY 1
),
grid AS (SELECT CAST(range AS INTEGER) AS bin, lo, hi FROM range(0, 20) CROSS JOIN st)
SELECT g.bin, g.lo + (g.hi - g.lo) * g.bin / 20 AS bin_lo, g.lo + (g.hi - g.lo) * (g.bin + 1) / 20 AS bin_hi,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cnt c ON c.bin = g.bin""")

# --- roll-ups (A1-A8) and top-k (O3, O4, O7), selectors (P5, P6) -----------
register("block_summary", "SELECT * FROM block_sum")
register("document_chunks", """
SELECT *, row_number() OVER (ORDER BY block_id) - 1 AS position,
       CAST(floor((row_number() OVER (ORDER BY block_id) - 1) / 40) AS BIGINT) AS chunk
FROM block_sum""")
register("location_summary", """
SELECT site_id AS location_id, round(avg(health_score), 1) AS avg_health,
       count(DISTINCT asset_id) AS n_blocks,
       CAST(sum(CASE WHEN alert_level_basic <> 'HEALTHY' THEN 1 ELSE 0 END) AS BIGINT) AS n_alerts
FROM readings WHERE site_id IS NOT NULL GROUP BY site_id""")
register("alert_distribution", """
SELECT alert_level_basic, count(*) AS n FROM readings WHERE alert_level_basic IS NOT NULL GROUP BY 1""")
register("failure_distribution", "SELECT fault_code, count(*) AS n FROM telemetry WHERE fault_code IS NOT NULL GROUP BY 1")
register("maintenance_distribution", """
SELECT maintenance_action, count(*) AS n FROM telemetry WHERE maintenance_action IS NOT NULL GROUP BY 1""")
register("alert_summary", """
SELECT count(*) AS total_alerts,
       CAST(sum(CASE WHEN alert_level_full = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS n_critical,
       CAST(sum(CASE WHEN alert_level_full = 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS n_warning,
       round(avg(alert_score), 9) AS avg_score
FROM alerts""")
register("kpi_rollup", """
SELECT count(*) AS n_blocks, round(avg(avg_health), 9) AS avg_health,
       CAST(sum(n_critical) AS BIGINT) AS total_critical, CAST(sum(n_warning) AS BIGINT) AS total_warning,
       CAST(sum(n_anomalies) AS BIGINT) AS total_anomalies, round(avg(avg_rul), 9) AS avg_rul
FROM block_sum""")
register("alerts_top50", "SELECT * FROM top_alerts WHERE rank <= 50")
register("alerts_topk", "SELECT * FROM top_alerts WHERE rank <= 5")
register("shown_level_counts", "SELECT level, count(*) AS n FROM top_alerts WHERE rank <= 50 GROUP BY level")
register("alerts_by_level", """
SELECT reading_id, asset_id, site_id, alert_level_full, alert_score, fault_description
FROM alerts WHERE alert_level_full = 'CRITICAL'""")
register("selected_blocks", """
SELECT asset_id AS block_id,
       round(avg(health_score), 1) AS avg_health,
       round(avg(vibration), 3) AS avg_vibration,
       round(avg(rul_days), 1) AS avg_rul,
       CAST(sum(CASE WHEN alert_level_basic = 'CRITICAL' THEN 1 ELSE 0 END) AS BIGINT) AS n_critical,
       CAST(sum(CASE WHEN alert_level_basic = 'WARNING' THEN 1 ELSE 0 END) AS BIGINT) AS n_warning,
       CAST(sum(edge_flag) AS BIGINT) AS n_anomalies
FROM readings
WHERE asset_id IS NOT NULL
  AND site_id IN (SELECT n.n_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey
                  WHERE r.r_name = 'AMERICA')
GROUP BY asset_id""")
register("block_detail", """
SELECT row_number() OVER (ORDER BY CAST(NULLIF(regexp_extract(block_id, '(\\d+)', 1), '') AS BIGINT), block_id)
         AS position,
       block_id, avg_health, avg_vibration, avg_rul, n_critical, n_warning, n_anomalies
FROM block_sum""")
register("time_series_downsampled", """
SELECT row_idx, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS timestamp, round(vibration, 3) AS vibration,
       round(temperature, 1) AS temperature, round(health_score, 1) AS health_score,
       round(failure_prob, 3) AS failure_prob
FROM (SELECT *, row_number() OVER (ORDER BY event_time, reading_id) - 1 AS row_idx FROM scored) z
WHERE row_idx % 3 = 0""")

# --- order layer (W1, W2, W4, W5, W8) --------------------------------------
register("rolling_mean_30", """
SELECT reading_id, asset_id,
       round(avg(vibration) OVER (PARTITION BY asset_id ORDER BY event_time, reading_id
                                  ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), 10) AS vib_roll30
FROM telemetry""")
register("sequences_30", """
SELECT reading_id, asset_id, seq_len, first_vibration, last_vibration, rul_days AS target FROM (
  SELECT reading_id, asset_id, rul_days,
         count(*) OVER w AS seq_len,
         first_value(vibration) OVER w AS first_vibration,
         last_value(vibration) OVER w AS last_vibration
  FROM telemetry
  WINDOW w AS (PARTITION BY asset_id ORDER BY event_time, reading_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)
) z WHERE seq_len = 30""")
register("time_split", """
SELECT reading_id, row_idx, row_idx >= CAST(floor(count(*) OVER () * 0.8) AS BIGINT) AS is_test
FROM (SELECT reading_id, row_number() OVER (ORDER BY event_time, reading_id) - 1 AS row_idx FROM telemetry) z""")
register("stratified_split", """
SELECT reading_id, fault_code,
       row_number() OVER (PARTITION BY fault_code ORDER BY u, reading_id) - 1
         < round(count(*) OVER (PARTITION BY fault_code) * 0.2) AS is_test
FROM (SELECT reading_id, fault_code,
             CAST(CAST(('0x' || substring(md5('split:' || CAST(reading_id AS VARCHAR)), 1, 8)) AS BIGINT) AS DOUBLE)
               / 4294967296e0 AS u
      FROM telemetry) z""")
for _name in ("window_rul_predictions", "window_fault_predictions"):
    register(_name, """
SELECT reading_id, asset_id, true AS predicted FROM (
  SELECT reading_id, asset_id, row_number() OVER (PARTITION BY asset_id ORDER BY event_time, reading_id) AS n FROM telemetry) z
WHERE n > 30""")
register("shap_additivity", """
SELECT reading_id, CAST(20 AS BIGINT) AS n_features, true AS additive
FROM (SELECT reading_id, fault_code,
             row_number() OVER (PARTITION BY fault_code ORDER BY u, reading_id) - 1
               < round(count(*) OVER (PARTITION BY fault_code) * 0.2) AS is_test
      FROM (SELECT reading_id, fault_code,
                   CAST(CAST(('0x' || substring(md5('split:' || CAST(reading_id AS VARCHAR)), 1, 8)) AS BIGINT) AS DOUBLE)
                     / 4294967296e0 AS u
            FROM relab) z) t
WHERE is_test""")
register("rul_scatter", """
SELECT position, round(rul_days, 1) AS actual, round(rul_new, 1) AS predicted FROM (
  SELECT rul_days, rul_new, row_number() OVER (ORDER BY event_time, reading_id) - 1
           - CAST(floor((SELECT count(*) FROM relab) * 0.8) AS BIGINT) AS position
  FROM relab) z
WHERE position >= 0 AND position < 200""")

# --- feature preparation (P1, P3, M1, M3, M4, J6) and chains (M14) ---------
register("label_encode", """
SELECT reading_id,
       CAST(dense_rank() OVER (ORDER BY COALESCE(fault_code, 'nan')) - 1 AS INTEGER) AS fault_code_enc,
       CAST(dense_rank() OVER (ORDER BY COALESCE(occupancy_state, 'nan')) - 1 AS INTEGER) AS occupancy_state_enc,
       CAST(dense_rank() OVER (ORDER BY COALESCE(hmi_alert_code, 'nan')) - 1 AS INTEGER) AS hmi_alert_code_enc,
       CAST(dense_rank() OVER (ORDER BY COALESCE(maintenance_action, 'nan')) - 1 AS INTEGER) AS maintenance_action_enc
FROM telemetry""")
register("standard_scale", """
WITH st AS (
  SELECT avg(vibration) AS m1, stddev_pop(vibration) AS s1, avg(temperature) AS m2, stddev_pop(temperature) AS s2,
         avg(resistance) AS m3, stddev_pop(resistance) AS s3, avg(cpu_load) AS m4, stddev_pop(cpu_load) AS s4,
         avg(anomaly_score) AS m5, stddev_pop(anomaly_score) AS s5, avg(failure_prob) AS m6,
         stddev_pop(failure_prob) AS s6, avg(humidity) AS m7, stddev_pop(humidity) AS s7,
         avg(age_days) AS m8, stddev_pop(age_days) AS s8
  FROM telemetry)
SELECT reading_id,
       round((vibration - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END, 9) AS vibration_std,
       round((temperature - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END, 9) AS temperature_std,
       round((resistance - m3) / CASE WHEN s3 > 0 THEN s3 ELSE 1 END, 9) AS resistance_std,
       round((cpu_load - m4) / CASE WHEN s4 > 0 THEN s4 ELSE 1 END, 9) AS cpu_load_std,
       round((anomaly_score - m5) / CASE WHEN s5 > 0 THEN s5 ELSE 1 END, 9) AS anomaly_score_std,
       round((failure_prob - m6) / CASE WHEN s6 > 0 THEN s6 ELSE 1 END, 9) AS failure_prob_std,
       round((humidity - m7) / CASE WHEN s7 > 0 THEN s7 ELSE 1 END, 9) AS humidity_std,
       round((age_days - m8) / CASE WHEN s8 > 0 THEN s8 ELSE 1 END, 9) AS age_days_std
FROM telemetry CROSS JOIN st""")
register("minmax_scale", """
WITH ix AS (SELECT *, row_number() OVER (ORDER BY event_time, reading_id) - 1 AS row_idx,
                   count(*) OVER () AS n FROM telemetry),
st AS (SELECT min(vibration) AS a1, max(vibration) AS b1, min(temperature) AS a2, max(temperature) AS b2,
              min(humidity) AS a3, max(humidity) AS b3, min(age_days) AS a4, max(age_days) AS b4,
              min(rul_days) AS a5, max(rul_days) AS b5
       FROM ix WHERE row_idx < CAST(floor(n * 0.8) AS BIGINT))
SELECT reading_id, row_idx >= CAST(floor(n * 0.8) AS BIGINT) AS is_test,
       round((vibration - a1) / CASE WHEN b1 - a1 > 0 THEN b1 - a1 ELSE 1 END, 9) AS vibration_mm,
       round((temperature - a2) / CASE WHEN b2 - a2 > 0 THEN b2 - a2 ELSE 1 END, 9) AS temperature_mm,
       round((humidity - a3) / CASE WHEN b3 - a3 > 0 THEN b3 - a3 ELSE 1 END, 9) AS humidity_mm,
       round((age_days - a4) / CASE WHEN b4 - a4 > 0 THEN b4 - a4 ELSE 1 END, 9) AS age_days_mm,
       round((rul_days - a5) / CASE WHEN b5 - a5 > 0 THEN b5 - a5 ELSE 1 END, 9) AS rul_days_mm
FROM ix CROSS JOIN st""")
register("feature_projection", """
SELECT reading_id, vibration, temperature, humidity, resistance, cpu_load, anomaly_score, failure_prob,
       health_index, age_days, voltage, current_a, timer_on, timer_ch, signal_delay, clearance_s,
       headway_s, ambient_temp, dust
FROM telemetry""")
register("feature_fill", """
SELECT reading_id, COALESCE(vibration, 0e0) AS vibration, COALESCE(temperature, 0e0) AS temperature,
       COALESCE(humidity, 0e0) AS humidity, COALESCE(resistance, 0e0) AS resistance,
       COALESCE(cpu_load, 0e0) AS cpu_load, COALESCE(anomaly_score, 0e0) AS anomaly_score,
       COALESCE(failure_prob, 0e0) AS failure_prob, COALESCE(health_index, 0e0) AS health_index,
       COALESCE(age_days, 0e0) AS age_days, COALESCE(voltage, 0e0) AS voltage,
       COALESCE(current_a, 0e0) AS current_a, COALESCE(timer_on, 0e0) AS timer_on,
       COALESCE(timer_ch, 0e0) AS timer_ch, COALESCE(signal_delay, 0e0) AS signal_delay,
       COALESCE(clearance_s, 0e0) AS clearance_s, COALESCE(headway_s, 0e0) AS headway_s,
       COALESCE(ambient_temp, 0e0) AS ambient_temp, COALESCE(dust, 0e0) AS dust,
       0e0 AS if_flag, 0e0 AS hmi_alert_code_enc
FROM telemetry""")
register("class_weights", """
SELECT t.reading_id, t.fault_code, round(w.weight, 10) AS weight
FROM telemetry t JOIN (
  SELECT fault_code, (SELECT count(*) FROM telemetry) / ((SELECT count(DISTINCT fault_code) FROM telemetry) * count(*))
           AS weight
  FROM telemetry GROUP BY fault_code) w ON w.fault_code = t.fault_code""")
register("preprocess", """
SELECT t.*,
       CAST(dense_rank() OVER (ORDER BY COALESCE(t.fault_code, 'nan')) - 1 AS INTEGER) AS fault_code_enc,
       CAST(dense_rank() OVER (ORDER BY COALESCE(t.occupancy_state, 'nan')) - 1 AS INTEGER) AS occupancy_state_enc,
       CAST(dense_rank() OVER (ORDER BY COALESCE(t.hmi_alert_code, 'nan')) - 1 AS INTEGER) AS hmi_alert_code_enc,
       CAST(dense_rank() OVER (ORDER BY COALESCE(t.maintenance_action, 'nan')) - 1 AS INTEGER) AS maintenance_action_enc,
       s.health_score, s.alert_level_basic
FROM telemetry t JOIN scored s ON s.reading_id = t.reading_id""")

# --- metrics on rule flags / deterministic pseudo-predictions (A11-A15) ----
register("anomaly_eval", """
SELECT CAST(sum(edge_flag) AS BIGINT) AS n_anomalies,
       CASE WHEN count(*) > 0 THEN sum(edge_flag) / count(*) ELSE 0e0 END AS anomaly_rate,
       CASE WHEN sum(edge_flag) > 0
            THEN sum(CASE WHEN edge_flag = 1 AND failure_prob > 0.5 THEN 1 ELSE 0 END) / sum(edge_flag)
            ELSE 0e0 END AS precision_vs_high_prob
FROM readings""")
register("regression_metrics", """
WITH d AS (SELECT rul_days AS y, rul_new AS p FROM relab), m AS (SELECT avg(y) AS ybar FROM d)
SELECT round(avg(abs(p - y)), 9) AS mae, round(sqrt(avg((p - y) * (p - y))), 9) AS rmse,
       round(CASE WHEN sum((y - ybar) * (y - ybar)) > 0
                  THEN 1 - sum((p - y) * (p - y)) / sum((y - ybar) * (y - ybar)) ELSE 0e0 END, 9) AS r2
FROM d CROSS JOIN m""")
register("confusion_matrix", """
WITH labels AS (SELECT actual AS l FROM pseudo UNION SELECT predicted FROM pseudo),
cnt AS (SELECT actual, predicted, count(*) AS n FROM pseudo GROUP BY 1, 2)
SELECT a.l AS actual, p.l AS predicted, CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM labels a CROSS JOIN labels p LEFT JOIN cnt c ON c.actual = a.l AND c.predicted = p.l""")
register("classification_report", """
WITH labels AS (SELECT actual AS l FROM pseudo UNION SELECT predicted FROM pseudo),
per0 AS (
  SELECT l AS label,
         (SELECT count(*) FROM pseudo WHERE actual = l AND predicted = l) AS tp,
         (SELECT count(*) FROM pseudo WHERE actual = l) AS support,
         (SELECT count(*) FROM pseudo WHERE predicted = l) AS npred
  FROM labels),
per1 AS (
  SELECT label, CASE WHEN npred > 0 THEN tp / npred ELSE 0e0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0e0 END AS recall, support FROM per0),
per AS (
  SELECT label, precision, recall,
         CASE WHEN precision + recall > 0 THEN 2e0 * precision * recall / (precision + recall) ELSE 0e0 END AS f1,
         CAST(support AS BIGINT) AS support FROM per1)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM per
UNION ALL
SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), CAST(sum(support) AS BIGINT)
FROM per
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
       round(sum(f1 * support) / sum(support), 9), CAST(sum(support) AS BIGINT)
FROM per""")
register("accuracy", "SELECT round(avg(CASE WHEN actual = predicted THEN 1e0 ELSE 0e0 END), 12) AS accuracy FROM pseudo")

# --- streaming batch twins (R1-R5) -------------------------------------------
register("stream_alerts", """
SELECT reading_id, event_time, asset_id, alert_level_basic AS alert_level, fault_code, failure_prob,
       maintenance_action
FROM scored WHERE alert_level_basic IN ('CRITICAL', 'WARNING')""")
register("stream_lifecycle", """
SELECT reading_id, asset_id, alert_level_basic AS alert_level, CAST(1 AS BIGINT) AS n_resumed, CAST(1 AS BIGINT) AS n_reset
FROM scored WHERE alert_level_basic IN ('CRITICAL', 'WARNING')""")
register("stream_last50", """
SELECT asset_id, reading_id, event_time, vibration, temperature FROM telemetry
ORDER BY event_time DESC, reading_id DESC LIMIT 50""")
register("stream_asset_last50", """
SELECT asset_id, rank, reading_id, event_time, vibration, temperature FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY event_time DESC, reading_id DESC) AS INTEGER)
           AS rank
  FROM telemetry) z
WHERE rank <= 50""")
register("stream_last4", """
SELECT CAST(row_number() OVER (ORDER BY event_time DESC, reading_id DESC) AS INTEGER) AS position,
       reading_id, event_time, asset_id, alert_level, fault_code, failure_prob, maintenance_action
FROM (SELECT reading_id, event_time, asset_id, alert_level_basic AS alert_level, fault_code, failure_prob,
             maintenance_action
      FROM scored WHERE alert_level_basic IN ('CRITICAL', 'WARNING')
      ORDER BY event_time DESC, reading_id DESC LIMIT 4) z""")
register("stream_latest", """
SELECT asset_id, reading_id, event_time, vibration, temperature FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY event_time DESC, reading_id DESC) AS rn
  FROM telemetry) z
WHERE rn = 1""")
