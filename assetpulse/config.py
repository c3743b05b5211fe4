"""Rule parameters and catalogues, kept as data.

Every rule in the library takes these as arguments, so a deployment can
override any threshold or catalogue entry without touching code.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES. These must equal the behaviour being reproduced (alert rules,
# score weights, fault catalogue, maintenance map, severities, cascade
# quantiles). Change them only to change the business rules.
# ---------------------------------------------------------------------------

# Two-signal rule used by preprocessing and the dashboard roll-ups.
BASIC_THRESHOLDS = {
    "CRITICAL": {"failure_prob": 0.75, "rul": 15},
    "WARNING": {"failure_prob": 0.45, "rul": 60},
}

# Four-signal rule used by the alert log.
FULL_THRESHOLDS = {
    "CRITICAL": {"failure_prob": 0.75, "rul": 15, "vibration": 0.70, "temp": 55},
    "WARNING": {"failure_prob": 0.45, "rul": 60, "vibration": 0.55, "temp": 45},
}

# Health score: weights and defaults used when an input column is absent.
HEALTH_WEIGHTS = {"failure_prob": 0.40, "health_index": 0.25, "anomaly_score": 0.20, "rul": 0.15}
HEALTH_DEFAULTS = {"failure_prob": 0.5, "health_index": 0.5, "anomaly_score": 0.5, "rul_days": 180.0}
RUL_HORIZON_DAYS = 365.0

# Alert (urgency) score: weights and defaults used when an input column is absent.
ALERT_SCORE_WEIGHTS = {"failure_prob": 0.40, "rul": 0.30, "anomaly_score": 0.15, "if_flag": 0.15}
ALERT_SCORE_DEFAULTS = {"failure_prob": 0.0, "rul_days": 365.0, "anomaly_score": 0.0, "if_flag": 0.0}

# Defaults of the alert-level rules for absent columns.
ALERT_LEVEL_DEFAULTS = {"failure_prob": 0.0, "rul_days": 999.0, "vibration": 0.0, "temperature": 0.0}

# RUL bands (days): below 15 CRITICAL, below 60 WARNING, below 120 MONITOR.
RUL_BANDS = [(15, "CRITICAL"), (60, "WARNING"), (120, "MONITOR")]

# Display bands: health >= 70 good, >= 40 fair; mean RUL < 60 poor, < 120 fair.
HEALTH_BANDS = [(70.0, "good"), (40.0, "fair")]
RUL_DISPLAY_BANDS = [(60.0, "poor"), (120.0, "fair")]

# Fault catalogue: code -> (description, recommended action, base priority).
FAULT_CATALOG = [
    ("C1", "Rail Crack / Fracture", "Immediate rail replacement; restrict speed to 20km/h", "CRITICAL"),
    ("C2", "Loose Fastener / Joint Failure", "Tighten/replace fasteners; inspect adjacent joints", "HIGH"),
    ("C3", "Short Circuit in Track Circuit", "Check track resistance; inspect bonding wires", "CRITICAL"),
    ("C4", "Ballast Degradation", "Re-tamp ballast; schedule geometry correction", "MEDIUM"),
    ("C5", "Thermal Buckling Risk", "Apply de-stressing procedure; monitor rail temp", "HIGH"),
    ("C6", "Gauge Widening", "Re-gauge track; inspect sleeper anchors", "HIGH"),
    ("C7", "Wheel Impact Damage (Flat Spot)", "Profile grinding; inspect affected rail section", "MEDIUM"),
    ("C8", "Signalling Relay Malfunction", "Replace relay module; test signal interlocking", "CRITICAL"),
    ("C9", "PLC / Controller Overload", "Restart PLC; review scan cycle timing", "MEDIUM"),
    ("C10", "Corrosion / Environmental Damage", "Apply anti-corrosion treatment; replace corroded section", "HIGH"),
]
UNKNOWN_FAULT = ("Unknown", "Inspect and diagnose", "LOW")
UNKNOWN_FAULT_TEXT_PREFIX = "Unknown fault type: "
FAULT_TEXT_SEPARATOR = " — "

# Maintenance action per fault code (relabelling step).
MAINTENANCE_ACTIONS = [
    ("C1", "Immediate Replacement"),
    ("C2", "Tighten Fasteners"),
    ("C3", "Inspect Wiring"),
    ("C4", "Re-tamp Ballast"),
    ("C5", "Apply De-stressing"),
    ("C6", "Re-gauge Track"),
    ("C7", "Profile Grinding"),
    ("C8", "Replace Relay"),
    ("C9", "Restart PLC"),
    ("C10", "Anti-corrosion Treatment"),
]

# Severity per fault code used by the probability blend.
FAULT_SEVERITY = [
    ("C1", 0.9), ("C3", 0.85), ("C5", 0.80), ("C9", 0.75), ("C10", 0.70),
    ("C8", 0.65), ("C2", 0.55), ("C6", 0.50), ("C4", 0.40), ("C7", 0.30),
]

# Fault cascade, highest priority first: (code, column, op, quantile).
# A rule with a second clause is a conjunction. Rows matching none get DEFAULT_FAULT.
FAULT_CASCADE = [
    ("C1", [("vibration", ">", 0.75)]),
    ("C3", [("resistance", ">", 0.80)]),
    ("C5", [("temperature", ">", 0.80)]),
    ("C9", [("cpu_load", ">", 0.85)]),
    ("C10", [("humidity", ">", 0.75)]),
    ("C8", [("cpu_load", ">", 0.70)]),
    ("C2", [("resistance", ">", 0.60)]),
    ("C6", [("vibration", ">", 0.60), ("resistance", "<", 0.30)]),
    ("C4", [("age_days", ">", 0.75)]),
]
DEFAULT_FAULT = "C7"

# RUL recompute: 340 * (0.4(1-p) + 0.3(1-vib) + 0.3(1-age)) + N(0, 8), clipped 5..365, 2 dp.
RUL_RECOMPUTE = {"scale": 340.0, "w_prob": 0.40, "w_vib": 0.30, "w_age": 0.30,
                 "noise_sd": 8.0, "lo": 5.0, "hi": 365.0, "digits": 2}
# Probability blend: 0.6 * severity + 0.4 * p + N(0, 0.03), clipped 0..1, 4 dp.
PROB_BLEND = {"w_severity": 0.60, "w_prob": 0.40, "noise_sd": 0.03, "digits": 4}

# Vibration features: rolling window, z-score flag limit, plot stride.
ROLLING_WINDOW = 30
Z_LIMIT = 2.5
DOWNSAMPLE_STEP = 3
SEQUENCE_LENGTH = 30

# Model defaults.
IFOREST = {"trees": 200, "contamination": 0.08, "sample_size": 256, "seed": 42}
RUL_GBT = {"iters": 300, "step": 0.05, "depth": 5, "test": 0.20, "seed": 42}
FAULT_RF = {"trees": 300, "depth": 12, "test": 0.20, "seed": 42}
ANOMALY_PRECISION_PROB = 0.5

ALERT_LEVELS = ["CRITICAL", "WARNING", "HEALTHY"]
CATEGORICAL_COLUMNS = ["fault_code", "occupancy_state", "hmi_alert_code", "maintenance_action"]
