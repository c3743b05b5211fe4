"""Schemas, feature lists and column aliases (readings in snake_case)."""

from __future__ import annotations

from pyspark.sql import types as T

# FIXED VALUES: the sensor export's header names (they must equal the input
# format to be read). Source column name -> our column name; the readers use
# it to accept tables that still carry these headers.
READING_ALIASES = {
    "Timestamp": "event_time",
    "Track_Block_ID": "asset_id",
    "Location_ID": "site_id",
    "Failure_Type": "fault_code",
    "Occupancy_State": "occupancy_state",
    "HMI_Alert_Code": "hmi_alert_code",
    "Maintenance_Action": "maintenance_action",
    "Vibration_m_s2": "vibration",
    "Temperature_C": "temperature",
    "Humidity_percent": "humidity",
    "Track_Resistance_Ohm": "resistance",
    "PLC_CPU_Load_percent": "cpu_load",
    "Edge_Anomaly_Score": "anomaly_score",
    "Predicted_Failure_Prob": "failure_prob",
    "Cloud_Health_Index": "health_index",
    "Component_Age_days": "age_days",
    "Voltage_V": "voltage",
    "Current_A": "current_a",
    "Timer_TON_ms": "timer_on",
    "Timer_TCH_ms": "timer_ch",
    "Signal_Transition_Delay_ms": "signal_delay",
    "Block_Clearance_Time_s": "clearance_s",
    "Train_Headway_s": "headway_s",
    "Ambient_Temp_C": "ambient_temp",
    "Dust_Index_ppm": "dust",
    "RUL_Predicted_days": "rul_days",
}

SENSOR_COLUMNS = [
    "vibration", "temperature", "humidity", "resistance", "cpu_load", "anomaly_score",
    "failure_prob", "health_index", "age_days", "voltage", "current_a", "timer_on",
    "timer_ch", "signal_delay", "clearance_s", "headway_s", "ambient_temp", "dust",
    "rul_days",
]
STRING_COLUMNS = ["asset_id", "site_id", "fault_code", "occupancy_state", "hmi_alert_code",
                  "maintenance_action"]

READINGS_SCHEMA = T.StructType(
    [T.StructField("reading_id", T.LongType()), T.StructField("event_time", T.TimestampNTZType())]
    + [T.StructField(c, T.StringType()) for c in STRING_COLUMNS]
    + [T.StructField(c, T.DoubleType()) for c in SENSOR_COLUMNS]
)

# FIXED VALUES: feature lists of the three models (order matters: it is the vector order).
ANOMALY_FEATURES = ["vibration", "temperature", "resistance", "cpu_load", "anomaly_score",
                    "failure_prob", "humidity", "age_days"]
RUL_FEATURES = ["vibration", "temperature", "humidity", "resistance", "cpu_load", "anomaly_score",
                "failure_prob", "health_index", "age_days", "voltage", "current_a", "timer_on",
                "timer_ch", "signal_delay", "clearance_s", "headway_s", "ambient_temp", "dust",
                "if_flag"]
FAULT_FEATURES = RUL_FEATURES + ["hmi_alert_code_enc"]
RUL_TARGET = "rul_days"
FAULT_TARGET = "fault_code_enc"

# FIXED VALUES: accepted accelerometer header spellings (case/space-insensitive)
# -> canonical name.
VIBRATION_ALIASES = {
    "x": "x", "accel_x": "x", "acc_x": "x",
    "y": "y", "accel_y": "y", "acc_y": "y",
    "z": "z", "accel_z": "z", "acc_z": "z",
    "time": "Time", "timestamp": "Time", "time_s": "Time",
    "temp": "Temp", "temperature": "Temp",
    "hum": "Hum", "humidity": "Hum",
}

ALERT_LOG_EXTRA = T.StructType([
    T.StructField("alert_level_full", T.StringType()),
    T.StructField("alert_score", T.DoubleType()),
    T.StructField("fault_description", T.StringType()),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("base_priority", T.StringType()),
])
