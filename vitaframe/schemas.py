"""Schemas of the record table and of the raw exports."""

from __future__ import annotations

from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("participant_id", T.StringType(), False),
        T.StructField("metric_type", T.StringType(), False),
        T.StructField("datetime", T.TimestampType(), False),
        T.StructField("epoch_raw", T.LongType()),
        T.StructField("value_1", T.DoubleType()),
        T.StructField("value_2", T.DoubleType()),
        T.StructField("unit", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
        T.StructField("quality_flag", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("row_pos", T.LongType()),
    ]
)
RECORD_COLUMNS = RECORD_SCHEMA.fieldNames()

# Declared columns of standardized tables, per metric.
DECLARED_SCHEMAS = {
    "bp": {
        "required": ["datetime", "systolic", "diastolic"],
        "optional": ["pulse", "device_id"],
        "value_1": "systolic",
        "value_2": "diastolic",
        "unit": "mmHg",
        "range_1": (80, 200),
        "range_2": (50, 130),
    },
    "sleep": {
        "required": ["datetime", "sleep_duration"],
        "optional": ["sleep_quality", "deep_sleep", "light_sleep", "rem_sleep"],
        "value_1": "sleep_duration",
        "value_2": "sleep_quality",
        "unit": "hours",
        "range_1": (0, 24),
        "range_2": (0, 100),
    },
    "steps": {
        "required": ["datetime", "step_count"],
        "optional": ["distance", "calories"],
        "value_1": "step_count",
        "value_2": "distance",
        "unit": "steps",
        "range_1": (0, 50000),
        "range_2": (0, 100),
    },
    "hr": {
        "required": ["datetime", "heart_rate"],
        "optional": ["resting_hr", "max_hr"],
        "value_1": "heart_rate",
        "value_2": "resting_hr",
        "unit": "bpm",
        "range_1": (30, 220),
        "range_2": (30, 120),
    },
    "spo2": {
        "required": ["datetime", "spo2"],
        "optional": ["confidence"],
        "value_1": "spo2",
        "value_2": "confidence",
        "unit": "%",
        "range_1": (80, 100),
        "range_2": (0, 100),
    },
    "temp": {
        "required": ["datetime", "temperature"],
        "optional": ["ambient_temp"],
        "value_1": "temperature",
        "value_2": "ambient_temp",
        "unit": "°F",
        "range_1": (90, 105),
        "range_2": (50, 120),
    },
}

# Candidate columns of the raw exports; the first existing one wins.
EXPORT_COLUMNS = {
    "bp": {
        "datetime": ["createdTime", "logDate", "logDateTime"],
        "value": ["systolic"],
        "secondary": ["diastolic"],
    },
    "sleep": {
        "datetime": ["logDateTime", "logDate", "createdTime"],
        "value": ["lightSleep", "deepSleep", "almostAwake"],
        "secondary": [],
    },
    "steps": {
        "datetime": ["logDateTime", "logDate", "createdTime"],
        "value": ["steps"],
        "secondary": ["distance", "calories"],
    },
    "hr": {
        "datetime": ["logDateTime", "group", "createdTime"],
        "value": ["averageSessionHeartRate", "lastRate", "heartRate"],
        "secondary": ["maxRate", "minRate"],
    },
    "spo2": {
        "datetime": ["createdTime", "logDate", "timestamp"],
        "value": ["spo2", "oxygen_saturation", "value"],
        "secondary": ["confidence", "quality"],
    },
    "temp": {
        "datetime": ["createdTime", "logDate", "timestamp"],
        "value": ["temperature", "temp", "value"],
        "secondary": ["ambient_temp"],
    },
}

# Export file patterns per metric.
FILE_PATTERNS = {
    "bp": "bp_*.csv",
    "sleep": "sleep_*.csv",
    "steps": "steps_*.csv",
    "hr": "heartrate_*.json",
    "spo2": "spo2_*.json",
    "temp": "temperature_*.json",
}
MEALS_FILE = "meals_data/Combined Meals Data.csv"
LUNGS_FILE = "lungs_data/spirometry.csv"

MEALS_SCHEMA = T.StructType(
    [
        T.StructField("meal_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("dish", T.StringType()),
        T.StructField("time", T.LongType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("customization", T.StringType()),
        T.StructField("season_id", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("is_deleted", T.StringType()),
    ]
)
