"""Fixed values, written out once more: queries and their SQL both take them from the library."""

from vitaframe import config, schemas, texts
from vitaframe.operators import anomalies, cleaning, correlation, deviations, noise
from vitaframe.sources import standardize


def test_metrics_and_pairs():
    assert config.METRICS == ["bp", "sleep", "steps", "hr", "spo2", "temp"]
    assert config.FLAGS == ["good", "outlier", "missing", "invalid", "duplicate", "interpolated"]
    assert [f"{a}-{b}" for a, b in config.CORRELATION_PAIRS] == (
        "steps-sleep steps-hr steps-bp steps-temp steps-spo2 sleep-hr sleep-temp sleep-spo2 sleep-bp "
        "hr-temp hr-bp hr-spo2 temp-spo2 temp-bp spo2-bp"
    ).split()


def test_settings_of_metrics():
    shown = {
        m: (c.low, c.high, c.z_threshold, c.iqr_factor, c.expected_per_day, c.unit, c.low_2, c.high_2)
        for m, c in config.HEALTH_METRICS.items()
    }
    assert shown == {
        "bp": (80, 200, 3, 2.5, 2, "mmHg", 50, 130),
        "sleep": (0, 24, 2.5, 2, 1, "hours", None, None),
        "steps": (0, 50000, 3, 3, 1, "steps", None, None),
        "hr": (30, 220, 2.5, 2, 24, "bpm", None, None),
        "spo2": (80, 100, 2, 1.5, 8, "%", None, None),
        "temp": (90, 105, 2, 1.5, 12, "°F", None, None),
    }
    assert config.DEVIATION_LIMITS == {
        "bp": (90, 140), "hr": (60, 100), "temp": (97, 99.5), "spo2": (95, 100), "sleep": (6, 9), "steps": (5000, 15000),
    }
    assert (config.DEFAULTS.min_days, config.DEFAULTS.rolling_window) == (7, 14)


def test_cut_points():
    r = config.Rules()
    assert (r.bp_bands, r.hr_bands, r.spo2_bands) == ((120, 130, 140), (60, 100), (95, 90))
    assert (r.temp_bands, r.sleep_bands, r.steps_bands) == ((97, 99), (7, 9), (10000, 7500, 5000))
    assert (r.bp_attention, r.hr_attention, r.steps_attention, r.sleep_attention, r.spo2_attention) == (130, 100, 5000, 7, 95)
    assert (r.steps_goal, r.anomaly_share, r.cohort_bp_high, r.cohort_steps_goal) == (7500, 10, 140, 10000)
    assert cleaning.MIN_FOR_OUTLIERS == 5 and noise.CLUSTER_HOURS == 24 and noise.CLUSTER_SHARE == 0.3
    assert (deviations.MIN_DAYS, deviations.Z_LIMIT, deviations.MIN_THRESHOLD_DAYS) == (3, 1.5, 7)
    assert (deviations.PERCENT_LIMIT, deviations.SEVERE_PERCENT, deviations.NO_MEALS) == (10, 20, "No meals recorded")
    assert (correlation.MIN_PAIRS, correlation.SIGNIFICANT) == (5, 0.05) and anomalies.KEYS == ["participant_id", "metric_type"]


def test_export_columns():
    assert schemas.EXPORT_COLUMNS["bp"]["datetime"] == ["createdTime", "logDate", "logDateTime"]
    assert schemas.EXPORT_COLUMNS["hr"]["value"] == ["averageSessionHeartRate", "lastRate", "heartRate"]
    assert standardize.candidates("spo2", "value", "corrected") == ["spo2", "oxygen_saturation", "value", "spo2Value"]
    assert standardize.candidates("spo2", "value", "parity") == ["spo2", "oxygen_saturation", "value"]
    assert schemas.FILE_PATTERNS == {
        "bp": "bp_*.csv", "sleep": "sleep_*.csv", "steps": "steps_*.csv",
        "hr": "heartrate_*.json", "spo2": "spo2_*.json", "temp": "temperature_*.json",
    }


def test_every_sentence_has_its_gaps():
    gaps = {name: text.count("{}") for name, text in (texts.FINDINGS | texts.BEHAVIOUR | texts.COHORT | texts.RELATIONS).items()}
    assert gaps["bp_high"] == 1 and gaps["strong_relationship"] == 4 and gaps["steps_weekdays"] == 4
    assert gaps["cohort_size"] == 2 and gaps["next_day"] == 4 and gaps["no_same_day"] == 0
