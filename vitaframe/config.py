"""Fixed values of the health domain and the small tables made from them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The six metrics, in canonical order.
METRICS = ["bp", "sleep", "steps", "hr", "spo2", "temp"]

# The quality flags.
GOOD = "good"
OUTLIER = "outlier"
MISSING = "missing"
INVALID = "invalid"
DUPLICATE = "duplicate"
INTERPOLATED = "interpolated"
FLAGS = [GOOD, OUTLIER, MISSING, INVALID, DUPLICATE, INTERPOLATED]

# The ordered metric pairs that are correlated.
CORRELATION_PAIRS = [
    ("steps", "sleep"),
    ("steps", "hr"),
    ("steps", "bp"),
    ("steps", "temp"),
    ("steps", "spo2"),
    ("sleep", "hr"),
    ("sleep", "temp"),
    ("sleep", "spo2"),
    ("sleep", "bp"),
    ("hr", "temp"),
    ("hr", "bp"),
    ("hr", "spo2"),
    ("temp", "spo2"),
    ("temp", "bp"),
    ("spo2", "bp"),
]

# Display names and the names used by daily deviations.
METRIC_TITLES = {
    "bp": "Blood Pressure",
    "sleep": "Sleep Quality",
    "steps": "Step Count",
    "hr": "Heart Rate",
    "spo2": "Blood Oxygen",
    "temp": "Temperature",
}
OVERVIEW_TITLES = {
    "steps": ("Steps", "avg/day"),
    "hr": ("Heart Rate", "avg bpm"),
    "sleep": ("Sleep", "avg hours"),
    "bp": ("Blood Pressure", "avg mmHg"),
    "spo2": ("SpO2", "avg %"),
    "temp": ("Temperature", "avg °F"),
}
DAILY_NAMES = {
    "steps": "steps",
    "sleep": "sleep_duration",
    "hr": "resting_hr",
    "temp": "temperature",
    "spo2": "spo2",
}
PRIORITY_RANKS = {"High": 3, "Medium": 2, "Low": 1}


@dataclass(frozen=True)
class MetricConfig:
    """Cleaning and compliance settings of one metric."""

    low: float
    high: float
    z_threshold: float
    iqr_factor: float
    expected_per_day: int
    unit: str
    low_2: float | None = None
    high_2: float | None = None


# Primary range, z-score limit, fence factor, readings per day,
# unit, and for blood pressure the range of the secondary value.
HEALTH_METRICS = {
    "bp": MetricConfig(80.0, 200.0, 3.0, 2.5, 2, "mmHg", 50.0, 130.0),
    "sleep": MetricConfig(0.0, 24.0, 2.5, 2.0, 1, "hours"),
    "steps": MetricConfig(0.0, 50000.0, 3.0, 3.0, 1, "steps"),
    "hr": MetricConfig(30.0, 220.0, 2.5, 2.0, 24, "bpm"),
    "spo2": MetricConfig(80.0, 100.0, 2.0, 1.5, 8, "%"),
    "temp": MetricConfig(90.0, 105.0, 2.0, 1.5, 12, "°F"),
}


@dataclass(frozen=True)
class Rules:
    """Cut points of the bands, findings and recommendations."""

    # Clinical cut points.
    bp_bands: tuple[float, float, float] = (120.0, 130.0, 140.0)
    hr_bands: tuple[float, float] = (60.0, 100.0)
    spo2_bands: tuple[float, float] = (95.0, 90.0)
    temp_bands: tuple[float, float] = (97.0, 99.0)
    sleep_bands: tuple[float, float] = (7.0, 9.0)
    steps_bands: tuple[float, float, float] = (10000.0, 7500.0, 5000.0)
    bp_attention: float = 130.0
    hr_attention: float = 100.0
    steps_attention: float = 5000.0
    sleep_attention: float = 7.0
    spo2_attention: float = 95.0
    steps_goal: float = 7500.0
    anomaly_share: float = 10.0
    cohort_bp_high: float = 140.0
    cohort_steps_goal: float = 10000.0
    cohort_hr: tuple[float, float] = (60.0, 100.0)
    cohort_sleep: tuple[float, float] = (7.0, 9.0)


# Low and high limits of the threshold deviations.
DEVIATION_LIMITS = {
    "bp": (90.0, 140.0),
    "hr": (60.0, 100.0),
    "temp": (97.0, 99.5),
    "spo2": (95.0, 100.0),
    "sleep": (6.0, 9.0),
    "steps": (5000.0, 15000.0),
}
# The limits as first published, whose blood-pressure names match
# no metric and whose temperature limits are in Celsius.
PARITY_DEVIATION_LIMITS = {
    "bp_systolic": (90.0, 140.0),
    "bp_diastolic": (60.0, 90.0),
    "hr": (60.0, 100.0),
    "temp": (36.1, 37.5),
    "spo2": (95.0, 100.0),
    "sleep": (6.0, 9.0),
    "steps": (5000.0, 15000.0),
}


@dataclass(frozen=True)
class Settings:
    """Everything an analysis can be tuned with."""

    metrics: dict[str, MetricConfig] = field(default_factory=lambda: dict(HEALTH_METRICS))
    rules: Rules = Rules()
    deviation_limits: dict[str, tuple[float, float]] = field(
        default_factory=lambda: dict(DEVIATION_LIMITS)
    )
    min_days: int = 7
    rolling_window: int = 14


DEFAULTS = Settings()


def metric_dimension(spark: SparkSession, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per metric; six rows, so joins may broadcast it."""
    rows = [
        F.struct(
            F.lit(name).alias("metric_type"),
            F.lit(position).alias("metric_order"),
            F.lit(cfg.low).cast("double").alias("low"),
            F.lit(cfg.high).cast("double").alias("high"),
            F.lit(cfg.low_2).cast("double").alias("low_2"),
            F.lit(cfg.high_2).cast("double").alias("high_2"),
            F.lit(cfg.z_threshold).cast("double").alias("z_threshold"),
            F.lit(cfg.iqr_factor).cast("double").alias("iqr_factor"),
            F.lit(cfg.expected_per_day).cast("int").alias("expected_per_day"),
            F.lit(cfg.unit).alias("unit"),
        )
        for position, (name, cfg) in enumerate(settings.metrics.items())
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def per_metric(settings: Settings, attribute: str) -> Column:
    """One setting of the row's metric, looked up by ``metric_type``."""
    cases = " ".join(
        f"WHEN '{name}' THEN {getattr(cfg, attribute)!r}"
        + ("D" if isinstance(getattr(cfg, attribute), float) else "")
        for name, cfg in settings.metrics.items()
    )
    return F.expr(f"CASE metric_type {cases} END")
