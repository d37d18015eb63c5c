"""Personal baselines, hour and weekday patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaframe.config import DEFAULTS, METRICS, Settings
from vitaframe.functions.order_stats import group_summary
from vitaframe.functions.scalar import round_even, weekday
from vitaframe.operators.statistics import good_rows

MIN_READINGS = 3
MIN_PATTERN_READINGS = 2
BASELINE_QUANTILES = {"lower": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "upper": 0.9}


def interpret_mean(metric: Column, mean: Column, settings: Settings = DEFAULTS) -> Column:
    """The clinical band of a mean, by metric."""
    r = settings.rules
    # Band texts.
    bands = {
        "bp": F.when(mean < r.bp_bands[0], "Normal blood pressure range")
        .when(mean < r.bp_bands[1], "Elevated blood pressure")
        .when(mean < r.bp_bands[2], "Stage 1 hypertension range")
        .otherwise("Stage 2 hypertension range"),
        "hr": F.when(mean < r.hr_bands[0], "Below normal resting heart rate (bradycardia)")
        .when(mean < r.hr_bands[1], "Normal resting heart rate")
        .otherwise("Elevated resting heart rate (tachycardia)"),
        "spo2": F.when(mean >= r.spo2_bands[0], "Normal oxygen saturation")
        .when(mean >= r.spo2_bands[1], "Borderline oxygen saturation")
        .otherwise("Low oxygen saturation"),
        "temp": F.when(mean.between(*r.temp_bands), "Normal body temperature")
        .when(mean > r.temp_bands[1], "Slightly elevated temperature")
        .otherwise("Slightly low temperature"),
        "sleep": F.when(mean.between(*r.sleep_bands), "Optimal sleep duration")
        .when(mean < r.sleep_bands[0], "Below recommended sleep duration")
        .otherwise("Above typical sleep duration"),
        "steps": F.when(mean >= r.steps_bands[0], "Highly active lifestyle")
        .when(mean >= r.steps_bands[1], "Moderately active lifestyle")
        .when(mean >= r.steps_bands[2], "Somewhat active lifestyle")
        .otherwise("Sedentary lifestyle"),
    }
    text = F.lit("Within measured range")
    for name in reversed(METRICS):
        text = F.when(metric == name, bands[name]).otherwise(text)
    return text


def health_baselines(cleaned: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Usual values of each participant's metrics with at least three readings.

    ``series`` is ``primary`` or ``secondary``. Besides the plain figures there
    are the mean rounded to one decimal, which the rules use, and its band.
    """
    keys = ["participant_id", "metric_type"]
    series = (
        good_rows(cleaned)
        .select(
            *keys,
            F.inline(
                F.array(
                    F.struct(F.lit("primary").alias("series"), F.col("value_1").alias("v")),
                    F.struct(F.lit("secondary").alias("series"), F.col("value_2").alias("v")),
                )
            ),
        )
        .where("v is not null")
    )
    summary = group_summary(series, [*keys, "series"], "v", BASELINE_QUANTILES)
    # A metric has one or two rows here.
    readings = F.max(F.when(F.col("series") == "primary", F.col("n"))).over(W.partitionBy(*keys))
    rounded = round_even("mean", 1)
    kind = F.when(F.col("series") == "primary", F.col("metric_type")).otherwise(
        F.concat("metric_type", F.lit("_secondary"))
    )
    return (
        summary.withColumn("_readings", readings)
        .where(F.col("_readings") >= MIN_READINGS)
        .withColumnRenamed("n", "count")
        .withColumn("mean_1", rounded)
        .withColumn("interpretation", interpret_mean(kind, F.col("mean_1"), settings))
        .drop("min", "max", "_readings")
    )


def _patterned(cleaned: DataFrame, unit: str) -> DataFrame:
    """Readings and mean per participant, metric and hour or weekday."""
    part = F.hour("datetime") if unit == "hour" else weekday("datetime")
    return (
        good_rows(cleaned)
        .groupBy("participant_id", "metric_type", part.alias(unit))
        .agg(F.count("value_1").alias("readings"), F.avg("value_1").alias("mean"))
    )


def _means(cleaned: DataFrame, unit: str) -> DataFrame:
    keys = ["participant_id", "metric_type"]
    # A metric has at most 24 hours or seven weekdays here.
    everything = F.sum("readings").over(W.partitionBy(*keys))
    return (
        _patterned(cleaned, unit)
        .withColumn("_all", everything)
        .where((F.col("readings") >= MIN_PATTERN_READINGS) & (F.col("_all") >= MIN_READINGS))
        .drop("_all")
    )


def hourly_pattern(cleaned: DataFrame, parity: bool = False) -> DataFrame:
    """Hours with the highest and lowest mean; the earlier hour wins a tie.

    With ``parity`` the value of a peak or low at midnight is null.
    """
    means = _means(cleaned, "hour")
    peak = F.max(F.struct(F.col("mean"), (-F.col("hour")).alias("h")))
    low = F.min(F.struct(F.col("mean"), F.col("hour").alias("h")))
    pattern = (
        means.groupBy("participant_id", "metric_type")
        .agg(peak.alias("_peak"), low.alias("_low"))
        .select(
            "participant_id",
            "metric_type",
            (-F.col("_peak.h")).alias("peak_hour"),
            F.col("_peak.mean").alias("peak_value"),
            F.col("_low.h").alias("low_hour"),
            F.col("_low.mean").alias("low_value"),
        )
    )
    if not parity:
        return pattern
    return pattern.withColumns(
        {
            f"{end}_value": F.when(F.col(f"{end}_hour") != 0, F.col(f"{end}_value"))
            for end in ("peak", "low")
        }
    )


def weekday_pattern(cleaned: DataFrame) -> DataFrame:
    """Mean per weekday, for weekdays with at least two readings."""
    return _means(cleaned, "weekday")
