"""The analytical tables as a stand-in for health exports."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.config import GOOD, HEALTH_METRICS, Rules, Settings
from vitaframe.schemas import RECORD_COLUMNS
from vitaframe.session import tune

# Which event type stands for which metric. Oxygen saturation has
# none, so that an absent metric occurs.
EVENT_METRICS = {
    "click": "steps",
    "view": "hr",
    "purchase": "bp",
    "signup": "sleep",
    "error": "temp",
}
# Users that make up one participant. The number of participants grows with the
# number of users, while each keeps enough readings a day to correlate.
USERS_PER_PARTICIPANT = 8
# Readings whose id is a multiple of this occur a second time.
REPEAT_EVERY = 10

# Event values lie between 0 and a few hundred for every type, so ranges and
# cut points are set on that scale.
EVENT_SETTINGS = Settings(
    metrics={
        name: replace(cfg, low=1.0, high=250.0, low_2=1.0 if name == "bp" else None,
                      high_2=250.0 if name == "bp" else None)
        for name, cfg in HEALTH_METRICS.items()
    },
    rules=Rules(
        bp_bands=(60.0, 70.0, 80.0),
        hr_bands=(45.0, 52.0),
        spo2_bands=(60.0, 40.0),
        temp_bands=(45.0, 52.0),
        sleep_bands=(45.0, 52.0),
        steps_bands=(52.0, 48.0, 44.0),
        bp_attention=66.0,
        hr_attention=48.0,
        steps_attention=48.0,
        sleep_attention=48.0,
        spo2_attention=50.0,
        steps_goal=50.0,
        anomaly_share=3.0,
        cohort_bp_high=100.0,
        cohort_steps_goal=100.0,
        cohort_hr=(40.0, 45.0),
        cohort_sleep=(50.0, 60.0),
    ),
    deviation_limits={
        "bp": (30.0, 90.0),
        "hr": (20.0, 80.0),
        "temp": (20.0, 80.0),
        "spo2": (20.0, 80.0),
        "sleep": (20.0, 80.0),
        "steps": (50.0, 300.0),
    },
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def event_records(spark: SparkSession, sf_dir: str, with_repeats: bool = True) -> DataFrame:
    """The events table as health records."""
    tune(spark)
    events = read_table(spark, sf_dir, "events")
    metric = F.lit(None).cast("string")
    for event_type, name in EVENT_METRICS.items():
        metric = F.when(F.col("event_type") == event_type, F.lit(name)).otherwise(metric)
    at = F.col("ts").cast("timestamp")
    records = events.select(
        F.concat(
            F.lit("participant-"),
            F.floor(F.col("user_id") / USERS_PER_PARTICIPANT).cast("string"),
        ).alias("participant_id"),
        metric.alias("metric_type"),
        at.alias("datetime"),
        F.unix_micros(at).alias("epoch_raw"),
        F.col("value").alias("value_1"),
        F.get_json_object("props", "$.k").cast("double").alias("value_2"),
        F.lit("").alias("unit"),
        F.create_map(
            F.lit("event_type"), F.col("event_type"), F.lit("props"), F.col("props")
        ).alias("metadata"),
        F.lit(GOOD).alias("quality_flag"),
        F.lit("events").alias("source_file"),
        F.col("event_id").alias("row_pos"),
    ).select(RECORD_COLUMNS)
    if not with_repeats:
        return records
    # A re-sent export: the same readings at the odd positions in between.
    copies = F.when(
        F.col("row_pos") % REPEAT_EVERY == 0,
        F.array(F.lit(0).cast("long"), F.lit(1).cast("long")),
    ).otherwise(F.array(F.lit(0).cast("long")))
    return (
        records.withColumn("_offset", F.explode(copies))
        .withColumn("row_pos", 2 * F.col("row_pos") + F.col("_offset"))
        .select(RECORD_COLUMNS)
    )


def event_meals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as meals: participant, dish, time in milliseconds and date."""
    tune(spark)
    at = F.col("ts").cast("timestamp")
    return (
        read_table(spark, sf_dir, "events")
        .where("event_type = 'purchase'")
        .select(
            F.col("event_id").cast("string").alias("meal_id"),
            F.concat(
                F.lit("participant-"),
                F.floor(F.col("user_id") / USERS_PER_PARTICIPANT).cast("string"),
            ).alias("participant_id"),
            F.concat(F.lit("dish-"), F.get_json_object("props", "$.k")).alias("dish"),
            F.unix_millis(at).alias("time"),
        )
        .withColumn("date", F.to_date(F.timestamp_millis("time")))
    )
