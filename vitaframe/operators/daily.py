"""One value per participant, day and metric."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaframe.config import DAILY_NAMES, GOOD, METRICS

BY_PARTICIPANT = ("participant_id",)
# Decimals kept of a daily value. Days with equal readings must tie when they
# are ranked, in whatever order the readings were added up.
DECIMALS = 9


def daily_values(
    cleaned: DataFrame, by: Sequence[str] = BY_PARTICIPANT, steps_agg: str = "sum"
) -> DataFrame:
    """Daily value of each metric from good readings, one row per day and metric.

    Readings are combined before the shuffle, so a participant with very many
    readings costs no more there than one with few.
    """
    return (
        cleaned.where(F.col("quality_flag") == GOOD)
        .groupBy(*by, F.to_date("datetime").alias("date"), "metric_type")
        .agg(
            F.sum("value_1").alias("_sum"),
            F.avg("value_1").alias("_mean"),
            F.count(F.lit(1)).alias("readings"),
        )
        .select(
            *by,
            "date",
            "metric_type",
            F.round(
                F.when(F.col("metric_type") == "steps", F.col("_sum")).otherwise(F.col("_mean"))
                if steps_agg == "sum"
                else F.col("_mean"),
                DECIMALS,
            ).alias("value"),
            "readings",
        )
    )


def daily_values_of_long(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same daily values from a table of date, metric_type and value."""
    return (
        df.groupBy(*by, F.to_date("date").alias("date"), "metric_type")
        .agg(F.sum("value").alias("_sum"), F.avg("value").alias("_mean"))
        .select(
            *by,
            "date",
            "metric_type",
            F.round(
                F.when(F.col("metric_type") == "steps", F.col("_sum")).otherwise(F.col("_mean")),
                DECIMALS,
            ).alias("value"),
        )
    )


def daily_wide(cleaned: DataFrame, by: Sequence[str] = BY_PARTICIPANT) -> DataFrame:
    """One row per day with one column per metric, null where not measured."""
    value = F.col("value_1")
    metric = F.col("metric_type")
    columns = []
    for name in METRICS:
        own = F.when(metric == name, value)
        value_of_day = F.sum(own) if name == "steps" else F.avg(own)
        columns.append(F.round(value_of_day, DECIMALS).alias(name))
    return (
        cleaned.where(F.col("quality_flag") == GOOD)
        .groupBy(*by, F.to_date("datetime").alias("date"))
        .agg(*columns)
    )


def unpivot_daily(wide: DataFrame, by: Sequence[str] = BY_PARTICIPANT) -> DataFrame:
    """Back to one row per day and measured metric."""
    return wide.unpivot([*by, "date"], METRICS, "metric_type", "value").where("value is not null")


def daily_named_means(records: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Daily means under their report names, blood pressure split in two.

    Uses every reading whatever its flag and averages steps like the others.
    """
    metric = F.col("metric_type")
    name = F.when(metric == "bp", F.lit("systolic"))
    for source, target in DAILY_NAMES.items():
        name = name.when(metric == source, F.lit(target))
    first = F.struct(name.alias("metric"), F.col("value_1").alias("v"))
    second = F.struct(
        F.when(metric == "bp", F.lit("diastolic")).alias("metric"), F.col("value_2").alias("v")
    )
    return (
        records.select(
            *by, F.to_date("datetime").alias("date"), F.inline(F.array(first, second))
        )
        .where("metric is not null and v is not null")
        .groupBy(*by, "date", "metric")
        .agg(F.avg("v").alias("value"))
    )


def named_means_of_wide(wide: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same daily means from a table that already has the named columns."""
    wanted = ["steps", "sleep_duration", "resting_hr", "systolic", "diastolic", "spo2", "temperature"]
    names = [n for n in wanted if n in wide.columns]
    return (
        wide.groupBy(*by, "date")
        .agg(*[F.avg(n).alias(n) for n in names])
        .unpivot([*by, "date"], names, "metric", "value")
        .where("value is not null")
    )
