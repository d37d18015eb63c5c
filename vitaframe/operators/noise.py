"""Noise per metric and clustering of outliers in time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaframe.config import GOOD, OUTLIER
from vitaframe.functions.order_stats import band_edges, previous_values, value_positions

BY_METRIC = ("metric_type",)
CLUSTER_HOURS = 24.0
CLUSTER_SHARE = 0.3


def metric_noise(cleaned: DataFrame) -> DataFrame:
    """Share of outliers, and spread of good and outlying values, per metric."""
    v, flag = F.col("value_1"), F.col("quality_flag")
    good, out = F.when(flag == GOOD, v), F.when(flag == OUTLIER, v)
    return (
        cleaned.groupBy("metric_type")
        .agg(
            F.count(F.lit(1)).alias("total_records"),
            F.count_if(flag == GOOD).alias("good_records"),
            F.count_if(flag == OUTLIER).alias("outlier_records"),
            F.avg(good).alias("good_mean"),
            F.stddev_pop(good).alias("good_std"),
            (F.max(good) - F.min(good)).alias("good_range"),
            F.avg(out).alias("outlier_mean"),
            F.stddev_pop(out).alias("outlier_std"),
            (F.max(out) - F.min(out)).alias("outlier_range"),
        )
        .withColumn("noise_ratio", F.col("outlier_records") / F.col("total_records"))
        .withColumn(
            "good_cv",
            F.when(F.col("good_mean") == 0, F.lit(0.0)).otherwise(
                F.try_divide("good_std", "good_mean")
            ),
        )
    )


def _outlier_moments(cleaned: DataFrame, keys: list[str]) -> DataFrame:
    """The instants with outliers, and how many each has."""
    present = " AND ".join(f"{c} IS NOT NULL" for c in [*keys, "datetime"])
    return (
        cleaned.where((F.col("quality_flag") == OUTLIER) & F.expr(present))
        .groupBy(*keys, F.col("datetime").alias("at"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("_micros", F.unix_micros("at"))
    )


def _gaps(moments: DataFrame, keys: list[str], edges: DataFrame | None) -> DataFrame:
    gaps = previous_values(moments, keys, "_micros", edges).withColumn(
        "_gap", (F.col("_micros") - F.col("previous")) / F.lit(3.6e9)
    )
    # Each further outlier at one instant is 0 hours after the one before it.
    return (
        gaps.select(
            *keys,
            "at",
            F.inline(
                F.array(
                    F.struct(
                        F.col("_gap").alias("gap_hours"), F.lit(1).cast("long").alias("times")
                    ),
                    F.struct(
                        F.lit(0.0).alias("gap_hours"), (F.col("copies") - 1).alias("times")
                    ),
                )
            ),
        )
        .where("gap_hours is not null and times > 0")
    )


def outlier_gaps(cleaned: DataFrame, by: Sequence[str] = BY_METRIC) -> DataFrame:
    """Hours from each outlier to the one before it, with how often a gap occurs.

    Outliers at the same instant are counted together first. A metric with very many
    outliers is cut into ranges of time where they lie, so that its history is never
    sorted in one place; each range takes the last outlier before it.
    """
    keys = list(by)
    moments = _outlier_moments(cleaned, keys)
    return _gaps(moments, keys, band_edges(moments, keys, "_micros"))


def outlier_clustering(cleaned: DataFrame, by: Sequence[str] = BY_METRIC) -> DataFrame:
    """Whether outliers come in clusters: many gaps of at most a day.

    Groups with a single outlier are listed as not clustered.
    """
    keys = list(by)
    moments = _outlier_moments(cleaned, keys)
    edges = band_edges(moments, keys, "_micros")
    counts = (
        cleaned.where(F.col("quality_flag") == OUTLIER)
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("outliers"))
    )
    gap, times, total = F.col("gap_hours"), F.col("copies"), F.max("total")

    def at_rank(rank: str):
        """The gap at a place, counted from 0, of all gaps in order."""
        here = f"{rank} >= start AND {rank} < start + copies"
        return F.expr(f"max(CASE WHEN {here} THEN gap_hours END)")

    middle = (at_rank("floor((total - 1) / 2)") + at_rank("ceil((total - 1) / 2)")) / 2.0
    spread = (
        # A group has no more gaps than instants.
        value_positions(_gaps(moments, keys, edges), keys, "gap_hours", "times", whole=edges is None)
        .groupBy(*keys)
        .agg(
            (F.sum(F.when(gap <= CLUSTER_HOURS, times).otherwise(0)) / total).alias(
                "clustering_ratio"
            ),
            (F.sum(gap * times) / total).alias("mean_gap_hours"),
            middle.alias("median_gap_hours"),
        )
    )
    return counts.join(spread, keys, "left").withColumn(
        "clustering_detected",
        F.coalesce(F.col("clustering_ratio") > CLUSTER_SHARE, F.lit(False)),
    )
