"""Expected against actual readings, per participant, day and cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.config import DEFAULTS, GOOD, METRICS, Settings, per_metric
from vitaframe.functions.scalar import round_even


def _day_counts(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy(
        "participant_id", "metric_type", F.to_date("datetime").alias("date")
    ).agg(
        F.count(F.lit(1)).alias("actual"),
        F.count_if(F.col("quality_flag") == GOOD).alias("good"),
    )


def participant_spans(cleaned: DataFrame) -> DataFrame:
    """First and last day of each participant, whatever the flags."""
    return (
        cleaned.groupBy("participant_id")
        .agg(
            F.to_date(F.min("datetime")).alias("start"), F.to_date(F.max("datetime")).alias("end")
        )
        .withColumn("total_days", F.datediff("end", "start") + 1)
    )


def _score(good: Column, expected: Column) -> Column:
    return F.least(good / expected * 100.0, F.lit(100.0))


def metric_compliance(cleaned: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Missingness and compliance of all six metrics for every participant.

    A metric without readings misses everything. Ratios are rounded half to
    even (3 and 1 decimals), as all later scores build on the rounded ones.
    """
    kinds = [
        F.struct(
            F.lit(m).alias("metric_type"),
            F.lit(settings.metrics[m].expected_per_day).alias("per_day"),
            F.count_if(F.col("metric_type") == m).alias("actual_records"),
            F.count_if((F.col("metric_type") == m) & (F.col("quality_flag") == GOOD)).alias(
                "good_records"
            ),
        )
        for m in METRICS
    ]
    rows = cleaned.groupBy("participant_id").agg(
        (F.datediff(F.to_date(F.max("datetime")), F.to_date(F.min("datetime"))) + 1).alias(
            "total_days"
        ),
        F.array(*kinds).alias("kinds"),
    )
    expected = F.col("expected_records").cast("double")
    ratio = (expected - F.col("actual_records")) / expected
    return (
        rows.select("participant_id", "total_days", F.inline("kinds"))
        .withColumn("expected_records", (F.col("total_days") * F.col("per_day")).cast("long"))
        .select(
            "participant_id",
            "metric_type",
            "total_days",
            "expected_records",
            "actual_records",
            "good_records",
            round_even(F.greatest(ratio, F.lit(0.0)), 3).alias("missingness_ratio"),
            round_even(_score(F.col("good_records"), expected), 1).alias("compliance_score"),
        )
    )


def daily_compliance(cleaned: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Compliance of every calendar day of a participant's span, per metric present."""
    counts = _day_counts(cleaned)
    # Spans and present metrics come from the daily counts, not from the readings.
    span = counts.groupBy("participant_id").agg(
        F.min("date").alias("start"),
        F.max("date").alias("end"),
        F.collect_set("metric_type").alias("present"),
    )
    calendar = span.select(
        "participant_id",
        F.explode("present").alias("metric_type"),
        F.sequence("start", "end", F.expr("interval 1 day")).alias("days"),
    ).select("participant_id", "metric_type", F.explode("days").alias("date"))
    per_day = per_metric(settings, "expected_per_day")
    return (
        calendar.join(counts, ["participant_id", "metric_type", "date"], "left")
        .select(
            "participant_id",
            "metric_type",
            "date",
            per_day.alias("expected"),
            F.coalesce("actual", F.lit(0)).alias("actual"),
            F.coalesce("good", F.lit(0)).alias("good"),
        )
        .withColumn(
            "compliance_percentage",
            round_even(_score(F.col("good"), F.col("expected").cast("double")), 1),
        )
    )


def daily_compliance_summary(daily: DataFrame) -> DataFrame:
    """Mean, median, extremes and spread of the daily percentages.

    A group holds one row per calendar day, so its exact median is cheap.
    """
    v = F.col("compliance_percentage")
    return daily.groupBy("participant_id", "metric_type").agg(
        F.avg(v).alias("mean_compliance"),
        F.percentile(v, F.lit(0.5)).alias("median_compliance"),
        F.min(v).alias("min_compliance"),
        F.max(v).alias("max_compliance"),
        F.stddev_pop(v).alias("std_compliance"),
    )


def compliance_grade(score: Column) -> Column:
    return (
        F.when(score >= 90, F.lit("A"))
        .when(score >= 80, F.lit("B"))
        .when(score >= 70, F.lit("C"))
        .when(score >= 60, F.lit("D"))
        .otherwise(F.lit("F"))
    )


def overall_compliance(per_metric_scores: DataFrame) -> DataFrame:
    """Mean of a participant's six metric scores, with a grade.

    Added up in whole tenths, so that a mean halfway between two tenths does
    not hang on the order of the sum.
    """
    tenths = F.col("_tenths")
    return (
        per_metric_scores.groupBy("participant_id")
        .agg(F.sum(F.rint(F.col("compliance_score") * 10.0)).alias("_tenths"))
        .select(
            "participant_id",
            (F.rint(tenths / float(len(METRICS))) / 10.0).alias("score"),
            compliance_grade(tenths / (10.0 * len(METRICS))).alias("grade"),
        )
    )


def cohort_compliance(per_metric_scores: DataFrame) -> DataFrame:
    """Distribution over participants, overall and per metric.

    Scores have one decimal between 0 and 100, so a group has at most 1001
    distinct values and its exact quantiles stay small.
    """
    overall = overall_compliance(per_metric_scores).select(
        F.lit("overall").alias("scope"), F.col("score").alias("v")
    )
    each = per_metric_scores.select(
        F.col("metric_type").alias("scope"), F.col("compliance_score").alias("v")
    )
    return (
        overall.unionByName(each)
        .groupBy("scope")
        .agg(
            F.count(F.lit(1)).alias("participants"),
            F.avg("v").alias("mean"),
            F.stddev_pop("v").alias("std"),
            F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        )
        .select(
            "scope",
            "participants",
            "mean",
            F.col("_q")[1].alias("median"),
            "std",
            F.col("_q")[0].alias("q25"),
            F.col("_q")[2].alias("q75"),
        )
    )
