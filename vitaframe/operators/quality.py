"""Data-quality reports and file availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.config import FLAGS, GOOD, METRICS
from vitaframe.operators.cleaning import flag_counts
from vitaframe.session import stage_table
from vitaframe.sources.files import file_date_range


def _good_share() -> Column:
    return F.col(GOOD) / F.col("total_records") * 100.0


def _per_group(cleaned: DataFrame) -> DataFrame:
    """Rows and flag counts per participant and metric: what all totals are sums of."""
    return cleaned.groupBy("participant_id", "metric_type").agg(
        F.count(F.lit(1)).alias("total_records"), *flag_counts(cleaned)
    )


def _summed(per_group: DataFrame) -> list[Column]:
    return [F.sum(c).alias(c) for c in per_group.columns[2:]]


def _overall(per_group: DataFrame) -> DataFrame:
    first, *flags = _summed(per_group)
    return (
        per_group.agg(
            first,
            F.countDistinct("participant_id").alias("total_participants"),
            F.countDistinct("metric_type").alias("total_metrics"),
            *flags,
        )
        .where("total_records > 0")
        .withColumn("good_data_percentage", _good_share())
    )


def _by(per_group: DataFrame, key: str, others: str) -> DataFrame:
    return (
        per_group.groupBy(key)
        .agg(*_summed(per_group), F.count(F.lit(1)).alias(others))
        .withColumn("good_data_percentage", _good_share())
    )


def overall_quality(cleaned: DataFrame) -> DataFrame:
    """Totals, flag counts and share of good rows of the whole table.

    Counted per participant and metric first, so that the distinct counts run
    over a small table.
    """
    return _overall(_per_group(cleaned))


def participant_quality(cleaned: DataFrame) -> DataFrame:
    """Flag counts, share of good rows and number of metrics per participant."""
    return _by(_per_group(cleaned), "participant_id", "metrics_available")


def metric_quality(cleaned: DataFrame) -> DataFrame:
    """Flag counts, share of good rows and number of participants per metric."""
    return _by(_per_group(cleaned), "metric_type", "participants_with_data")


def flag_distribution(cleaned: DataFrame) -> DataFrame:
    """Rows per metric and flag."""
    return cleaned.groupBy("metric_type", "quality_flag").agg(F.count(F.lit(1)).alias("records"))


def daily_quality(cleaned: DataFrame) -> DataFrame:
    """All rows and good rows per calendar day."""
    return cleaned.groupBy(F.to_date("datetime").alias("date")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("quality_flag") == GOOD).alias("good"),
    )


def date_range(cleaned: DataFrame) -> DataFrame:
    """First and last day with data and the days between, both included."""
    return (
        cleaned.agg(
            F.to_date(F.min("datetime")).alias("start"), F.to_date(F.max("datetime")).alias("end")
        )
        .where("start is not null")
        .withColumn("days", F.datediff("end", "start") + 1)
    )


def quality_reports(cleaned: DataFrame) -> dict[str, DataFrame]:
    """Every quality report of a cleaned table, from one pass over it.

    The pass counts rows per participant, metric, flag and day; that table is staged,
    and each report adds its rows up.
    """
    day = F.to_date("datetime").alias("date")
    counted = stage_table(
        cleaned.groupBy("participant_id", "metric_type", "quality_flag", day).agg(
            F.count(F.lit(1)).alias("records")
        ),
        "quality-counts",
    )
    flag = F.col("quality_flag")

    def of(name: str) -> Column:
        return F.sum(F.when(flag == name, F.col("records")).otherwise(0))

    per_group = counted.groupBy("participant_id", "metric_type").agg(
        F.sum("records").alias("total_records"), *[of(name).alias(name) for name in FLAGS]
    )
    return {
        "overall_stats": _overall(per_group),
        "participant_stats": _by(per_group, "participant_id", "metrics_available"),
        "metric_stats": _by(per_group, "metric_type", "participants_with_data"),
        "temporal_range": counted.agg(F.min("date").alias("start"), F.max("date").alias("end"))
        .where("start is not null")
        .withColumn("days", F.datediff("end", "start") + 1),
        "temporal_stats": counted.groupBy("date").agg(
            F.sum("records").alias("total"), of(GOOD).alias("good")
        ),
        "quality_flags_distribution": counted.groupBy("metric_type", "quality_flag").agg(
            F.sum("records").alias("records")
        ),
    }


def quality_summary(cleaned: DataFrame) -> DataFrame:
    """Overall, per participant, per metric and per flag counts in one pass.

    Rows of the four levels are told apart by ``level``; keys that do not apply
    are null.
    """
    counted = cleaned.groupBy("participant_id", "metric_type", "quality_flag").agg(
        F.count(F.lit(1)).alias("n")
    )
    p, m, f = F.col("participant_id"), F.col("metric_type"), F.col("quality_flag")
    grouping = F.grouping_id()
    return (
        counted.groupingSets([(), (p,), (m,), (m, f)], p, m, f)
        .agg(
            grouping.alias("_gid"),
            F.sum("n").alias("records"),
            F.sum(F.when(f == GOOD, F.col("n")).otherwise(0)).alias("good_records"),
        )
        .select(
            F.when(F.col("_gid") == 7, F.lit("overall"))
            .when(F.col("_gid") == 3, F.lit("participant"))
            .when(F.col("_gid") == 5, F.lit("metric"))
            .otherwise(F.lit("flag"))
            .alias("level"),
            "participant_id",
            "metric_type",
            "quality_flag",
            "records",
            "good_records",
        )
    )


def participant_files(files: DataFrame) -> DataFrame:
    """Files per metric, which metrics have files and all files, per participant."""
    counts = [
        F.count_if(F.col("metric_type") == m).alias(f"{m}_count") for m in METRICS
    ]
    per = files.groupBy("participant_id").agg(*counts, F.count(F.lit(1)).alias("total_files"))
    return per.select(
        "participant_id",
        *[(F.col(f"{m}_count") > 0).alias(f"has_{m}") for m in METRICS],
        *[f"{m}_count" for m in METRICS],
        "total_files",
    )


def file_count_histogram(summary: DataFrame) -> DataFrame:
    """Participants per number of files."""
    return summary.groupBy("total_files").agg(F.count(F.lit(1)).alias("participants"))


def metric_availability(summary: DataFrame) -> DataFrame:
    """Participants with files, per metric, all six metrics listed."""
    wide = summary.agg(
        *[F.coalesce(F.sum(F.col(f"has_{m}").cast("int")), F.lit(0)).alias(m) for m in METRICS]
    )
    return wide.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric_type"), F.col(m).alias("participants"))
                    for m in METRICS
                ]
            )
        )
    )


def loading_summary(files: DataFrame) -> dict[str, DataFrame]:
    """What was found on disk: totals, histogram and availability."""
    summary = participant_files(files)
    return {
        "discovery_summary": summary,
        "participants_by_file_count": file_count_histogram(summary),
        "metric_availability": metric_availability(summary),
        "date_range": file_date_range(files),
    }
