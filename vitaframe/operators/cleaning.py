"""Quality flags: duplicate, invalid, outlier and missing readings.

The rules run in that order and a reading keeps the first flag it gets, except
that a missing value always ends as ``missing``.

Flags need a reading's keys and values only. What else a record carries (its payload:
unit and metadata) stays with the records while they are compared, and is put beside
the flags by the record's place, its file and position, where it is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaframe.config import (
    DEFAULTS,
    DUPLICATE,
    FLAGS,
    GOOD,
    INVALID,
    MISSING,
    OUTLIER,
    Settings,
    metric_dimension,
    per_metric,
)
from vitaframe.functions.order_stats import group_summary
from vitaframe.session import stage_table

# A record's place is unique; copies are told apart by it.
PLACE = ["source_file", "row_pos"]
PAYLOAD = ["unit", "metadata"]
# Smallest number of good readings for which outliers are looked for.
MIN_FOR_OUTLIERS = 5


def _flag_where(records: DataFrame, test: Column, flag: str) -> DataFrame:
    """Put ``flag`` on readings that are still good and meet the test."""
    return records.withColumn(
        "quality_flag",
        F.when((F.col("quality_flag") == GOOD) & test, F.lit(flag)).otherwise(
            F.col("quality_flag")
        ),
    )


def without_payload(records: DataFrame) -> DataFrame:
    return records.drop(*PAYLOAD)


def with_payload(flagged: DataFrame, records: DataFrame) -> DataFrame:
    """Flagged readings with the unit and metadata of their records."""
    payload = records.select(*PLACE, *PAYLOAD)
    return flagged.drop(*PAYLOAD).join(payload, PLACE).select(records.columns)


def flag_duplicates(records: DataFrame) -> DataFrame:
    """Flag every copy but the first of a participant's identical readings.

    Copies agree in metric, raw time and both values; the first is the one with
    the smallest place (file, then position). A group is the copies of one reading, so
    records are shuffled and sorted once. Readings without a participant, metric or time are no copies of
    each other and stay apart.
    """
    apart = " OR ".join(f"{c} IS NULL" for c in ("participant_id", "metric_type", "epoch_raw"))
    # Times differ most and in their first bytes, so records are sorted by them first.
    copies = W.partitionBy(
        "epoch_raw",
        "participant_id",
        "metric_type",
        "value_1",
        "value_2",
        F.when(F.expr(apart), F.xxhash64(*PLACE)),
    ).orderBy(*PLACE)
    is_copy = ~F.expr(apart) & (F.rank().over(copies) > 1)
    return records.withColumn("_copy", is_copy).withColumn(
        "quality_flag", F.when(F.col("_copy"), F.lit(DUPLICATE)).otherwise(F.col("quality_flag"))
    ).select(records.columns)


def flag_out_of_range(records: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Flag values outside their metric's range.

    Blood pressure also needs its secondary value in range and below the
    primary one; a secondary value of 0 counts as not measured.
    """
    low, high = per_metric(settings, "low"), per_metric(settings, "high")
    outside = ~F.col("value_1").between(low, high)
    cfg = settings.metrics["bp"]
    measured = F.col("value_2").isNotNull() & (F.col("value_2") != 0)
    second = measured & (
        ~F.col("value_2").between(F.lit(cfg.low_2), F.lit(cfg.high_2))
        | (F.col("value_1") <= F.col("value_2"))
    )
    bad = F.coalesce(outside, F.lit(False)) | (
        (F.col("metric_type") == "bp") & F.coalesce(second, F.lit(False))
    )
    return _flag_where(records, bad, INVALID)


def outlier_limits(records: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Mean, deviation and fences of the good values per participant and metric.

    Primary and secondary values are measured in one pass, as the rows ``1``
    and ``2`` of ``which``, and put side by side at the end.
    """
    keys = ["participant_id", "metric_type"]
    series = (
        records.where(F.col("quality_flag") == GOOD)
        .selectExpr(
            *keys,
            "inline(array(named_struct('which', 1, 'v', value_1), "
            "named_struct('which', 2, 'v', value_2)))",
        )
        .where("v is not null")
    )
    limits = group_summary(series, [*keys, "which"], "v", {"q1": 0.25, "q3": 0.75}).withColumn(
        "fence", per_metric(settings, "iqr_factor") * (F.col("q3") - F.col("q1"))
    )
    columns = {
        "n": "n",
        "mean": "mean",
        "std": "std",
        "lower": "q1 - fence",
        "upper": "q3 + fence",
    }
    return limits.groupBy(keys).agg(
        *[
            F.expr(f"max(CASE WHEN which = {which} THEN {column} END) AS {name}_{which}")
            for which in (1, 2)
            for name, column in columns.items()
        ]
    )


def flag_outliers(records: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Flag good values far from their participant's other good values.

    Far means a z-score above the metric's limit or a value beyond its quartile
    fences; groups with fewer than five good readings are left alone.
    """
    keys = ["participant_id", "metric_type"]
    limits = outlier_limits(records, settings).where(F.col("n_1") >= MIN_FOR_OUTLIERS)
    # Staged: Spark sees their size, and readings stay where they are if it is small.
    limits = stage_table(limits, "outlier-limits")
    joined = records.join(limits, keys, "left")
    z_limit = per_metric(settings, "z_threshold")

    def far(which: int) -> Column:
        v = F.col(f"value_{which}")
        z = F.try_divide(F.abs(v - F.col(f"mean_{which}")), F.col(f"std_{which}"))
        beyond = (v < F.col(f"lower_{which}")) | (v > F.col(f"upper_{which}"))
        return F.coalesce(z > z_limit, F.lit(False)) | F.coalesce(beyond, F.lit(False))

    second = (F.coalesce(F.col("n_2"), F.lit(0)) >= MIN_FOR_OUTLIERS) & far(2)
    return _flag_where(joined, F.col("n_1").isNotNull() & (far(1) | second), OUTLIER).select(
        records.columns
    )


def flag_missing(records: DataFrame) -> DataFrame:
    """Flag readings without a primary value, whatever flag they had."""
    gone = F.col("value_1").isNull() | F.isnan("value_1")
    return records.withColumn(
        "quality_flag", F.when(gone, F.lit(MISSING)).otherwise(F.col("quality_flag"))
    )


def clean(records: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """All flag rules over all participants and metrics; readings without their payload.

    Outlier limits and outlier flags both read the readings flagged so far, which are
    staged in between.
    """
    flagged = flag_out_of_range(flag_duplicates(without_payload(records)), settings)
    return flag_missing(flag_outliers(stage_table(flagged, "flagged"), settings))


def in_time_order(records: DataFrame) -> DataFrame:
    """Readings sorted by participant, metric and time.

    Only for writing or showing: no other operator depends on row order.
    """
    return records.orderBy("participant_id", "metric_type", "datetime", *PLACE)


def flag_counts(records: DataFrame) -> list[Column]:
    """Aggregates counting each flag."""
    return [F.count_if(F.col("quality_flag") == flag).alias(flag) for flag in FLAGS]


def cleaning_stats(cleaned: DataFrame) -> DataFrame:
    """Rows, rows per flag and share of good rows, per metric."""
    return (
        cleaned.groupBy("metric_type")
        .agg(F.count(F.lit(1)).alias("total_records"), *flag_counts(cleaned))
        .withColumn("good_percentage", F.col(GOOD) / F.col("total_records") * 100.0)
    )


def range_lookup(records: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Records with their metric's settings (a six-row table) beside them."""
    dimension = metric_dimension(records.sparkSession, settings).withColumnRenamed(
        "unit", "config_unit"
    )
    return records.join(F.broadcast(dimension), "metric_type", "left")
