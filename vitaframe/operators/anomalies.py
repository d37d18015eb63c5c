"""Anomalous days, recovery after them and what to say about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaframe.config import DEFAULTS, METRICS, Settings
from vitaframe.functions.scalar import fixed, round_even
from vitaframe.operators.correlation import eligible_days
from vitaframe.operators.daily import unpivot_daily

MIN_VALUES = 7
KEYS = ["participant_id", "metric_type"]


def anomaly_bounds(days: DataFrame) -> DataFrame:
    """Normal range (2 IQR fences) and recovery range (1.5 IQR) per metric.

    A group has one value per calendar day, so its quartiles are cheap.
    """
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    iqr = F.col("q3") - F.col("q1")
    return (
        unpivot_daily(days)
        .groupBy(KEYS)
        .agg(F.count(F.lit(1)).alias("values"), q.alias("_q"))
        .where(F.col("values") >= MIN_VALUES)
        .select(*KEYS, "values", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("q3"))
        .select(
            *KEYS,
            "values",
            (F.col("q1") - 2.0 * iqr).alias("lower"),
            (F.col("q3") + 2.0 * iqr).alias("upper"),
            (F.col("q1") - 1.5 * iqr).alias("recovery_lower"),
            (F.col("q3") + 1.5 * iqr).alias("recovery_upper"),
        )
    )


def anomaly_days(daily: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Days outside the normal range, with the days until recovery.

    Recovery looks at the calendar days after the anomaly, up to seven, and
    gives up at the first day without any record of the participant. Days that
    lack this metric are passed over. ``recovered_after`` is null when no value
    came back into the recovery range.
    """
    days = eligible_days(daily, settings)
    after = W.partitionBy("participant_id").orderBy("date").rowsBetween(1, 7)
    following = days.withColumn("_next", F.collect_list(F.struct("date", *METRICS)).over(after))

    def later_values(metric: str) -> Column:
        return F.transform(
            "_next", lambda x: F.struct(x["date"].alias("date"), x[metric].alias("v"))
        )

    per_metric = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric_type"),
                F.col(m).alias("value"),
                later_values(m).alias("following"),
            )
            for m in METRICS
        ]
    )
    # The k-th later row lies k days later only if no day in between is absent.
    hits = F.filter(
        "following",
        lambda x, i: (F.datediff(x["date"], F.col("date")) == i + 1)
        & x["v"].between(F.col("recovery_lower"), F.col("recovery_upper")),
    )
    return (
        following.select("participant_id", "date", F.inline(per_metric))
        .where("value is not null")
        .join(anomaly_bounds(days), KEYS)
        .where((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
        .withColumn(
            "recovered_after",
            F.array_min(F.transform(hits, lambda x: F.datediff(x["date"], F.col("date")))),
        )
        .select(*KEYS, "date", "value", "values", "lower", "upper", "recovered_after")
    )


def recovery_summary(anomalies: DataFrame) -> DataFrame:
    """Mean and median days to recovery and the share that recovered."""
    return anomalies.groupBy(KEYS).agg(
        F.avg("recovered_after").alias("mean_recovery_days"),
        F.percentile("recovered_after", F.lit(0.5)).alias("median_recovery_days"),
        (F.count("recovered_after") / F.count(F.lit(1)) * 100.0).alias("recovery_rate"),
    )


def anomaly_gaps(anomalies: DataFrame) -> DataFrame:
    """Days from each anomaly to the one before it."""
    order = W.partitionBy(*KEYS).orderBy("date")
    return anomalies.withColumn("gap_days", F.datediff("date", F.lag("date").over(order)))


def anomaly_summary(anomalies: DataFrame) -> DataFrame:
    """Count, share, range, dates, recovery and insight codes per metric."""
    summary = (
        anomaly_gaps(anomalies)
        .groupBy(KEYS)
        .agg(
            F.count(F.lit(1)).alias("anomaly_count"),
            F.first("values").alias("values"),
            F.first("lower").alias("lower"),
            F.first("upper").alias("upper"),
            F.array_sort(F.collect_list("date")).alias("anomaly_dates"),
            F.avg("recovered_after").alias("mean_recovery_days"),
            F.percentile("recovered_after", F.lit(0.5)).alias("median_recovery_days"),
            F.count("recovered_after").alias("_recovered"),
            F.count_if(F.col("gap_days") <= 3).alias("_close"),
            F.count("gap_days").alias("_gaps"),
        )
        .withColumn("_share", F.col("anomaly_count") / F.col("values") * 100.0)
        .withColumn("anomaly_percentage", round_even("_share", 1))
        .withColumn(
            "recovery_rate", round_even(F.col("_recovered") / F.col("anomaly_count") * 100.0, 1)
        )
    )
    frequency = (
        F.when(F.col("_share") > 15, F.lit("frequent"))
        .when(F.col("_share") > 5, F.lit("occasional"))
        .otherwise(F.lit("rare"))
    )
    recovery = (
        F.when(F.col("recovery_rate") > 80, F.lit("quick_recovery"))
        .when(F.col("recovery_rate") > 50, F.lit("moderate_recovery"))
        .otherwise(F.lit("slow_recovery"))
    )
    clustered = (F.col("anomaly_count") > 1) & (F.col("_close") > F.col("_gaps") * 0.5)
    # Insight sentences.
    days = fixed(round_even("mean_recovery_days", 1), 0)
    sentences = F.array_compact(
        F.array(
            F.concat(
                F.initcap("frequency_code"),
                F.lit(" "),
                "metric_type",
                F.lit(" anomalies detected ("),
                fixed("_share", 0),
                F.lit("% of days)"),
            ),
            F.when(
                F.col("recovery_code") == "quick_recovery",
                F.concat(F.lit("Quick recovery typical (average "), days, F.lit(" days)")),
            )
            .when(
                F.col("recovery_code") == "moderate_recovery",
                F.concat(F.lit("Moderate recovery patterns (average "), days, F.lit(" days)")),
            )
            .otherwise(F.lit("Slow or incomplete recovery from anomalies")),
            F.when(F.col("clustered"), F.lit("Anomalies tend to cluster together")),
        )
    )
    return (
        summary.withColumn("frequency_code", frequency)
        .withColumn("recovery_code", recovery)
        .withColumn("clustered", clustered)
        .withColumn("insights", sentences)
        .drop("_share", "_recovered", "_close", "_gaps")
    )
