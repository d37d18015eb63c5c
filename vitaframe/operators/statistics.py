"""Cohort statistics, profiles, headline values and cohort insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.config import DEFAULTS, GOOD, METRICS, Settings
from vitaframe.functions.columns import find_column
from vitaframe.functions.order_stats import group_summary
from vitaframe.functions.scalar import fixed, month_name, percent, sentence, weekday
from vitaframe.texts import COHORT

QUANTILES = {
    "p25": 0.25,
    "p50": 0.5,
    "p75": 0.75,
    "p90": 0.9,
    "p95": 0.95,
}


def good_rows(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.col("quality_flag") == GOOD)


def metric_statistics(cleaned: DataFrame) -> DataFrame:
    """Count, centre, spread and quantiles of each metric's good values.

    Statistics of the secondary value are null for metrics that have none.
    """
    series = (
        good_rows(cleaned)
        .select(
            "metric_type",
            F.inline(
                F.array(
                    F.struct(F.lit(1).alias("which"), F.col("value_1").alias("v")),
                    F.struct(F.lit(2).alias("which"), F.col("value_2").alias("v")),
                )
            ),
        )
        .where("v is not null")
    )
    summary = group_summary(series, ["metric_type", "which"], "v", QUANTILES)

    def of(which: int, column: Column, label: str) -> Column:
        return F.max(F.when(F.col("which") == which, column)).alias(label)

    return summary.groupBy("metric_type").agg(
        of(1, F.col("n"), "count"),
        of(1, F.col("mean"), "mean"),
        of(1, F.col("p50"), "median"),
        of(1, F.col("std"), "std"),
        of(1, F.col("min"), "min"),
        of(1, F.col("max"), "max"),
        of(1, F.col("p75") - F.col("p25"), "iqr"),
        *[of(1, F.col(p), p) for p in QUANTILES],
        of(2, F.col("mean"), "secondary_mean"),
        of(2, F.col("p50"), "secondary_median"),
        of(2, F.col("std"), "secondary_std"),
    )


def calendar_profiles(cleaned: DataFrame) -> DataFrame:
    """Mean of each metric per weekday and per month.

    ``profile`` is ``weekday`` or ``month``. Readings are first reduced to one
    sum per metric and day, which both profiles then share.
    """
    days = (
        good_rows(cleaned)
        .groupBy("metric_type", F.to_date("datetime").alias("date"))
        .agg(F.sum("value_1").alias("_sum"), F.count("value_1").alias("_n"))
    )
    named = days.select(
        "metric_type",
        "_sum",
        "_n",
        F.inline(
            F.array(
                F.struct(F.lit("weekday").alias("profile"), weekday("date").alias("label")),
                F.struct(F.lit("month").alias("profile"), month_name("date").alias("label")),
            )
        ),
    )
    return named.groupBy("metric_type", "profile", "label").agg(
        (F.sum("_sum") / F.sum("_n")).alias("mean")
    )


def headline_means(cleaned: DataFrame) -> DataFrame:
    """One row of cohort means for the report header."""
    metric = F.col("metric_type")

    def mean(name: str, value: str, label: str) -> Column:
        return F.avg(F.when(metric == name, F.col(value))).alias(label)

    return good_rows(cleaned).agg(
        mean("hr", "value_1", "avg_hr"),
        mean("bp", "value_1", "avg_systolic"),
        mean("bp", "value_2", "avg_diastolic"),
        mean("steps", "value_1", "avg_steps"),
        mean("sleep", "value_1", "avg_sleep"),
        mean("spo2", "value_1", "avg_spo2"),
        mean("temp", "value_1", "avg_temp"),
    )


def headline_means_of_wide(wide: DataFrame) -> DataFrame:
    """The same header from a table with one column per measure."""
    # Header name and the column it is taken from.
    sources = {
        "avg_hr": "resting_hr",
        "avg_systolic": "systolic",
        "avg_diastolic": "diastolic",
        "avg_steps": "steps",
        "avg_sleep": "sleep_duration",
        "avg_spo2": "spo2",
        "avg_temp": "temperature",
    }
    return wide.agg(
        *[
            (F.avg(c) if c in wide.columns else F.lit(None).cast("double")).alias(label)
            for label, c in sources.items()
        ]
    )


def fuzzy_means(df: DataFrame, patterns: dict[str, str], exact_first: bool = True) -> DataFrame:
    """Means of the columns whose names contain the patterns.

    A pattern without a column, or with only nulls, gives null.
    """
    columns = []
    for label, pattern in patterns.items():
        name = find_column(df, pattern, exact_first)
        value = F.col(f"`{name}`").try_cast("double") if name else F.lit(None).cast("double")
        columns.append(F.avg(value).alias(label))
    return df.agg(*columns)


# Name patterns of nutrition and lung-function columns.
MEAL_PATTERNS = {
    "avg_calories": "calorie",
    "avg_protein": "protein",
    "avg_carbs": "carb",
    "avg_fat": "fat",
}
LUNG_PATTERNS = {"avg_fev1": "fev1", "avg_fvc": "fvc"}


def table_summary(df: DataFrame) -> DataFrame:
    """Rows of a wide table and its measure columns, the fourth one on."""
    names = [F.lit(c) for c in df.columns[3:]]
    return df.agg(F.count(F.lit(1)).alias("record_count")).withColumn(
        "metrics", F.array(*names).cast("array<string>")
    )


def correlation_data_summary(daily: DataFrame, min_days: int = 7) -> DataFrame:
    """Span, days and measured metrics of each participant with enough days."""
    measured = F.array_compact(
        F.array(*[F.when(F.count(m) > 0, F.lit(m)) for m in METRICS])
    )
    return (
        daily.groupBy("participant_id")
        .agg(
            F.min("date").alias("start"),
            F.max("date").alias("end"),
            F.count(F.lit(1)).alias("total_days"),
            measured.alias("available_metrics"),
        )
        .where(F.col("total_days") >= min_days)
    )


def metric_insight_inputs(cleaned: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Participants, mean and share of high values of each metric's good rows."""
    rules = settings.rules
    limit = F.when(F.col("metric_type") == "bp", F.lit(rules.cohort_bp_high)).when(
        F.col("metric_type") == "steps", F.lit(rules.cohort_steps_goal)
    )
    per = good_rows(cleaned).groupBy("metric_type", "participant_id").agg(
        F.count("value_1").alias("_n"),
        F.sum("value_1").alias("_sum"),
        F.count_if(F.col("value_1") >= limit).alias("_over"),
    )
    return per.groupBy("metric_type").agg(
        F.count(F.lit(1)).alias("participants"),
        F.sum("_n").alias("readings"),
        (F.sum("_sum") / F.sum("_n")).alias("mean"),
        F.sum("_over").alias("over_limit"),
        percent(F.sum("_over"), F.sum("_n")).alias("over_limit_pct"),
    )


def cohort_insights(cleaned: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Cohort statements: (insight_code, metric_type, insight)."""
    rules = settings.rules
    totals = cleaned.groupBy("participant_id", "metric_type").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("quality_flag") == GOOD).alias("_good")
    )
    overall = totals.agg(
        F.countDistinct("participant_id").alias("participants"),
        F.countDistinct("metric_type").alias("metrics"),
        F.sum("_n").alias("records"),
        F.sum("_good").alias("good"),
    ).where("records > 0")
    statements = {
        "cohort_size": (F.col("participants").cast("string"), F.col("metrics").cast("string")),
        "overall_quality": (fixed(percent("good", "records"), 1),),
    }
    general = overall.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("insight_code"),
                        F.lit(None).cast("string").alias("metric_type"),
                        sentence(COHORT[name], *parts).alias("insight"),
                    )
                    for name, parts in statements.items()
                ]
            )
        )
    )
    m, mean = F.col("metric_type"), F.col("mean")
    over = F.col("over_limit") > 0
    share = fixed("over_limit_pct", 1)
    cases = [
        ((m == "bp") & over, "bp_high_share", share),
        ((m == "hr") & (mean > rules.cohort_hr[1]), "hr_elevated", fixed(mean, 0)),
        ((m == "hr") & (mean < rules.cohort_hr[0]), "hr_fit", fixed(mean, 0)),
        ((m == "steps") & over, "steps_goal_share", share),
        ((m == "sleep") & (mean < rules.cohort_sleep[0]), "sleep_short", fixed(mean, 1)),
        ((m == "sleep") & (mean > rules.cohort_sleep[1]), "sleep_long", fixed(mean, 1)),
    ]
    code, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for test, name, figure in cases:
        code = F.when(test, F.lit(name)).otherwise(code)
        text = F.when(test, sentence(COHORT[name], figure)).otherwise(text)
    specific = (
        metric_insight_inputs(cleaned, settings)
        .select(code.alias("insight_code"), "metric_type", text.alias("insight"))
        .where("insight_code is not null")
    )
    return general.unionByName(specific)


def report_metadata(cleaned: DataFrame) -> DataFrame:
    """Totals and the sorted list of metrics of a report."""
    per = cleaned.groupBy("participant_id", "metric_type").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(
        F.sum("n").alias("total_records"),
        F.countDistinct("participant_id").alias("total_participants"),
        F.sort_array(F.collect_set("metric_type")).alias("metrics_analyzed"),
    )
