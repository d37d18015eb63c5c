"""Days that deviate from the usual, and the meals of those days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaframe.config import DEFAULTS, METRICS, Settings
from vitaframe.functions.scalar import fixed
from vitaframe.operators.daily import daily_named_means, daily_wide, unpivot_daily
from vitaframe.operators.meals import dishes_by_day, meal_instants

MIN_DAYS = 3
Z_LIMIT = 1.5
MIN_THRESHOLD_DAYS = 7
PERCENT_LIMIT = 10.0
SEVERE_PERCENT = 20.0
# Meals that the report names for one day.
REPORT_MEALS = 50
# The text for a day without meals; decimals and unit of printed values, by
# what the metric's name contains.
NO_MEALS = "No meals recorded"
DISPLAY = {
    "systolic": (0, " mmHg"),
    "diastolic": (0, " mmHg"),
    "hr": (0, " bpm"),
    "heart": (0, " bpm"),
    "sleep": (1, " hours"),
    "step": (0, " steps"),
    "spo2": (0, "%"),
    "oxygen": (0, "%"),
    "temp": (1, "°C"),
}
DISPLAY_DEFAULT_DIGITS = 1


def deviation_stats(means: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, spread and extremes of the daily means, for at least three days."""
    return (
        means.groupBy(*by, "metric")
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.count(F.lit(1)).alias("days"),
        )
        .where((F.col("days") >= MIN_DAYS) & (F.col("std") > 0))
    )


def z_deviations(
    records: DataFrame, by: Sequence[str] = (), means: DataFrame | None = None
) -> DataFrame:
    """Days more than 1.5 deviations from the mean of the daily means."""
    means = daily_named_means(records, by) if means is None else means
    z = (F.col("value") - F.col("mean")) / F.col("std")
    return (
        means.join(deviation_stats(means, by), [*by, "metric"])
        .withColumn("z_score", z)
        .where(F.abs("z_score") > Z_LIMIT)
        .select(
            *by,
            "date",
            "metric",
            "value",
            "mean",
            "z_score",
            F.when(F.col("z_score") > 0, "above").otherwise("below").alias("direction"),
        )
    )


def _metrics_of_day(deviations: DataFrame, by: Sequence[str]) -> DataFrame:
    """The deviating metrics of each day; at most seven."""
    return deviations.groupBy(*by, "date").agg(
        F.sort_array(F.collect_list("metric")).alias("deviating_metrics")
    )


def meals_on_deviation_days(
    deviations: DataFrame, meals: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Dishes eaten on days with deviations and when, with what deviated."""
    return dishes_by_day(meals, by).join(_metrics_of_day(deviations, by), [*by, "date"])


def _limits_of(metric: str, limits: dict[str, tuple[float, float]]):
    return next((limits[key] for key in limits if key in metric), None)


def threshold_deviations(
    cleaned: DataFrame,
    by: Sequence[str] = ("participant_id",),
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Days more than 10 % off the mean day, or outside the metric's limits.

    Needs a week of days. With no ``by`` all participants count as one.
    """
    days = daily_wide(cleaned, by)
    counted = days.groupBy(*by).agg(
        F.count(F.lit(1)).alias("days"), *[F.avg(m).alias(m) for m in METRICS]
    )
    baseline = counted.where(F.col("days") >= MIN_THRESHOLD_DAYS).select(
        *by,
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(m).alias("metric_type"), F.col(m).alias("baseline"))
                    for m in METRICS
                ]
            )
        ),
    )
    v, base = F.col("value"), F.col("baseline")
    outside = F.lit(False)
    for m in METRICS:
        limits = _limits_of(m, settings.deviation_limits)
        if limits:
            outside = F.when(
                F.col("metric_type") == m, (v < limits[0]) | (v > limits[1])
            ).otherwise(outside)
    return (
        unpivot_daily(days, by)
        .join(baseline, [*by, "metric_type"])
        .withColumn(
            "deviation_pct",
            F.when(base == 0, F.lit(0.0)).otherwise(F.try_divide(v - base, base) * 100.0),
        )
        .withColumn("outside_threshold", outside)
        .where((F.abs("deviation_pct") > PERCENT_LIMIT) | F.col("outside_threshold"))
        .drop("days")
    )


def with_day_id(days: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``day_id``, which names a participant's day in all tables about it."""
    return days.withColumn("day_id", F.concat_ws("/", *by, F.col("date").cast("string")))


def deviating_days(
    deviations: DataFrame, meals: DataFrame, by: Sequence[str] = ("participant_id",)
) -> DataFrame:
    """One row per deviating day: what deviated, and how many meals were eaten.

    ``deviations`` lists the at most six deviating metrics. The dishes of the day are
    the rows of ``deviating_day_dishes`` with the same ``day_id``.
    """
    days = deviations.groupBy(*by, "date").agg(
        F.sort_array(
            F.collect_list(
                F.struct("metric_type", "value", "baseline", "deviation_pct", "outside_threshold")
            )
        ).alias("deviations")
    )
    eaten = dishes_by_day(meals, by).groupBy(*by, "date").agg(F.sum("servings").alias("meals"))
    return with_day_id(days.join(eaten, [*by, "date"], "left"), by).withColumn(
        "meals", F.coalesce("meals", F.lit(0).cast("long"))
    )


def deviating_day_dishes(
    deviations: DataFrame, meals: DataFrame, by: Sequence[str] = ("participant_id",)
) -> DataFrame:
    """The dishes of deviating days, one row per day, time and dish; none for a day without meals."""
    days = deviations.select(*by, "date").distinct()
    return with_day_id(dishes_by_day(meals, by).join(days, [*by, "date"], "left_semi"), by)


def deviation_days_with_meals(
    deviations: DataFrame, meals: DataFrame, by: Sequence[str] = ("participant_id",)
) -> DataFrame:
    """Deviating days with that day's dishes; days without meals are kept.

    One row per day, time and dish. ``deviations`` lists the at most six deviating
    metrics of the day.
    """
    days = deviations.groupBy(*by, "date").agg(
        F.sort_array(
            F.collect_list(
                F.struct("metric_type", "value", "baseline", "deviation_pct", "outside_threshold")
            )
        ).alias("deviations")
    )
    return days.join(dishes_by_day(meals, by), [*by, "date"], "left").withColumn(
        "servings", F.coalesce("servings", F.lit(0))
    )


def _named_meals(meals: DataFrame, by: Sequence[str]) -> DataFrame:
    """The meals of each day in one text, in order of time, and their number.

    Names the first REPORT_MEALS and how many more there were: a day of a whole cohort
    has no bound. Rows of equal meals are combined first, and only the first rows of a
    day are brought together.
    """
    keys = [*by, "date"]
    served = meal_instants(meals, by)
    place = W.partitionBy(*keys).orderBy(F.col("at").asc_nulls_last(), "dish")
    first = (
        served.withColumn("_place", F.row_number().over(place))
        .where(F.col("_place") <= REPORT_MEALS)
        .withColumn("_before", F.sum("servings").over(place.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("_room", F.lit(REPORT_MEALS) - F.coalesce("_before", F.lit(0)))
        .where("_room > 0")
        .withColumn("_shown", F.least("servings", "_room").cast("int"))
        .withColumn("_text", F.array_join(F.array_repeat("dish", F.col("_shown")), ", "))
    )
    named = first.groupBy(*keys).agg(
        F.expr("listagg(_text, ', ') WITHIN GROUP (ORDER BY _place)").alias("_named"),
        F.sum("_shown").alias("_count"),
    )
    totals = served.groupBy(*keys).agg(F.sum("servings").alias("meals"))
    more = F.col("meals") - F.col("_count")
    text = F.when(more > 0, F.concat("_named", F.format_string(" and %d more", more))).otherwise(
        F.col("_named")
    )
    return totals.join(named, keys).select(*keys, "meals", text.alias("meals_text"))


def _shown(value: str) -> Column:
    """A value as it is printed: decimals and unit by the metric's name."""
    text = fixed(value, DISPLAY_DEFAULT_DIGITS)
    for name, (digits, unit) in reversed(DISPLAY.items()):
        text = F.when(F.col("metric").contains(name), F.concat(fixed(value, digits), F.lit(unit))).otherwise(text)
    return text


def deviation_report(
    deviations: DataFrame, meals: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Z-score deviations by date: value and mean in their units, severity, that day's meals."""
    pct = F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(
        F.try_divide(F.col("value") - F.col("mean"), F.col("mean")) * 100.0
    )
    severe = (F.abs("deviation_pct") > SEVERE_PERCENT) | (F.abs("z_score") > Z_LIMIT)
    return (
        deviations.join(_named_meals(meals, by), [*by, "date"], "left")
        .withColumn("meals", F.coalesce("meals", F.lit(0).cast("long")))
        .withColumn("meals_text", F.coalesce("meals_text", F.lit(NO_MEALS)))
        .withColumn("deviation_pct", pct)
        .withColumn("severity", F.when(severe, F.lit("severe")).otherwise(F.lit("mild")))
        .withColumn("display_value", _shown("value"))
        .withColumn("display_baseline", _shown("mean"))
    )
