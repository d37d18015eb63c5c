"""Meals by day, favourite dishes, and meals beside daily values.

Meals of one day are kept as rows, counted per dish, not as one list: the
number of meals behind one date has no bound.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.functions.columns import find_column
from vitaframe.functions.order_stats import value_positions
from vitaframe.functions.scalar import clock, within_timestamps

RECENT_DATES = 5
TOP_DISHES = 5
# Where a dish is named, and what stands for a missing time.
DISH_COLUMNS = ("dish", "food", "meal")
UNKNOWN_TIME = "Unknown time"


def with_dish(meals: DataFrame) -> DataFrame:
    """The dish under the name ``dish``, from the first column that names one."""
    name = next((c for c in (find_column(meals, p) for p in DISH_COLUMNS) if c), None)
    if name is None:
        raise ValueError("no dish column")
    return meals if name == "dish" else meals.withColumn("dish", F.col(f"`{name}`"))


def with_meal_date(meals: DataFrame) -> DataFrame:
    """Adds the calendar date of the time in milliseconds, where it is missing."""
    if "date" in meals.columns or "time" not in meals.columns:
        return meals
    return meals.withColumn("date", F.to_date(F.timestamp_millis(within_timestamps(F.col("time"), 1000))))


def _meal_time(millis: Column) -> Column:
    return F.coalesce(clock(F.timestamp_millis(within_timestamps(millis, 1000))), F.lit(UNKNOWN_TIME))


def meal_instants(meals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Servings of each dish per day and millisecond (``at``; null without a time)."""
    return (
        with_dish(with_meal_date(meals))
        .where("date is not null")
        .groupBy(*by, "date", F.col("time").cast("long").alias("at"), "dish")
        .agg(F.count(F.lit(1)).alias("servings"))
    )


def daily_meals(meals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """What was eaten on each day and when, in order of time.

    ``servings`` counts equal meals, ``first_position`` is the place of the
    earliest of the meals at that time among the day's meals. Meals without a
    time are kept; they have no place.
    """
    keys = [*by, "date"]
    served = meal_instants(meals, by)
    places = value_positions(served, keys, "at", "servings").select(
        *keys, "at", (F.col("start") + 1).alias("first_position")
    )
    return served.join(places, [*keys, "at"], "left").select(
        *keys, _meal_time(F.col("at")).alias("meal_time"), "dish", "servings", "first_position"
    )


def dishes_by_day(meals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Servings of each dish per day and time of day."""
    return (
        with_dish(with_meal_date(meals))
        .where("date is not null")
        .groupBy(*by, "date", _meal_time(F.col("time").cast("long")).alias("meal_time"), "dish")
        .agg(F.count(F.lit(1)).alias("servings"))
    )


def meals_summary(meals: DataFrame) -> DataFrame:
    """Rows, different dishes and first and last date."""
    per_dish = (
        with_dish(with_meal_date(meals))
        .groupBy("dish")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("date").alias("first"),
            F.max("date").alias("last"),
        )
    )
    return per_dish.agg(
        F.sum("n").alias("record_count"),
        F.count(F.lit(1)).alias("unique_dishes"),
        F.min("first").alias("start"),
        F.max("last").alias("end"),
    )


def top_dishes(meals: DataFrame, n: int = TOP_DISHES) -> DataFrame:
    """The most frequent dishes; equal counts in alphabetical order."""
    meals = with_dish(meals)
    return (
        meals.where("dish is not null")
        .groupBy("dish")
        .agg(F.count(F.lit(1)).alias("servings"))
        .orderBy(F.desc("servings"), "dish")
        .limit(n)
    )


def recent_common_dates(meals: DataFrame, daily: DataFrame, n: int = RECENT_DATES) -> DataFrame:
    """The latest dates with both meals and daily values."""
    dated = with_meal_date(meals).select("date").where("date is not null")
    return dated.intersect(daily.select("date")).orderBy(F.desc("date")).limit(n)


def meal_interactions(meals: DataFrame, daily: DataFrame, n: int = RECENT_DATES) -> DataFrame:
    """Meals of the latest common dates beside that date's values.

    ``daily`` has one row per date. The dates are at most ``n`` rows.
    """
    dates = F.broadcast(recent_common_dates(meals, daily, n))
    eaten = dishes_by_day(meals).join(dates, "date", "left_semi")
    return eaten.join(daily.join(dates, "date", "left_semi"), "date")
