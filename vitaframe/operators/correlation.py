"""Correlations between metrics: same day, next day, rolling and cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaframe.config import CORRELATION_PAIRS, DEFAULTS, METRICS, Settings
from vitaframe.functions.order_stats import BAND, value_positions
from vitaframe.functions.scalar import (
    clamp,
    correlation_p_value,
    pearson,
    percent,
    round_even,
    sentence,
)
from vitaframe.operators.statistics import good_rows
from vitaframe.session import stage_table
from vitaframe.texts import RELATIONS

MIN_PAIRS = 5
MIN_WINDOW_PAIRS = 7
EXTRA_ROLLING_DAYS = 5
SIGNIFICANT = 0.05


def by_day():
    """A participant's days in order; one row per day, so the window is small."""
    return W.partitionBy("participant_id").orderBy("date")


def eligible_days(daily: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Daily rows of participants with enough days; adds ``days``, their number."""
    return daily.withColumn(
        "days", F.count(F.lit(1)).over(W.partitionBy("participant_id"))
    ).where(F.col("days") >= settings.min_days)


def _pair_rows(df: DataFrame, keep: list[str], second: str = "") -> DataFrame:
    """One row per listed pair with both values present: metric_1, metric_2, a, b."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(order).alias("pair_order"),
                F.lit(m1).alias("metric_1"),
                F.lit(m2).alias("metric_2"),
                F.col(m1).alias("a"),
                F.col(f"{m2}{second}").alias("b"),
            )
            for order, (m1, m2) in enumerate(CORRELATION_PAIRS)
        ]
    )
    return df.select(*keep, F.inline(pairs)).where("a is not null and b is not null")


def same_day_pairs(days: DataFrame) -> DataFrame:
    return _pair_rows(days, ["participant_id", "date"])


def next_day_values(days: DataFrame) -> DataFrame:
    """Each day with the values of the participant's next recorded day.

    The next row counts, whether or not it is the next calendar day.
    """
    return days.withColumns({f"{m}_next": F.lead(m).over(by_day()) for m in METRICS})


def next_day_pairs(days: DataFrame) -> DataFrame:
    return _pair_rows(next_day_values(days), ["participant_id", "date"], "_next")


def average_ranks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Ranks of ``a`` and ``b`` within their group, ties averaged.

    For groups that fit a task; larger groups go through value_positions.
    """

    def rank(name: str) -> Column:
        order = W.partitionBy(*keys).orderBy(name)
        ties = F.count(F.lit(1)).over(order.rangeBetween(W.currentRow, W.currentRow))
        return F.rank().over(order) + (ties - 1) / 2.0

    return pairs.withColumn("rank_a", rank("a")).withColumn("rank_b", rank("b"))


def _coefficients(ranked: DataFrame, keys: list[str], n: str) -> DataFrame:
    out = (
        ranked.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias(n),
            pearson(F.col("a"), F.col("b")).alias("pearson_r"),
            pearson(F.col("rank_a"), F.col("rank_b")).alias("spearman_r"),
        )
        .where(F.col(n) >= MIN_PAIRS)
        .withColumn("pearson_p", correlation_p_value("pearson_r", n))
        .withColumn("spearman_p", correlation_p_value("spearman_r", n))
    )
    return out.withColumns(
        {
            "pearson_significant": F.coalesce(F.col("pearson_p") < SIGNIFICANT, F.lit(False)),
            "spearman_significant": F.coalesce(F.col("spearman_p") < SIGNIFICANT, F.lit(False)),
            "pearson_r3": round_even("pearson_r", 3),
            "pearson_p4": round_even("pearson_p", 4),
            "spearman_r3": round_even("spearman_r", 3),
            "spearman_p4": round_even("spearman_p", 4),
        }
    )


def _strongest() -> Column:
    return F.coalesce(F.greatest(F.abs("pearson_r"), F.abs("spearman_r")), F.lit(0.0))


def confidence_level(n: Column, strength: Column) -> Column:
    # Tiers of days and strength.
    return (
        F.when((n >= 30) & (strength >= 0.5), F.lit("solid"))
        .when((n >= 14) & (strength >= 0.3), F.lit("pretty sure"))
        .when(strength >= 0.2, F.lit("might be a thing"))
        .otherwise(F.lit("not confident"))
    )


def interpret_pair() -> Column:
    """Sentence for the stronger of the two coefficients."""
    use_pearson = F.abs("pearson_r") >= F.abs("spearman_r")
    r = F.when(use_pearson, F.col("pearson_r")).otherwise(F.col("spearman_r"))
    p = F.when(use_pearson, F.col("pearson_p")).otherwise(F.col("spearman_p"))
    size = (
        F.when(F.abs(r) >= 0.7, F.lit("Strong"))
        .when(F.abs(r) >= 0.5, F.lit("Moderate"))
        .when(F.abs(r) >= 0.3, F.lit("Weak"))
        .otherwise(F.lit("Very weak"))
    )
    sign = F.when(r > 0, F.lit("positive")).otherwise(F.lit("negative"))
    return F.when(
        F.coalesce(p < SIGNIFICANT, F.lit(False)), sentence(RELATIONS["same_day"], size, sign)
    ).otherwise(F.lit(RELATIONS["no_same_day"]))


def interpret_next_day() -> Column:
    """Sentence for a next-day effect, by the Pearson coefficient."""
    r = F.col("pearson_r")
    size = (
        F.when(F.abs(r) >= 0.5, F.lit("strongly"))
        .when(F.abs(r) >= 0.3, F.lit("moderately"))
        .otherwise(F.lit("slightly"))
    )
    sign = F.when(r > 0, F.lit("increases")).otherwise(F.lit("decreases"))
    return F.when(
        F.coalesce(F.col("pearson_p") < SIGNIFICANT, F.lit(False)),
        sentence(RELATIONS["next_day"], "metric_1", size, sign, "metric_2"),
    ).otherwise(sentence(RELATIONS["no_next_day"], "metric_1", "metric_2"))


PAIR_KEYS = ["participant_id", "pair_order", "metric_1", "metric_2"]


def daily_correlations(daily: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Same-day correlations of every participant and pair with enough days."""
    pairs = same_day_pairs(eligible_days(daily, settings))
    return (
        _coefficients(average_ranks(pairs, PAIR_KEYS), PAIR_KEYS, "n_days")
        .withColumn("pair", F.concat_ws("_vs_", "metric_1", "metric_2"))
        .withColumn("confidence", confidence_level(F.col("n_days"), _strongest()))
        .withColumn("interpretation", interpret_pair())
    )


def lag_correlations(daily: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Correlations of one metric with another on the next recorded day."""
    pairs = next_day_pairs(eligible_days(daily, settings))
    return (
        _coefficients(average_ranks(pairs, PAIR_KEYS), PAIR_KEYS, "n_days")
        .withColumn("pair", F.concat("metric_1", F.lit("_to_"), "metric_2", F.lit("_next_day")))
        .withColumn("confidence", confidence_level(F.col("n_days"), _strongest()))
        .withColumn("interpretation", interpret_next_day())
    )


def rolling_correlations(daily: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Pearson r over the days before each day, from the first full window on.

    All pairs are computed in one pass over a participant's days. ``r`` is null
    where a window has too few days with both metrics.
    """
    size = settings.rolling_window
    before = by_day().rowsBetween(-size, -1)
    days = eligible_days(daily, settings).where(F.col("days") >= size + EXTRA_ROLLING_DAYS)
    windows = {"_row": F.row_number().over(by_day())}
    for m in METRICS:
        windows[f"_has_{m}"] = F.count(m).over(W.partitionBy("participant_id")) > 0
    for i, (m1, m2) in enumerate(CORRELATION_PAIRS):
        both = F.col(m1).isNotNull() & F.col(m2).isNotNull()
        a, b = F.when(both, F.col(m1)), F.when(both, F.col(m2))
        windows[f"_n{i}"] = F.count(a).over(before)
        windows[f"_cov{i}"] = F.covar_pop(a, b).over(before)
        windows[f"_sa{i}"] = F.stddev_pop(a).over(before)
        windows[f"_sb{i}"] = F.stddev_pop(b).over(before)
    rolled = days.withColumns(windows).where(F.col("_row") > size)
    pairs = F.array(
        *[
            F.struct(
                F.lit(i).alias("pair_order"),
                F.lit(m1).alias("metric_1"),
                F.lit(m2).alias("metric_2"),
                (F.col(f"_has_{m1}") & F.col(f"_has_{m2}")).alias("_measured"),
                F.col(f"_n{i}").alias("valid_days"),
                F.when(
                    F.col(f"_n{i}") >= MIN_WINDOW_PAIRS,
                    clamp(
                        F.try_divide(F.col(f"_cov{i}"), F.col(f"_sa{i}") * F.col(f"_sb{i}")),
                        -1.0,
                        1.0,
                    ),
                ).alias("r"),
            )
            for i, (m1, m2) in enumerate(CORRELATION_PAIRS)
        ]
    )
    return (
        rolled.select("participant_id", "date", F.inline(pairs)).where("_measured").drop("_measured")
    )


def trend_label(n: Column, slope: Column) -> Column:
    # Slopes that separate the trends.
    return (
        F.when(n < 3, F.lit("insufficient_data"))
        .when(F.abs(slope) < 0.001, F.lit("stable"))
        .when(slope > 0.005, F.lit("strengthening"))
        .when(slope < -0.005, F.lit("weakening"))
        .otherwise(F.lit("stable"))
    )


def rolling_summary(rolling: DataFrame) -> DataFrame:
    """Mean, spread, list and trend of each pair's rolling correlations.

    The trend is the slope over the valid windows, numbered in time order.
    """
    order = W.partitionBy(*PAIR_KEYS).orderBy(F.col("r").isNull(), "date")
    series = F.transform(
        F.array_sort(F.collect_list(F.struct("date", "r"))),
        lambda x: round_even(x["r"], 3),
    )
    n, slope = F.col("valid_windows"), F.col("_slope")
    return (
        rolling.withColumn("_index", (F.row_number().over(order) - 1).cast("double"))
        .groupBy(*PAIR_KEYS)
        .agg(
            F.count(F.lit(1)).alias("windows"),
            F.count("r").alias("valid_windows"),
            F.avg("r").alias("mean_correlation"),
            F.stddev_pop("r").alias("std_correlation"),
            F.regr_slope("r", F.col("_index")).alias("_slope"),
            series.alias("correlations"),
        )
        .where("valid_windows > 0")
        .withColumn("pair", F.concat_ws("_vs_", "metric_1", "metric_2"))
        .withColumn("trend", trend_label(n, slope))
        .withColumn("slope", F.when(n >= 3, slope))
        .withColumn("strength_change", F.when(n >= 3, slope * n))
        .drop("_slope")
    )


def participant_metric_means(cleaned: DataFrame) -> DataFrame:
    """Mean of each metric per participant, for those with at least two metrics."""
    value, metric = F.col("value_1"), F.col("metric_type")
    means = good_rows(cleaned).groupBy("participant_id").agg(
        *[F.avg(F.when(metric == m, value)).alias(m) for m in METRICS]
    )
    present = sum((F.col(m).isNotNull().cast("int") for m in METRICS), F.lit(0))
    return means.where(present >= 2)


def cohort_correlations(cleaned: DataFrame) -> DataFrame:
    """Correlations between participants' mean values, per pair of metrics.

    Pairs are in alphabetical order. A pair ranges over all participants: unless
    they are few its ranks come from counted values rather than from one sorted
    list. Ranks are joined on the means, which are staged first: read back they are
    the same numbers in every use.
    """
    ordered = sorted(METRICS)
    pairs = F.array(
        *[
            F.struct(
                F.lit(m1).alias("metric_1"),
                F.lit(m2).alias("metric_2"),
                F.col(m1).alias("a"),
                F.col(m2).alias("b"),
            )
            for i, m1 in enumerate(ordered)
            for m2 in ordered[i + 1 :]
        ]
    )
    keys = ["metric_1", "metric_2"]
    means = stage_table(participant_metric_means(cleaned), "participant-means")
    rows = means.select("participant_id", F.inline(pairs)).where("a is not null and b is not null")
    if means.count() <= BAND:
        ranked = average_ranks(rows, keys)
    else:
        ranks_a = value_positions(rows, keys, "a").select(
            *keys, "a", F.col("average_rank").alias("rank_a")
        )
        ranks_b = value_positions(rows, keys, "b").select(
            *keys, "b", F.col("average_rank").alias("rank_b")
        )
        ranked = rows.join(ranks_a, [*keys, "a"]).join(ranks_b, [*keys, "b"])
    return _coefficients(ranked, keys, "n_participants").withColumn(
        "pair", F.concat_ws("_vs_", "metric_1", "metric_2")
    )


def correlation_totals(correlations: DataFrame) -> DataFrame:
    """Number of correlations and of significant ones."""
    return correlations.agg(
        F.count(F.lit(1)).alias("total_correlations"),
        F.count_if("pearson_significant").alias("total_significant"),
        percent(F.count_if("pearson_significant"), F.count(F.lit(1))).alias("significant_pct"),
    )
