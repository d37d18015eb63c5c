"""One nested document per participant, from the tidy tables.

Only lists of bounded length are nested: metrics, pairs, rules and a
participant's anomalous dates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.functions.scalar import fixed, round_even
from vitaframe.operators.insights import all_insights, recommendations
from vitaframe.operators.statistics import correlation_data_summary
from vitaframe.plans.workspace import Workspace


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Columns rounded half to even for presentation."""
    return df.withColumns({name: round_even(name, n) for name, n in digits.items()})


def _listed(df: DataFrame, name: str, order: list[str], columns: list[str]) -> DataFrame:
    """A participant's rows as one sorted list of structs."""
    item = F.struct(*order, *[c for c in columns if c not in order])
    return df.groupBy("participant_id").agg(F.sort_array(F.collect_list(item)).alias(name))


def _coefficients() -> list[str]:
    return [
        "pearson_r3",
        "pearson_p4",
        "pearson_significant",
        "spearman_r3",
        "spearman_p4",
        "spearman_significant",
        "confidence",
        "interpretation",
    ]


# Decimals shown in documents.
BASELINE_DIGITS = {
    "mean": 1,
    "median": 1,
    "std": 2,
    "lower": 1,
    "upper": 1,
    "p25": 1,
    "p75": 1,
}


def participant_documents(ws: Workspace) -> DataFrame:
    """Everything known about each participant, one row each."""
    settings = ws.settings
    baselines = rounded(ws["baselines"], BASELINE_DIGITS)
    hourly = rounded(ws["hourly"], {"peak_value": 1, "low_value": 1})
    trends = rounded(
        ws["trends"],
        {"mean_correlation": 3, "std_correlation": 3, "slope": 4, "strength_change": 3},
    )
    anomalies = rounded(
        ws["anomalies"],
        {"lower": 2, "upper": 2, "mean_recovery_days": 1, "median_recovery_days": 1},
    )
    advice = recommendations(ws["baselines"], ws["correlations"], ws["anomalies"], settings)
    advice = advice.withColumn("place", (3 - F.col("priority_rank")) * 1000 + F.col("item_order"))
    summary = correlation_data_summary(ws["daily"], settings.min_days)
    period = summary.select(
        "participant_id",
        F.struct("start", "end", "total_days", "available_metrics").alias("data_period"),
    )
    key: Column = F.col("participant_id")
    parts = [
        period,
        _listed(
            baselines,
            "health_baselines",
            ["metric_type", "series"],
            ["count", *BASELINE_DIGITS, "interpretation"],
        ),
        _listed(
            hourly,
            "hourly_patterns",
            ["metric_type"],
            ["peak_hour", "peak_value", "low_hour", "low_value"],
        ),
        _listed(ws["weekdays"], "weekly_patterns", ["metric_type", "weekday"], ["mean"]),
        _listed(
            ws["correlations"], "daily", ["pair_order"], ["pair", "n_days", *_coefficients()]
        ),
        _listed(ws["lags"], "lag_effects", ["pair_order"], ["pair", "n_days", *_coefficients()]),
        _listed(
            trends,
            "rolling_trends",
            ["pair_order"],
            [
                "pair",
                "correlations",
                "mean_correlation",
                "std_correlation",
                "trend",
                "slope",
                "strength_change",
            ],
        ),
        _listed(
            anomalies,
            "anomalies",
            ["metric_type"],
            [
                "anomaly_dates",
                "anomaly_count",
                "anomaly_percentage",
                "lower",
                "upper",
                "mean_recovery_days",
                "median_recovery_days",
                "recovery_rate",
                "insights",
            ],
        ),
        _listed(
            all_insights(ws.insight_tables(), settings).where("family <> 'recommendations'"),
            "insights",
            ["family", "item_order"],
            ["code", "text"],
        ),
        _listed(
            advice,
            "recommendations",
            ["place"],
            ["code", "category", "priority", "recommendation", "action_items", "target"],
        ),
    ]
    people = ws["cleaned"].select(key).distinct()
    return reduce(lambda a, b: a.join(b, "participant_id", "left"), parts, people)


def document_rows(documents: DataFrame) -> DataFrame:
    """Documents turned back into rows, one per nested item.

    ``part`` names the list, ``item`` what the row is about; ``figure`` and ``text`` are
    its number and words.
    """
    who = F.col("participant_id")

    def row(part: str, item: Column, figure: Column, text: Column, rows: DataFrame) -> DataFrame:
        return rows.select(
            who,
            F.lit(part).alias("part"),
            item.alias("item"),
            figure.cast("double").alias("figure"),
            text.cast("string").alias("text"),
        )

    def items(part: str, item: Column, figure: Column, text: Column) -> DataFrame:
        return row(part, item, figure, text, documents.select(who, F.inline(part)))

    none = F.lit(None)
    metric, pair = F.col("metric_type"), F.col("pair")
    verdict = F.concat("confidence", F.lit(": "), "interpretation")
    period = F.col("data_period")
    with_period = documents.where(period.isNotNull())
    parts = [
        row("person", who, F.lit(1), none, documents),
        row(
            "data_period",
            F.concat(period["start"].cast("string"), F.lit(" to "), period["end"].cast("string")),
            period["total_days"],
            F.array_join(F.array_sort(period["available_metrics"]), ","),
            with_period,
        ),
        items(
            "health_baselines",
            F.concat_ws("/", metric, "series"),
            F.col("mean"),
            F.concat(F.col("count").cast("string"), F.lit(" readings, "), fixed("std", 2)),
        ),
        items(
            "hourly_patterns",
            metric,
            F.col("peak_value"),
            F.concat(F.col("peak_hour").cast("string"), F.lit(" to "), F.col("low_hour").cast("string")),
        ),
        items("weekly_patterns", F.concat_ws("/", metric, "weekday"), F.col("mean"), none),
        items("daily", pair, F.col("pearson_r3"), verdict),
        items("lag_effects", pair, F.col("n_days"), verdict),
        items("rolling_trends", pair, F.col("mean_correlation"), F.col("trend")),
        items(
            "anomalies",
            metric,
            F.col("anomaly_percentage"),
            F.array_join(F.transform("anomaly_dates", lambda d: d.cast("string")), ","),
        ),
        items("insights", F.concat_ws("/", "family", "code"), F.lit(1), F.col("text")),
        items(
            "recommendations",
            F.col("code"),
            F.lit(3) - F.floor(F.col("place") / 1000),
            F.concat_ws("/", "category", "priority", "target", F.array_join("action_items", "; ")),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)
