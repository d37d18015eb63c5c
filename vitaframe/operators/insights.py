"""Rule-based findings, behaviour, recommendations and progress.

Every rule yields rows of one shape: participant, family, order, code and text.
They are taken from the small per-participant tables of the other operators.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitaframe.config import DEFAULTS, METRICS, PRIORITY_RANKS, Settings
from vitaframe.functions.scalar import fixed, grouped, sentence
from vitaframe.texts import BEHAVIOUR, FINDINGS, PROGRESS, RECOMMENDATIONS, SUMMARY

CONFIDENT = ["solid", "pretty sure"]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def metric_order(metric: Column | str = "metric_type") -> Column:
    metric = F.col(metric) if isinstance(metric, str) else metric
    return F.array_position(F.array(*[F.lit(m) for m in METRICS]), metric)


def _first_case(cases: list[tuple[Column, dict[str, Column]]], name: str) -> Column:
    out = None
    for test, values in cases:
        out = F.when(test, values[name]) if out is None else out.when(test, values[name])
    return out


def _rule_rows(
    df: DataFrame, family: str, order: Column, cases: list[tuple[Column, dict[str, Column]]]
) -> DataFrame:
    """The first matching case of each row as an insight row."""
    return df.select(
        "participant_id",
        F.lit(family).alias("family"),
        order.cast("long").alias("item_order"),
        _first_case(cases, "code").alias("code"),
        _first_case(cases, "text").alias("text"),
    ).where("code is not null")


def _case(test: Column, code: str | Column, text: Column) -> tuple[Column, dict[str, Column]]:
    return test, {"code": F.lit(code) if isinstance(code, str) else code, "text": text}


def primary(baselines: DataFrame) -> DataFrame:
    return baselines.where("series = 'primary'")


def health_summary(baselines: DataFrame) -> DataFrame:
    """One statement per tracked metric of a participant."""
    second = baselines.where("series = 'secondary' and metric_type = 'bp'").select(
        "participant_id", "metric_type", F.col("mean_1").alias("second_mean")
    )
    rows = primary(baselines).join(second, ["participant_id", "metric_type"], "left")
    m = F.col("metric_type")
    plain = fixed("mean_1", 1)
    values = {
        "bp": (plain, F.coalesce(fixed("second_mean", 1), F.lit("N/A"))),
        "steps": (grouped("mean_1"),),
    }
    cases = [
        _case(m == name, m, sentence(SUMMARY[name], *values.get(name, (plain,))))
        for name in METRICS
    ]
    return _rule_rows(rows, "health_summary", metric_order(), cases)


def data_quality_score(baselines: DataFrame) -> DataFrame:
    """0 to 100: share of the six metrics, with a bonus above 100 readings."""
    rows = primary(baselines).groupBy("participant_id").agg(
        F.count(F.lit(1)).alias("metrics_tracked"), F.sum("count").alias("total_records")
    )
    base = F.col("metrics_tracked") / F.lit(float(len(METRICS))) * 100.0
    score = F.when(
        F.col("total_records") > 100, F.least(F.lit(100.0), base * 1.1)
    ).otherwise(base)
    return rows.withColumn("data_quality_score", F.floor(score).cast("int"))


def baseline_findings(baselines: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    r, m, mean = settings.rules, F.col("metric_type"), F.col("mean_1")
    plain = fixed("mean_1", 1)
    cases = [
        _case((m == "bp") & (mean >= r.bp_attention), "bp_high", sentence(FINDINGS["bp_high"], plain)),
        _case((m == "hr") & (mean > r.hr_attention), "hr_high", sentence(FINDINGS["hr_high"], plain)),
        _case(
            (m == "steps") & (mean < r.steps_attention),
            "steps_low",
            sentence(FINDINGS["steps_low"], grouped("mean_1")),
        ),
        _case(
            (m == "sleep") & (mean < r.sleep_attention),
            "sleep_low",
            sentence(FINDINGS["sleep_low"], plain),
        ),
        _case(
            (m == "spo2") & (mean < r.spo2_attention),
            "spo2_low",
            sentence(FINDINGS["spo2_low"], plain),
        ),
    ]
    return _rule_rows(primary(baselines), "key_findings", metric_order(), cases)


def correlation_findings(correlations: DataFrame) -> DataFrame:
    """Significant, strong and confident same-day correlations."""
    r = F.col("pearson_r3")
    test = (
        F.col("pearson_significant") & (F.abs(r) >= 0.5) & F.col("confidence").isin(CONFIDENT)
    )
    direction = F.when(r > 0, F.lit("positively")).otherwise(F.lit("negatively"))
    text = sentence(
        FINDINGS["strong_relationship"], "metric_1", "metric_2", direction, fixed(r, 2)
    )
    code = F.concat(F.lit("strong_relationship:"), "pair")
    return _rule_rows(
        correlations, "key_findings", F.col("pair_order") + 100, [_case(test, code, text)]
    )


def anomaly_findings(anomalies: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Metrics with many anomalous days."""
    text = sentence(
        FINDINGS["unusual_days"],
        F.col("anomaly_count").cast("string"),
        "metric_type",
        fixed("anomaly_percentage", 1),
    )
    test = F.col("anomaly_percentage") > settings.rules.anomaly_share
    code = F.concat(F.lit("unusual_days:"), "metric_type")
    return _rule_rows(
        anomalies, "key_findings", metric_order() + 200, [_case(test, code, text)]
    )


def peak_hour_insights(hourly: DataFrame) -> DataFrame:
    m, hour = F.col("metric_type"), F.col("peak_hour")
    at, value = hour.cast("string"), fixed("peak_value", 1)
    morning, evening = hour.between(6, 10), hour.between(18, 22)
    cases = [
        _case(
            (m == "hr") & morning,
            "hr_morning_peak",
            sentence(BEHAVIOUR["hr_morning_peak"], at, value),
        ),
        _case(
            (m == "hr") & evening,
            "hr_evening_peak",
            sentence(BEHAVIOUR["hr_evening_peak"], at, value),
        ),
        _case(
            (m == "bp") & morning, "bp_morning_peak", sentence(BEHAVIOUR["bp_morning_peak"], at)
        ),
    ]
    return _rule_rows(hourly, "behavioral_insights", metric_order(), cases)


def lag_insights(lags: DataFrame) -> DataFrame:
    """Significant next-day effects with high confidence."""
    test = F.col("pearson_significant") & F.col("confidence").isin(CONFIDENT)
    code = F.concat(F.lit("lag:"), "pair")
    return _rule_rows(
        lags,
        "behavioral_insights",
        F.col("pair_order") + 100,
        [_case(test, code, F.col("interpretation"))],
    )


def weekday_extremes(weekdays: DataFrame) -> DataFrame:
    """Weekdays with the highest and lowest mean; the earlier one wins a tie."""
    place = F.array_position(F.array(*[F.lit(d) for d in WEEKDAYS]), F.col("weekday"))
    best = F.max(F.struct(F.col("mean"), (-place).alias("p"), F.col("weekday")))
    worst = F.min(F.struct(F.col("mean"), place.alias("p"), F.col("weekday")))
    return (
        weekdays.groupBy("participant_id", "metric_type")
        .agg(F.count(F.lit(1)).alias("weekdays"), best.alias("_b"), worst.alias("_w"))
        .select(
            "participant_id",
            "metric_type",
            "weekdays",
            F.col("_b.weekday").alias("max_day"),
            F.col("_b.mean").alias("max_value"),
            F.col("_w.weekday").alias("min_day"),
            F.col("_w.mean").alias("min_value"),
        )
    )


def weekday_insights(weekdays: DataFrame) -> DataFrame:
    """What differs between weekdays, where at least five are known."""
    m = F.col("metric_type")
    weekend, working = WEEKDAYS[5:], WEEKDAYS[:5]
    cases = [
        _case(
            m == "steps",
            "steps_weekdays",
            sentence(
                BEHAVIOUR["steps_weekdays"],
                "max_day",
                grouped("max_value"),
                "min_day",
                grouped("min_value"),
            ),
        ),
        _case(
            (m == "sleep") & F.col("max_day").isin(weekend) & F.col("min_day").isin(working),
            "sleep_weekend",
            sentence(
                BEHAVIOUR["sleep_weekend"],
                fixed("max_value", 1),
                "max_day",
                fixed("min_value", 1),
                "min_day",
            ),
        ),
    ]
    rows = weekday_extremes(weekdays).where("weekdays >= 5")
    return _rule_rows(rows, "behavioral_insights", metric_order() + 200, cases)


def _advice(df: DataFrame, code: str, order: Column, text: Column, actions: Column | None = None):
    fixed_part = RECOMMENDATIONS[code]
    if actions is None:
        actions = F.array(*[F.lit(a) for a in fixed_part["actions"]])
    return df.select(
        "participant_id",
        order.cast("long").alias("item_order"),
        F.lit(code).alias("code"),
        F.lit(fixed_part["category"]).alias("category"),
        F.lit(fixed_part["priority"]).alias("priority"),
        F.lit(PRIORITY_RANKS[fixed_part["priority"]]).alias("priority_rank"),
        text.alias("recommendation"),
        actions.alias("action_items"),
        F.lit(fixed_part["target"]).alias("target"),
    )


def recommendations(
    baselines: DataFrame,
    correlations: DataFrame,
    anomalies: DataFrame,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    """Advice by rule, with category, priority, actions and target."""
    r = settings.rules
    own = primary(baselines)
    m, mean = F.col("metric_type"), F.col("mean_1")
    texts = {code: part["text"] for code, part in RECOMMENDATIONS.items()}
    recovery = RECOMMENDATIONS["recovery_low"]["actions"]
    parts = [
        _advice(
            own.where((m == "bp") & (mean >= r.bp_attention)),
            "bp_high",
            metric_order(),
            F.lit(texts["bp_high"]),
        ),
        _advice(
            own.where((m == "steps") & (mean < r.steps_goal)),
            "steps_low",
            metric_order(),
            sentence(texts["steps_low"], grouped("mean_1")),
        ),
        _advice(
            own.where((m == "sleep") & (mean < r.sleep_attention)),
            "sleep_low",
            metric_order(),
            sentence(texts["sleep_low"], fixed("mean_1", 1)),
        ),
        _advice(
            correlations.where(
                (F.col("pair") == "steps_vs_sleep")
                & F.col("pearson_significant")
                & (F.col("pearson_r3") > 0.3)
            ),
            "steps_sleep",
            F.lit(100),
            F.lit(texts["steps_sleep"]),
        ),
        _advice(
            anomalies.where(F.col("recovery_rate") < 50),
            "recovery_low",
            metric_order() + 200,
            sentence(texts["recovery_low"], "metric_type"),
            F.array(
                sentence(recovery[0], "metric_type"), *[F.lit(a) for a in recovery[1:]]
            ),
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def by_priority(advice: DataFrame) -> DataFrame:
    """Each participant's recommendations from high to low priority."""
    return advice.orderBy("participant_id", F.desc("priority_rank"), "item_order")


def progress_insights(rolling: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Trends of rolling correlations and latest anomalies, as progress rows."""
    trend = F.col("trend")
    code = (
        F.when(trend == "strengthening", F.concat(F.lit("improvement:"), "pair"))
        .when(trend == "weakening", F.concat(F.lit("concern:"), "pair"))
        .otherwise(F.concat(F.lit("stable:"), "pair"))
    )
    text = (
        F.when(
            trend == "strengthening", sentence(PROGRESS["strengthening"], "metric_1", "metric_2")
        )
        .when(trend == "weakening", sentence(PROGRESS["weakening"], "metric_1", "metric_2"))
        .otherwise(F.lit("stable"))
    )
    trends = _rule_rows(
        rolling, "progress_tracking", F.col("pair_order"), [_case(F.lit(True), code, text)]
    )
    recent = F.least(F.col("anomaly_count"), F.lit(7))
    latest = _rule_rows(
        anomalies,
        "progress_tracking",
        metric_order() + 100,
        [
            _case(
                recent > 0,
                F.concat(F.lit("concern:"), "metric_type"),
                sentence(PROGRESS["recent_anomalies"], recent.cast("string"), "metric_type"),
            )
        ],
    )
    return trends.unionByName(latest)


def key_findings(
    baselines: DataFrame,
    correlations: DataFrame,
    anomalies: DataFrame,
    settings: Settings = DEFAULTS,
) -> DataFrame:
    return (
        baseline_findings(baselines, settings)
        .unionByName(correlation_findings(correlations))
        .unionByName(anomaly_findings(anomalies, settings))
    )


def behavioural_insights(hourly: DataFrame, lags: DataFrame, weekdays: DataFrame) -> DataFrame:
    return (
        peak_hour_insights(hourly)
        .unionByName(lag_insights(lags))
        .unionByName(weekday_insights(weekdays))
    )


def all_insights(tables: dict[str, DataFrame], settings: Settings = DEFAULTS) -> DataFrame:
    """Every insight family of every participant in one table.

    ``tables`` holds baselines, hourly, weekdays, correlations, lags, rolling
    and anomalies.
    """
    advice = recommendations(
        tables["baselines"], tables["correlations"], tables["anomalies"], settings
    ).select(
        "participant_id",
        F.lit("recommendations").alias("family"),
        ((3 - F.col("priority_rank")) * 1000 + F.col("item_order")).alias("item_order"),
        "code",
        F.col("recommendation").alias("text"),
    )
    return reduce(
        DataFrame.unionByName,
        [
            health_summary(tables["baselines"]),
            key_findings(
                tables["baselines"], tables["correlations"], tables["anomalies"], settings
            ),
            behavioural_insights(tables["hourly"], tables["lags"], tables["weekdays"]),
            advice,
            progress_insights(tables["rolling"], tables["anomalies"]),
        ],
    )


# Words that make a finding a warning.
SEVERE_WORDS = ["elevated", "high", "low", "below", "above"]


def finding_severity(findings: DataFrame, text: str = "text") -> DataFrame:
    """Marks findings whose text holds a warning word."""
    return findings.withColumn(
        "severity",
        F.when(F.lower(text).rlike("|".join(SEVERE_WORDS)), F.lit("warning")).otherwise(
            F.lit("info")
        ),
    )
