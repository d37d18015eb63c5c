"""Texts and report tables from small hand-made inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vitaframe.config import METRICS
from vitaframe.operators import baseline as bl
from vitaframe.operators import insights as ins
from vitaframe.operators import reports as rep

D0 = dt.datetime(2024, 1, 1)  # a Monday


@pytest.fixture
def cleaned(make_records):
    rows = []
    for i in range(14):
        at = D0 + dt.timedelta(days=i)
        rows.append(("p", "bp", at.replace(hour=7), 130.0 + i % 3, 80.0))
        rows.append(("p", "hr", at.replace(hour=20), 100.0 + i % 4, None))
        rows.append(("p", "steps", at, 4000.0 + 100 * (i % 7), None))
        rows.append(("p", "sleep", at, 8.0 if i % 7 > 4 else 6.0, None))
    rows.append(("p", "temp", D0, 98.0, None))  # one reading: no baseline
    return make_records(rows)


CORR = (
    "participant_id string, pair_order int, metric_1 string, metric_2 string, n_days long, pearson_r3 double, "
    "pearson_p4 double, pearson_significant boolean, spearman_r3 double, spearman_p4 double, "
    "spearman_significant boolean, confidence string, interpretation string"
)


@pytest.fixture
def correlations(spark):
    rows = [
        ("p", 0, "steps", "sleep", 30, 0.71, 0.001, True, 0.6, 0.002, True, "solid", "Strong positive correlation"),
        ("p", 1, "steps", "hr", 15, -0.65, 0.04, True, 0.1, 0.7, False, "pretty sure", "x"),
        ("p", 2, "steps", "bp", 9, 0.31, 0.08, False, 0.1, 0.7, False, "might be a thing", "x"),
        ("p", 3, "steps", "temp", 9, 0.05, 0.8, False, 0.1, 0.7, False, "not confident", "x"),
        ("q", 0, "steps", "sleep", 9, 0.11, 0.8, False, 0.1, 0.7, False, "not confident", "x"),
        ("q", 1, "steps", "hr", 9, -0.21, 0.8, False, 0.1, 0.7, False, "not confident", "x"),
        ("q", 2, "steps", "bp", 9, 0.12, 0.8, False, 0.1, 0.7, False, "not confident", "x"),
        ("q", 9, "hr", "temp", 9, 0.13, 0.8, False, 0.1, 0.7, False, "not confident", "x"),
        ("q", 5, "sleep", "hr", 9, None, None, False, None, None, False, "not confident", "x"),
    ]
    return spark.createDataFrame(rows, CORR).withColumn("pair", F.concat_ws("_vs_", "metric_1", "metric_2"))


@pytest.fixture
def anomalies(spark):
    return spark.createDataFrame(
        [("p", "hr", 9, 25.0, 40.0), ("p", "bp", 2, 4.0, 100.0)],
        "participant_id string, metric_type string, anomaly_count long, anomaly_percentage double, recovery_rate double",
    )


def _texts(df):
    return [r["text"] for r in df.orderBy("item_order").collect()]


def test_baselines_and_findings(cleaned, correlations, anomalies):
    base = bl.health_baselines(cleaned)
    rows = {(r["metric_type"], r["series"]): r for r in base.collect()}
    assert set(rows) == {("bp", "primary"), ("bp", "secondary"), ("hr", "primary"), ("steps", "primary"), ("sleep", "primary")}
    assert rows["bp", "primary"]["interpretation"] == "Stage 1 hypertension range"
    assert rows["bp", "secondary"]["interpretation"] == "Within measured range"
    assert _texts(ins.health_summary(base)) == [
        "Average blood pressure: 130.9/80.0 mmHg",
        "Average sleep: 6.6 hours per night",
        "Average daily steps: 4,300",
        "Average heart rate: 101.4 bpm",
    ]
    assert ins.data_quality_score(base).first()["data_quality_score"] == 66
    findings = ins.key_findings(base, correlations, anomalies)
    assert _texts(findings) == [
        "Your average blood pressure of 130.9 mmHg indicates elevated levels that may need attention",
        "You're getting 6.6 hours of sleep per night, below the recommended 7-9 hours",
        "Your daily step count averages 4,300 steps, below the recommended 10,000 steps",
        "Your resting heart rate averages 101.4 bpm, which is above the normal range (60-100 bpm)",
        "Strong relationship found: your steps and sleep are positively correlated (r=0.71)",
        "Strong relationship found: your steps and hr are negatively correlated (r=-0.65)",
        "Detected 9 unusual hr days (25.0% of monitoring period)",
    ]
    marks = [r["severity"] for r in ins.finding_severity(findings).orderBy("item_order").collect()]
    assert marks == ["warning"] * 4 + ["info"] * 3
    overview = rep.participant_overview(base, findings).first()
    assert overview["finding_codes"] == "bp_high; sleep_low" and overview["quality_score"] == 56
    six = {r["metric_type"]: r["mean"] for r in rep.metrics_overview(base).collect()}
    assert set(six) == set(METRICS) and six["spo2"] is None and six["sleep"] == 6.6


def test_patterns(cleaned):
    hourly = bl.hourly_pattern(cleaned)
    assert _texts(ins.peak_hour_insights(hourly)) == [
        "Your blood pressure tends to be highest in the morning around 7:00",
        "Your heart rate is highest in the evening around 20:00 (101.4 bpm)",
    ]
    midnight = {r["metric_type"]: r["peak_value"] for r in bl.hourly_pattern(cleaned, parity=True).collect()}
    assert midnight["steps"] is None and midnight["bp"] is not None
    assert _texts(ins.weekday_insights(bl.weekday_pattern(cleaned))) == [
        "You sleep longer on weekends (8.0 hours on Saturdays) vs weekdays (6.0 hours on Mondays)",
        "You're most active on Sundays (4,600 steps) and least active on Mondays (4,000 steps)",
    ]


def test_recommendations(cleaned, correlations, anomalies):
    advice = ins.recommendations(bl.health_baselines(cleaned), correlations, anomalies)
    rows = ins.by_priority(advice).collect()
    assert [(r["priority"], r["code"]) for r in rows] == [
        ("High", "bp_high"), ("High", "sleep_low"), ("Medium", "steps_low"), ("Medium", "steps_sleep"), ("Medium", "recovery_low"),
    ]
    assert rows[2]["recommendation"] == "Increase daily activity from current 4,300 steps"
    assert rows[4]["action_items"][0] == "Monitor hr more closely during unusual periods"
    groups = {r["priority"]: r["recommendations"] for r in rep.priority_groups(advice).collect()}
    assert groups == {"High": 2, "Medium": 3}


def test_progress(spark, anomalies):
    rolling = spark.createDataFrame(
        [("p", 0, "steps", "sleep", "strengthening"), ("p", 1, "steps", "hr", "weakening"), ("p", 2, "steps", "bp", "insufficient_data")],
        "participant_id string, pair_order int, metric_1 string, metric_2 string, trend string",
    ).withColumn("pair", F.concat_ws("_vs_", "metric_1", "metric_2"))
    assert _texts(ins.progress_insights(rolling, anomalies)) == [
        "Relationship between steps and sleep is getting stronger over time",
        "Relationship between steps and hr is weakening over time",
        "stable",
        "2 recent bp anomalies",
        "7 recent hr anomalies",
    ]


def test_lag_insights(correlations):
    lags = correlations.withColumn("interpretation", F.concat(F.lit("lag "), "pair"))
    assert _texts(ins.lag_insights(lags)) == ["lag steps_vs_sleep", "lag steps_vs_hr"]


def test_buckets(correlations):
    rows = {(r["participant_id"], r["pair"]): r for r in rep.with_pattern_texts(rep.correlation_buckets(correlations)).collect()}
    assert rows["p", "steps_vs_sleep"]["bucket"] == "strong_positive"
    assert rows["p", "steps_vs_hr"]["bucket"] == "strong_negative"
    assert rows["p", "steps_vs_bp"]["bucket"] == "moderate"
    assert ("p", "steps_vs_temp") not in rows
    assert rows["p", "steps_vs_sleep"]["badge_text"] == "✓ Statistically Strong"
    assert rows["p", "steps_vs_sleep"]["explanation"].startswith("These metrics move together")
    assert {k[1]: r["shown"] for k, r in rows.items() if k[0] == "q"} == {
        "steps_vs_hr": True, "hr_vs_temp": True, "steps_vs_bp": True, "steps_vs_sleep": False,
    }
    top = rep.top_weak_correlations(rep.correlation_buckets(correlations)).where("participant_id = 'q'")
    assert [r["pair"] for r in top.orderBy("place").collect()] == ["steps_vs_hr", "hr_vs_temp", "steps_vs_bp"]


def test_cards_and_counts(correlations):
    cards = {(r["participant_id"], r["pair"]): r for r in rep.correlation_cards(correlations).collect()}
    first = cards["p", "steps_vs_sleep"]
    assert (first["significance_badge"], first["strength"], first["sample_note"]) == ("Significant", "Strong", "good")
    assert first["interpretation"] == (
        "There is a strong positive relationship between steps and sleep (r=0.710, p=0.0010). This relationship is "
        "statistically significant. This suggests that more physical activity might be associated with better sleep "
        "patterns. Good sample size supports reliable conclusions."
    )
    third = cards["p", "steps_vs_bp"]
    assert third["significance_badge"] == "Marginal" and third["interpretation"] == (
        "The analysis shows a weak positive trend between steps and bp (r=0.310), but this relationship is marginally "
        "significant (p=0.0800). This could be due to chance or insufficient data. Note: Small sample size limits "
        "reliability of results."
    )
    counts = {r["participant_id"]: r for r in rep.correlation_counts(correlations).collect()}
    assert (counts["p"]["total_tests"], counts["p"]["significant_count"], counts["p"]["potential_trends"]) == (4, 2, 2)
    ranked = rep.ranked_correlations(correlations).where("participant_id = 'p'").orderBy("rank").collect()
    assert [r["pair_order"] for r in ranked] == [0, 1, 2, 3]


def test_matrix(correlations):
    rows = {r["metric_type"]: r for r in rep.correlation_matrix(correlations).where("participant_id = 'p'").collect()}
    assert set(rows) == {"steps", "sleep", "hr", "bp", "temp"}
    assert rows["sleep"]["steps"] == rows["steps"]["sleep"] == 0.71
    assert rows["hr"]["hr"] == 1.0 and rows["hr"]["temp"] == 0.0


def test_first_anomalies(spark):
    days = spark.createDataFrame(
        [("p", "hr", dt.date(2024, 1, i), float(i)) for i in (9, 2, 5, 7, 3)],
        "participant_id string, metric_type string, date date, value double",
    )
    rows = rep.first_anomalies(days).orderBy("place").collect()
    assert [(r["date"].day, r["more"]) for r in rows] == [(2, 2), (3, 2), (5, 2)]


def test_availability(spark):
    df = spark.range(3)
    rows = {r["source"]: r["available"] for r in rep.source_availability({"a": df, "b": df.where("id > 9")}).collect()}
    assert rows == {"a": True, "b": False}
