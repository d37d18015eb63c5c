"""Daily values, correlations, anomalies and deviations against brute force."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest

from vitaframe.config import CORRELATION_PAIRS, METRICS, PARITY_DEVIATION_LIMITS, Settings
from vitaframe.functions.order_stats import band_edges
from vitaframe.operators import anomalies as an
from vitaframe.operators import compliance as cm
from vitaframe.operators import correlation as co
from vitaframe.operators import daily as da
from vitaframe.operators import deviations as de
from vitaframe.operators import meals as me
from vitaframe.operators import noise as no
from vitaframe.operators import statistics as st

D0 = dt.datetime(2024, 1, 1, 9)


def day(n, hour=0):
    return D0 + dt.timedelta(days=n, hours=hour)


def ranks(values):
    a = np.array(values)
    return [((a < v).sum() + 1 + (a <= v).sum()) / 2 for v in a]


def corr(x, y):
    x, y = np.array(x, float), np.array(y, float)
    if x.std() == 0 or y.std() == 0:
        return None
    return float(np.corrcoef(x, y)[0, 1])


def cohort(seed=3, people=6):
    """Participants with gaps, ties, a constant metric and different lengths."""
    rng = random.Random(seed)
    rows, daily = [], {}
    for p in range(people):
        pid = f"p{p}"
        days = [5, 7, 18, 19, 33, 40][p % 6]
        offsets = sorted(rng.sample(range(days + 6), days))
        for d in offsets:
            for m in METRICS:
                if m == "spo2" and p % 2:
                    continue
                if rng.random() < 0.2 and m != "steps":
                    continue
                vs = [float(rng.randint(1, 6)) for _ in range(rng.randint(1, 3))]
                if m == "temp" and p == 4:
                    vs = [98.0]
                for i, v in enumerate(vs):
                    rows.append((pid, m, day(d, i), v))
                value = sum(vs) if m == "steps" else sum(vs) / len(vs)
                daily.setdefault(pid, {}).setdefault(d, {})[m] = value
    return rows, daily


@pytest.fixture(scope="module")
def data():
    return cohort()


@pytest.fixture
def daily(data, make_records):
    return da.daily_wide(make_records(data[0])).cache()


def _pairs(days, lag):
    order = sorted(days)
    for m1, m2 in CORRELATION_PAIRS:
        xs, ys = [], []
        for i, d in enumerate(order):
            other = days[d] if not lag else (days[order[i + 1]] if i + 1 < len(order) else {})
            if m1 in days[d] and m2 in other:
                xs.append(days[d][m1])
                ys.append(other[m2])
        yield m1, m2, xs, ys


@pytest.mark.parametrize("lag", [False, True])
def test_correlations(data, daily, lag):
    build = co.lag_correlations if lag else co.daily_correlations
    got = {(r["participant_id"], r["metric_1"], r["metric_2"]): r for r in build(daily).collect()}
    expected = {}
    for pid, days in data[1].items():
        if len(days) < 7:
            continue
        for m1, m2, xs, ys in _pairs(days, lag):
            if len(xs) >= 5:
                expected[pid, m1, m2] = (len(xs), corr(xs, ys), corr(ranks(xs), ranks(ys)))
    assert set(got) == set(expected) and len(got) > 20
    for key, (n, r, rho) in expected.items():
        row = got[key]
        assert row["n_days"] == n
        for value, wanted in ((row["pearson_r"], r), (row["spearman_r"], rho)):
            assert (value is None and wanted is None) or value == pytest.approx(wanted, abs=1e-9)
        if r is None:
            assert row["pearson_p"] is None and row["pearson_significant"] is False
            assert row["interpretation"].startswith("No significant")


def test_rolling(data, daily):
    rolling = co.rolling_correlations(daily).cache()
    got = {(r["participant_id"], r["date"], r["metric_1"], r["metric_2"]): r for r in rolling.collect()}
    expected = {}
    for pid, days in data[1].items():
        order = sorted(days)
        if len(order) < 19:
            continue
        measured = {m for d in days.values() for m in d}
        for i in range(14, len(order)):
            window = [days[d] for d in order[i - 14 : i]]
            for m1, m2 in CORRELATION_PAIRS:
                if m1 not in measured or m2 not in measured:
                    continue
                both = [(w[m1], w[m2]) for w in window if m1 in w and m2 in w]
                r = corr(*zip(*both, strict=True)) if len(both) >= 7 else None
                expected[pid, day(order[i]).date(), m1, m2] = (len(both), r)
    assert set(got) == set(expected)
    for key, (n, r) in expected.items():
        assert got[key]["valid_days"] == n
        value = got[key]["r"]
        assert (value is None and r is None) or value == pytest.approx(r, abs=1e-9)

    series = {}
    for (pid, _, m1, m2), (_, r) in sorted(expected.items()):
        series.setdefault((pid, f"{m1}_vs_{m2}"), []).append(r)
    summary = {(r["participant_id"], r["pair"]): r for r in co.rolling_summary(rolling).collect()}
    for key, rs in series.items():
        valid = [r for r in rs if r is not None]
        if not valid:
            assert key not in summary
            continue
        row = summary[key]
        assert len(row["correlations"]) == len(rs)
        assert row["mean_correlation"] == pytest.approx(np.mean(valid))
        if len(valid) < 3:
            assert row["trend"] == "insufficient_data" and row["slope"] is None
        else:
            slope = np.polyfit(range(len(valid)), valid, 1)[0]
            assert row["slope"] == pytest.approx(slope, abs=1e-9)
            wanted = "stable" if abs(slope) <= 0.005 else "strengthening" if slope > 0 else "weakening"
            assert row["trend"] == wanted


def test_anomalies_and_recovery(make_records):
    base = [50.0, 51.0, 49.0, 50.5, 49.5, 50.2, 49.8, 50.1, 49.9, 50.3]
    rows = [("p", "hr", day(i), v) for i, v in enumerate(base)]
    rows += [
        ("p", "hr", day(10), 90.0),  # back in range on day 12, day 11 has no hr
        ("p", "steps", day(11), 10.0),
        ("p", "hr", day(12), 50.0),
        ("p", "hr", day(13), 95.0),  # day 14 has no record at all: not recovered
        ("p", "hr", day(15), 50.0),
        ("p", "hr", day(16), 10.0),  # last day: not recovered
        ("q", "hr", day(0), 1.0),
    ]
    days = da.daily_wide(make_records(rows))
    found = an.anomaly_days(days).cache()
    got = {r["date"].day - 1: r["recovered_after"] for r in found.collect()}
    assert got == {10: 2, 13: None, 16: None}
    summary = an.anomaly_summary(found).first()
    assert summary["anomaly_count"] == 3 and summary["values"] == 15
    assert summary["recovery_rate"] == 33.3 and summary["mean_recovery_days"] == 2.0
    assert summary["anomaly_percentage"] == 20.0
    assert summary["frequency_code"] == "frequent" and summary["recovery_code"] == "slow_recovery"
    assert summary["clustered"] is True  # both gaps are three days
    assert summary["insights"] == [
        "Frequent hr anomalies detected (20% of days)",
        "Slow or incomplete recovery from anomalies",
        "Anomalies tend to cluster together",
    ]
    none = an.recovery_summary(found.where("recovered_after is null")).first()
    assert none["recovery_rate"] == 0.0 and none["mean_recovery_days"] is None


def test_recovery_against_brute_force(data, daily):
    got = {
        (r["participant_id"], r["metric_type"], r["date"]): r["recovered_after"]
        for r in an.anomaly_days(daily, Settings(min_days=1)).collect()
    }
    expected = {}
    for pid, days in data[1].items():
        for m in METRICS:
            series = {d: v[m] for d, v in days.items() if m in v}
            if len(series) < 7:
                continue
            q1, q3 = np.percentile(list(series.values()), [25, 75])
            iqr = q3 - q1
            for d, v in series.items():
                if q1 - 2 * iqr <= v <= q3 + 2 * iqr:
                    continue
                back = None
                for k in range(1, 8):
                    if d + k not in days:
                        break
                    if m in days[d + k] and q1 - 1.5 * iqr <= days[d + k][m] <= q3 + 1.5 * iqr:
                        back = k
                        break
                expected[pid, m, day(d).date()] = back
    assert got == expected


# Few participants are ranked in one place, more than BAND by counted values.
@pytest.mark.parametrize("band", [1 << 16, 2])
def test_cohort_correlations(make_records, monkeypatch, band):
    monkeypatch.setattr(co, "BAND", band)
    rng = random.Random(8)
    rows, means = [], {}
    for p in range(40):
        for m in ("hr", "bp", "steps"):
            if m == "steps" and p >= 4:
                continue  # four participants only: too few
            v = float(rng.randint(60, 70))
            rows.append((f"p{p}", m, day(0), v))
            means.setdefault(m, {})[p] = v
    rows.append(("single", "hr", day(0), 200.0))  # one metric: left out
    got = {r["pair"]: r for r in co.cohort_correlations(make_records(rows)).collect()}
    assert set(got) == {"bp_vs_hr"}
    xs, ys = list(means["bp"].values()), list(means["hr"].values())
    assert got["bp_vs_hr"]["n_participants"] == 40
    assert got["bp_vs_hr"]["pearson_r"] == pytest.approx(corr(xs, ys))
    assert got["bp_vs_hr"]["spearman_r"] == pytest.approx(corr(ranks(xs), ranks(ys)))


def test_z_deviations(make_records):
    rows = [("p", "bp", day(i), 100.0 + (50 if i == 5 else 0), 70.0 if i else None) for i in range(8)]
    rows += [("q", "hr", day(i), 60.0 + i) for i in range(2)]
    rows[0] = (*rows[0], "invalid")  # flags do not matter here
    found = de.z_deviations(make_records(rows)).collect()
    assert [(r["metric"], r["date"].day, r["direction"]) for r in found] == [("systolic", 6, "above")]
    stats = {r["metric"]: r["days"] for r in de.deviation_stats(da.daily_named_means(make_records(rows))).collect()}
    assert stats == {"systolic": 8}  # diastolic is constant, hr has two days


def _meals(spark, rows):
    return spark.createDataFrame(
        [(d, int(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000), p) for d, at, p in rows],
        "dish string, time long, participant_id string",
    )


def test_threshold_deviations_with_meals(spark, make_records):
    rows = [("p", "hr", day(i), 80.0) for i in range(6)] + [("p", "hr", day(6), 101.0), ("p", "hr", day(7), 80.0)]
    rows += [("short", "hr", day(i), 80.0 + 30 * (i % 2)) for i in range(6)]
    found = de.threshold_deviations(make_records(rows)).cache()
    got = [(r["participant_id"], r["date"].day, r["outside_threshold"]) for r in found.collect()]
    assert got == [("p", 7, True)]
    meals = _meals(spark, [("Soup", day(6), "p"), ("Soup", day(6, 2), "p"), ("Tea", day(6), "other"), ("Tea", day(1), "p")])
    joined = de.deviation_days_with_meals(found, meals).collect()
    assert sorted((r["meal_time"], r["dish"], r["servings"], len(r["deviations"])) for r in joined) == [("09:00", "Soup", 1, 1), ("11:00", "Soup", 1, 1)]
    without = de.deviation_days_with_meals(found, meals.where("false")).collect()
    assert [(r["dish"], r["servings"]) for r in without] == [(None, 0)]
    together = de.threshold_deviations(make_records(rows), (), Settings(deviation_limits=PARITY_DEVIATION_LIMITS))
    assert {r["date"].day for r in together.collect()} == {7}


def test_deviating_days_and_their_dishes(spark, make_records):
    rows = [("p", "hr", day(i), 80.0) for i in range(6)] + [("p", "hr", day(6), 101.0), ("p", "hr", day(7), 50.0)]
    rows += [("p", "bp", day(i), 120.0 if i < 6 else 150.0) for i in range(8)]
    found = de.threshold_deviations(make_records(rows))
    meals = _meals(spark, [("Soup", day(6), "p"), ("Soup", day(6), "p"), ("Tea", day(6, 2), "p"), ("Tea", day(6), "q"), ("Tea", day(1), "p")])
    days = {r["day_id"]: r for r in de.deviating_days(found, meals).collect()}
    assert sorted(days) == ["p/2024-01-07", "p/2024-01-08"]
    one, two = days["p/2024-01-07"], days["p/2024-01-08"]
    assert [d["metric_type"] for d in one["deviations"]] == ["bp", "hr"] and (one["meals"], two["meals"]) == (3, 0)
    dishes = de.deviating_day_dishes(found, meals).collect()
    assert sorted((r["day_id"], r["meal_time"], r["dish"], r["servings"]) for r in dishes) == [
        ("p/2024-01-07", "09:00", "Soup", 2), ("p/2024-01-07", "11:00", "Tea", 1),
    ]


def test_deviation_report_names_meals_and_units(spark):
    rows = [(dt.date(2024, 1, d), m, v, 100.0, z, "above") for d, m, v, z in [
        (1, "systolic", 150.4, 2.0), (1, "sleep_duration", 7.25, 1.6), (2, "resting_hr", 61.5, -1.7), (3, "temperature", 98.25, 1.8), (3, "weight", 70.0, 1.8)]]
    found = spark.createDataFrame(rows, "date date, metric string, value double, mean double, z_score double, direction string")
    served = [("Tea", day(0, 2), "p"), ("Rice", day(0), "p"), ("Rice", day(0), "q"), ("Soup", day(0), "p")]
    served += [(f"d{i % 2}", day(2, i % 3), "p") for i in range(70)]
    got = {(r["date"].day, r["metric"]): r for r in de.deviation_report(found, _meals(spark, served)).collect()}
    assert got[1, "systolic"]["meals_text"] == "Rice, Rice, Soup, Tea" and got[1, "systolic"]["meals"] == 4
    assert got[2, "resting_hr"]["meals_text"] == "No meals recorded" and got[2, "resting_hr"]["meals"] == 0
    many = got[3, "weight"]["meals_text"]
    assert many.endswith(" and 20 more") and many.count(", ") == 49 and many.startswith("d0, d0")
    assert [got[k]["display_value"] for k in sorted(got)] == ["7.2 hours", "150 mmHg", "62 bpm", "98.2°C", "70.0"]
    assert got[1, "systolic"]["display_baseline"] == "100 mmHg" and got[1, "systolic"]["severity"] == "severe"


def test_daily_meals(spark):
    meals = _meals(spark, [("Soup", day(0, 3), "p"), ("Tea", day(0), "p"), ("Tea", day(0), "q"), ("Rice", day(0), "p"), ("Tea", day(1), "p")])
    rows = me.daily_meals(meals).orderBy("date", "first_position", "dish").collect()
    assert [(r["date"].day, r["meal_time"], r["dish"], r["servings"], r["first_position"]) for r in rows] == [
        (1, "09:00", "Rice", 1, 1), (1, "09:00", "Tea", 2, 1), (1, "12:00", "Soup", 1, 4), (2, "09:00", "Tea", 1, 1),
    ]
    assert [r["dish"] for r in me.top_dishes(meals).collect()] == ["Tea", "Rice", "Soup"]
    # A meal without a time is kept, and the dish may stand under another name.
    dates = [("Tea", None, dt.date(2024, 1, 1)), ("Rice", 1704096000000, dt.date(2024, 1, 1))]
    other = spark.createDataFrame(dates, "Food string, time long, date date")
    got = sorted((r["meal_time"], r["dish"], r["servings"]) for r in me.daily_meals(other).collect())
    assert got == [("08:00", "Rice", 1), ("Unknown time", "Tea", 1)]
    assert {r["meal_time"] for r in me.dishes_by_day(other).collect()} == {"08:00", "Unknown time"}


def test_meal_interactions(spark, make_records):
    records = make_records([("p", "hr", day(i), 60.0 + i) for i in range(8)])
    meals = _meals(spark, [("Tea", day(i), "p") for i in range(-3, 7)])
    days = da.daily_wide(records, ())
    assert [r["date"].day for r in me.recent_common_dates(meals, days).collect()] == [7, 6, 5, 4, 3]
    rows = me.meal_interactions(meals, days).collect()
    assert {(r["date"].day, r["hr"]) for r in rows} == {(7, 66.0), (6, 65.0), (5, 64.0), (4, 63.0), (3, 62.0)}


def test_compliance(make_records):
    rows = [("p", "steps", day(i), 1.0) for i in (0, 1, 3)]
    rows += [("p", "bp", day(0, i), 120.0) for i in range(3)] + [("p", "hr", day(0), 70.0, None, "outlier")]
    cleaned = make_records(rows)
    got = {r["metric_type"]: r for r in cm.metric_compliance(cleaned).collect()}
    assert len(got) == 6
    assert (got["steps"]["compliance_score"], got["steps"]["missingness_ratio"]) == (75.0, 0.25)
    assert (got["bp"]["compliance_score"], got["bp"]["missingness_ratio"]) == (37.5, 0.625)
    assert (got["hr"]["compliance_score"], got["hr"]["actual_records"]) == (0.0, 1)
    assert (got["spo2"]["compliance_score"], got["spo2"]["missingness_ratio"]) == (0.0, 1.0)
    daily = cm.daily_compliance(cleaned)
    steps = [r["compliance_percentage"] for r in daily.where("metric_type = 'steps'").orderBy("date").collect()]
    assert steps == [100.0, 100.0, 0.0, 100.0]
    assert daily.where("metric_type = 'bp'").agg({"compliance_percentage": "max"}).first()[0] == 100.0
    assert daily.where("metric_type = 'spo2'").count() == 0
    summary = cm.daily_compliance_summary(daily).where("metric_type = 'steps'").first()
    assert summary["mean_compliance"] == 75.0 and summary["median_compliance"] == 100.0
    overall = cm.overall_compliance(cm.metric_compliance(cleaned)).first()
    assert (overall["score"], overall["grade"]) == (18.8, "F")


def test_overall_score_of_the_first_results(spark):
    """Five full metrics and an absent one give 83.3 and a B."""
    scores = spark.createDataFrame(
        [("p", m, 0.0 if m == "spo2" else 100.0) for m in METRICS], "participant_id string, metric_type string, compliance_score double"
    )
    row = cm.overall_compliance(scores).first()
    assert (row["score"], row["grade"]) == (83.3, "B")


def test_statistics_of_the_first_results(make_records):
    rows = [("p", "sleep", day(i), v) for i, v in enumerate([0.0, 0.0, 0.0, 5.0, 5.0])]
    row = st.metric_statistics(make_records(rows)).first()
    assert row["mean"] == 2.0 and round(row["std"], 2) == 2.45
    assert row["iqr"] == 5.0 and row["p90"] == 5.0 and row["secondary_mean"] is None


def test_fuzzy_means(spark):
    lungs = spark.createDataFrame([(3.3, 0.81, None), (3.4, 0.83, None)], "FEV1 double, `FEV1/FVC` double, fat string")
    wanted = {"a": "fev1", "b": "fvc", "c": "fat", "d": "carb"}
    row = st.fuzzy_means(lungs, wanted).first()
    assert row["a"] == pytest.approx(3.35) and row["b"] == pytest.approx(0.82)
    assert row["c"] is None and row["d"] is None
    both = lungs.selectExpr("FEV1", "`FEV1/FVC`", "4.0D as FVC")
    assert st.fuzzy_means(both, {"b": "fvc"}).first()["b"] == 4.0
    assert math.isclose(st.fuzzy_means(both, {"b": "fvc"}, exact_first=False).first()["b"], 0.82)


def test_wide_and_long_inputs(spark):
    wide = spark.createDataFrame(
        [("2024-01-01", 100.0, 60.0), ("2024-01-01", 300.0, None), ("2024-01-02", 50.0, 62.0)],
        "date string, steps double, resting_hr double",
    )
    row = st.headline_means_of_wide(wide).first()
    assert row["avg_steps"] == 150.0 and row["avg_hr"] == 61.0 and row["avg_sleep"] is None
    named = {(r["date"], r["metric"]): r["value"] for r in da.named_means_of_wide(wide).collect()}
    assert named["2024-01-01", "steps"] == 200.0 and named["2024-01-02", "resting_hr"] == 62.0
    long = spark.createDataFrame(
        [("2024-01-01", "steps", 5.0), ("2024-01-01", "steps", 6.0), ("2024-01-01", "hr", 5.0), ("2024-01-01", "hr", 6.0)],
        "date string, metric_type string, value double",
    )
    got = {r["metric_type"]: r["value"] for r in da.daily_values_of_long(long).collect()}
    assert got == {"steps": 11.0, "hr": 5.5}


def test_gaps_of_one_crowded_hour(make_records):
    """All outliers of a metric in one hour are cut into ranges; gaps stay the same."""
    start = dt.datetime(2024, 1, 1)
    rows = [("p", "hr", start + dt.timedelta(seconds=s * 7 % 3000 + (s % 3)), 1.0, None, "outlier") for s in range(1500)]
    rows += [("p", "bp", start, 1.0, None, "outlier"), ("p", "bp", start + dt.timedelta(hours=30), 1.0, None, "outlier")]
    cleaned = make_records(rows)
    keys = ["metric_type"]
    moments = no._outlier_moments(cleaned, keys)
    edges = band_edges(moments, keys, "_micros", 64)
    assert [r["metric_type"] for r in edges.collect()] == ["hr"] and len(edges.first()["_edges"]) > 10
    cut = sorted(map(tuple, no._gaps(moments, keys, edges).collect()))
    assert cut == sorted(map(tuple, no.outlier_gaps(cleaned).collect()))
    at = sorted(r[2] for r in rows if r[1] == "hr")
    expected = Counter((b - a).total_seconds() / 3600 for a, b in zip(at, at[1:], strict=False))
    got = Counter()
    for metric, _, gap, times in cut:
        if metric == "hr":
            got[gap] += times
    assert {round(g * 3600): n for g, n in got.items()} == {round(g * 3600): n for g, n in expected.items()}
