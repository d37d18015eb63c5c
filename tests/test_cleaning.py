import datetime as dt

from pyspark.sql import functions as F

from vitaframe.config import DEFAULTS, GOOD
from vitaframe.operators import cleaning as cl
from vitaframe.operators import noise as no
from vitaframe.operators import quality as qu
from vitaframe.operators import records as rec
from vitaframe.session import stage_table

T = dt.datetime(2024, 3, 1, 8)


def _at(i):
    return T + dt.timedelta(hours=i)


def _flags(df):
    return [r["quality_flag"] for r in df.orderBy("row_pos").collect()]


def test_duplicates(make_records):
    rows = [
        ("a", "bp", _at(0), 120.0, None),
        ("a", "bp", _at(0), 120.0, None),  # copy, secondary value missing in both
        ("a", "bp", _at(0), 120.0, 0.0),  # not a copy: 0 is not missing
        ("b", "bp", _at(0), 120.0, None),  # other participant
        ("a", "hr", _at(0), 120.0, None),  # other metric
        ("a", "bp", _at(1), 120.0, None),  # other time
        ("a", "bp", _at(0), 120.0, None),  # third copy
    ]
    assert _flags(cl.flag_duplicates(make_records(rows))) == [
        GOOD, "duplicate", GOOD, GOOD, GOOD, GOOD, "duplicate",
    ]


def test_duplicates_take_one_shuffle(make_records):
    """Records are neither grouped beside themselves nor joined back; unknown readings are no copies."""
    rows = [("a", "hr", _at(0), 5.0), ("a", "hr", _at(0), 5.0), ("", "hr", _at(0), 5.0), ("", "hr", _at(0), 5.0)]
    records = make_records(rows).withColumn("participant_id", F.expr("nullif(participant_id, '')"))
    flagged = cl.flag_duplicates(records)
    assert _flags(flagged) == [GOOD, "duplicate", GOOD, GOOD]
    # The same place twice is one reading that came twice, not a copy of it.
    assert _flags(cl.flag_duplicates(records.withColumn("row_pos", F.lit(0).cast("long")))) == [GOOD] * 4
    plan = flagged._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Join" not in plan and "Aggregate" not in plan


def test_distinct_epochs_within_a_microsecond_are_no_copies(make_records):
    from pyspark.sql import functions as F

    rows = make_records([("a", "bp", _at(0), 120.0), ("a", "bp", _at(0), 120.0)])
    rows = rows.withColumn("epoch_raw", F.col("epoch_raw") + F.col("row_pos"))
    assert _flags(cl.flag_duplicates(rows)) == [GOOD, GOOD]


def test_ranges(make_records):
    rows = [
        ("a", "bp", _at(0), 120.0, 80.0),
        ("a", "bp", _at(1), 79.9, 60.0),
        ("a", "bp", _at(2), 120.0, 131.0),
        ("a", "bp", _at(3), 100.0, 100.0),  # systolic must exceed diastolic
        ("a", "bp", _at(4), 120.0, 0.0),  # 0 counts as not measured
        ("a", "bp", _at(5), 120.0, None),
        ("a", "sleep", _at(6), 24.0),
        ("a", "sleep", _at(7), 24.1),
        ("a", "steps", _at(8), -1.0),
        ("a", "temp", _at(9), 105.0, 500.0),  # secondary ranges apply to bp only
    ]
    assert _flags(cl.flag_out_of_range(make_records(rows))) == [
        GOOD, "invalid", "invalid", "invalid", GOOD, GOOD, GOOD, "invalid", "invalid", GOOD,
    ]


def test_outliers_need_five_good_readings(make_records):
    four = [("a", "hr", _at(i), v) for i, v in enumerate([70, 71, 72, 200])]
    five = [("b", "hr", _at(i), v) for i, v in enumerate([70, 71, 72, 73, 200])]
    constant = [("c", "hr", _at(i), 70) for i in range(6)]
    flat = [("d", "hr", _at(i), v) for i, v in enumerate([70, 70, 70, 70, 70, 70, 71])]
    rows = [(p, m, t, float(v)) for p, m, t, v in four + five + constant + flat]
    flags = _flags(cl.clean(make_records(rows)))
    assert flags[:4] == [GOOD] * 4
    assert flags[4:9] == [GOOD] * 4 + ["outlier"]
    assert flags[9:15] == [GOOD] * 6
    assert flags[15:] == [GOOD] * 6 + ["outlier"]  # zero fence width: any other value


def test_secondary_outliers_follow_their_own_row(make_records):
    seconds = [80.0, None, 81.0, 80.0, None, 79.0, 81.0, 120.0]
    rows = [("a", "bp", _at(i), 121.0 + i % 3, s) for i, s in enumerate(seconds)]
    assert _flags(cl.clean(make_records(rows))) == [GOOD] * 7 + ["outlier"]


def test_outliers_ignore_flagged_readings(make_records):
    rows = [("a", "hr", _at(i), float(v)) for i, v in enumerate([70, 71, 72, 73, 74, 500, 500])]
    assert _flags(cl.clean(make_records(rows))) == [GOOD] * 5 + ["invalid"] * 2


def test_missing_wins(make_records):
    rows = [("a", "hr", _at(0), None), ("a", "hr", _at(1), float("nan")), ("a", "hr", _at(2), 70.0)]
    assert _flags(cl.clean(make_records(rows))) == ["missing", "missing", GOOD]


def test_sleep_minutes_as_in_the_first_results(make_records):
    """Minutes judged as hours: five of 74 distinct rows stay, 124 are copies."""
    distinct = [0.0, 0.0, 2.5, 5.0, 5.0] + [30.0 + i for i in range(69)]
    rows = [("p", "sleep", _at(i), v) for i, v in enumerate(distinct)]
    rows += [rows[i % 74] for i in range(124)]
    cleaned = cl.clean(make_records(rows))
    stats = cl.cleaning_stats(cleaned).first()
    assert (stats["total_records"], stats[GOOD], stats["invalid"], stats["duplicate"]) == (198, 5, 69, 124)


def test_one_participant_with_a_third_of_all_rows(make_records):
    """A hot participant, and a hot group of copies, give the same flags."""
    rows = [("hot", "hr", _at(i), 60.0 + i % 40) for i in range(600)] + [("hot", "hr", _at(9999), 200.0)]
    rows += [("copies", "hr", _at(0), 77.0)] * 400
    for p in range(60):
        rows += [(f"p{p}", "hr", _at(i), 60.0 + (i * 7 + p) % 40) for i in range(10)]
    cleaned = cl.clean(make_records(rows))
    got = {(r["participant_id"], r["quality_flag"]): r["count"] for r in
           cleaned.groupBy("participant_id", "quality_flag").count().collect()}
    assert got["hot", "outlier"] == 1 and got["hot", GOOD] == 600
    assert got["copies", GOOD] == 1 and got["copies", "duplicate"] == 399
    assert all(got[f"p{p}", GOOD] == 10 for p in range(60))


def test_quality_reports(make_records):
    rows = [
        ("a", "hr", _at(0), 70.0, None, "good"),
        ("a", "hr", _at(1), 70.0, None, "outlier"),
        ("a", "bp", _at(30), 70.0, None, "good"),
        ("b", "hr", _at(80), 70.0, None, "invalid"),
    ]
    reports = qu.quality_reports(make_records(rows))
    overall = reports["overall_stats"].first()
    assert (overall["total_records"], overall["total_participants"], overall["total_metrics"]) == (4, 2, 2)
    assert overall["good_data_percentage"] == 50.0 and overall["outlier"] == 1
    assert reports["temporal_range"].first()["days"] == 4
    # One pass gives what every report gives on its own.
    own = {
        "overall_stats": qu.overall_quality, "participant_stats": qu.participant_quality,
        "metric_stats": qu.metric_quality, "temporal_range": qu.date_range,
        "temporal_stats": qu.daily_quality, "quality_flags_distribution": qu.flag_distribution,
    }
    for name, report in own.items():
        alone = report(make_records(rows))
        assert sorted(map(str, reports[name].select(alone.columns).collect())) == sorted(map(str, alone.collect()))
    empty = make_records(rows).where("false")
    assert all(df.count() == 0 for df in qu.quality_reports(empty).values())
    assert qu.overall_quality(empty).count() == 0 and qu.date_range(empty).count() == 0


def test_payload_stays_out_of_exchanges(spark, make_records):
    """Unit and metadata take no part in flagging, and come back by the record's place."""
    rows = [("a", "hr", _at(i // 2), 60.0 + i // 2) for i in range(20)]
    records = make_records(rows).withColumn("metadata", F.create_map(F.lit("n"), F.col("row_pos").cast("string"))).withColumn("unit", F.lit("bpm"))
    records = stage_table(records, "records")
    cleaned = cl.clean(records)
    assert not {"metadata", "unit"} & set(cleaned.columns)
    slim = cl.flag_duplicates(cl.without_payload(records))
    slim.collect()
    # Not even read.
    plan = slim._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "metadata" not in plan
    whole = cl.with_payload(cleaned, records).orderBy("row_pos").collect()
    assert [(r["metadata"]["n"], r["unit"], r["quality_flag"]) for r in whole] == [
        (str(i), "bpm", "duplicate" if i % 2 else GOOD) for i in range(20)
    ]
    assert cl.with_payload(cleaned, records).columns == records.columns


def test_the_first_copy_is_the_one_of_the_first_file(make_records):
    rows = [("a", "hr", _at(0), 60.0)] * 4
    records = make_records(rows).withColumn("source_file", F.when(F.col("row_pos") < 2, "b.csv").otherwise("a.csv"))
    records = records.withColumn("row_pos", F.col("row_pos") % 2)
    got = {(r["source_file"], r["row_pos"]): r["quality_flag"] for r in cl.flag_duplicates(records).collect()}
    assert got == {("a.csv", 0): GOOD, ("a.csv", 1): "duplicate", ("b.csv", 0): "duplicate", ("b.csv", 1): "duplicate"}


def test_collections(make_records):
    df = make_records([("a", "hr", _at(i), 70.0) for i in range(3)])
    assert rec.between_dates(df, _at(0), _at(1)).count() == 2
    assert rec.append_records(df, df.drop("unit")).count() == 6


def _clusters(make_records, hours):
    rows = [("a" if i % 2 else "b", "hr", _at(h), 1.0, None, "outlier") for i, h in enumerate(hours)]
    return no.outlier_clustering(make_records(rows)).first()


def test_outlier_clustering(make_records):
    one = _clusters(make_records, [5])
    assert one["clustering_detected"] is False and one["clustering_ratio"] is None
    # Gaps 0, 0.5, 24, 47.5 hours, over both participants and over hour borders.
    got = _clusters(make_records, [0, 0, 0.5, 24.5, 72])
    assert got["clustering_detected"] and got["clustering_ratio"] == 0.75
    assert got["mean_gap_hours"] == 18.0 and got["median_gap_hours"] == 12.25
    far = _clusters(make_records, [0, 100, 200, 300])
    assert not far["clustering_detected"] and far["clustering_ratio"] == 0.0


def test_noise(make_records):
    rows = [("a", "hr", _at(i), v, None, f) for i, (v, f) in enumerate([(0.0, "good"), (0.0, "good"), (9.0, "outlier")])]
    r = no.metric_noise(make_records(rows)).first()
    assert r["good_cv"] == 0.0 and r["outlier_std"] == 0.0 and round(r["noise_ratio"], 3) == 0.333


def test_settings_lookup(make_records):
    r = cl.range_lookup(make_records([("a", "spo2", _at(0), 97.0)])).first()
    assert (r["low"], r["high"], r["config_unit"], r["expected_per_day"]) == (80.0, 100.0, "%", 8)
    assert DEFAULTS.metrics["hr"].expected_per_day == 24


def test_hot_participant_is_split(spark, make_records):
    """The join that brings the limits back is split for a participant with most rows."""
    from pyspark.sql import functions as F

    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    base = make_records([("p", "hr", _at(0), 70.0)])
    rows = (
        spark.range(0, 60_000, 1, 8)
        .withColumn("who", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 400))
        .select(
            F.concat(F.lit("p"), F.col("who")).alias("participant_id"),
            F.lit("hr").alias("metric_type"),
            F.timestamp_seconds(F.col("id")).alias("datetime"),
            F.col("id").alias("epoch_raw"),
            (F.col("id") % 97 + 60.0).alias("value_1"),
            F.lit(None).cast("double").alias("value_2"),
            F.lit("").alias("unit"),
            F.create_map().cast("map<string,string>").alias("metadata"),
            F.lit(GOOD).alias("quality_flag"),
            F.md5(F.col("id").cast("string")).alias("source_file"),
            F.col("id").alias("row_pos"),
        )
        .select(base.columns)
    )
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        flagged = cl.flag_outliers(rows)
        assert flagged.count() == 60_000
        flagged = cl.flag_outliers(rows)
        flagged.collect()
        plan = flagged._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
