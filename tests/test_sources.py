import json
import os
from collections import Counter

import pytest
from conftest import DAY, T0, write_csv, write_json
from pyspark.sql import functions as F

from vitaframe.operators import quality as qu
from vitaframe.operators import records as rec
from vitaframe.plans.full_run import run_all
from vitaframe.sources import files as fs
from vitaframe.sources import standardize as sd
from vitaframe.sources.sinks import write_participant_documents, write_table


def test_discovery(spark, export_dir):
    files = fs.discover_files(spark, export_dir).collect()
    got = Counter((f["participant_id"], f["metric_type"]) for f in files)
    assert got == {
        ("participant-default", "bp"): 2,
        ("participant-default", "sleep"): 2,
        ("participant-default", "hr"): 1,
        ("participant-default", "spo2"): 1,
        ("participant-default", "temp"): 2,
        ("participant-7", "steps"): 1,
        ("participant-a", "steps"): 1,
    }
    span = fs.file_date_range(fs.discover_files(spark, export_dir)).first()
    assert (str(span["start"]), str(span["end"]), span["span_days"]) == (
        "2024-12-12", "2025-02-08", 57,
    )


def test_availability(spark, export_dir):
    summary = qu.participant_files(fs.discover_files(spark, export_dir))
    row = summary.where("participant_id = 'participant-default'").first()
    assert row["total_files"] == 8 and row["has_bp"] and not row["has_steps"]
    histogram = {r["total_files"]: r["participants"] for r in qu.file_count_histogram(summary).collect()}
    assert histogram == {8: 1, 1: 2}
    seen = {r["metric_type"]: r["participants"] for r in qu.metric_availability(summary).collect()}
    assert seen == {"bp": 1, "sleep": 1, "steps": 2, "hr": 1, "spo2": 1, "temp": 1}


def test_records(spark, export_dir):
    rows = fs.read_records(spark, export_dir).collect()
    by = Counter((r["participant_id"], r["metric_type"]) for r in rows)
    assert by == {
        ("participant-default", "bp"): 8,
        ("participant-default", "sleep"): 6,
        ("participant-default", "hr"): 2,
        ("participant-default", "spo2"): 3,
        ("participant-default", "temp"): 4,
        ("participant-7", "steps"): 6,
        ("participant-a", "steps"): 1,
    }
    assert len({(r["source_file"], r["row_pos"]) for r in rows}) == len(rows)
    sleep = sorted(r["value_1"] for r in rows if r["metric_type"] == "sleep")
    assert sleep == pytest.approx(sorted([312 / 60, 301 / 60, 302 / 60] * 2))
    hr = {r["value_1"]: r["value_2"] for r in rows if r["metric_type"] == "hr"}
    assert hr == {61.0: 70.0, 66.0: 71.0}
    bp = [r for r in rows if r["metric_type"] == "bp" and r["value_1"] == 119]
    assert all(r["value_2"] is None for r in bp)
    assert all(r["epoch_raw"] > 1_000_000 for r in rows if r["metric_type"] == "steps" and r["participant_id"] == "participant-7")


def test_records_of_very_many_headers(spark, tmp_path):
    root = str(tmp_path / "in")
    for i in range(300):
        row = {"logDateTime": T0 + i * DAY, f"extra{i}": f'a,"{i}"', "steps": 100 + i, "distance": i}
        names = list(row) if i % 2 else list(row)[::-1]
        write_csv(f"{root}/participant-{i % 7}/steps_{1734000000 + i}.csv", [{n: row[n] for n in names}] * 2)
    rows = fs.read_records(spark, root).collect()
    assert sorted((r["epoch_raw"], r["value_1"], r["value_2"]) for r in rows) == [
        (T0 + i * DAY, 100.0 + i, float(i)) for i in range(300) for _ in range(2)
    ]
    assert len({(r["source_file"], r["row_pos"]) for r in rows}) == 600


def test_positions_rise_within_a_file_of_many_parts(spark, tmp_path):
    root = str(tmp_path / "in")
    write_csv(f"{root}/physio_data/steps_1.csv", [{"logDateTime": T0 + i, "steps": i} for i in range(40_000)])
    write_csv(f"{root}/physio_data/steps_2.csv", [{"logDateTime": T0 + i, "steps": i} for i in range(10)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        rows = fs.read_records(spark, root).where("source_file like '%steps_1.csv'").orderBy("row_pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert [r["value_1"] for r in rows] == [float(i) for i in range(40_000)]
    assert len({r["row_pos"] for r in rows}) == 40_000


@pytest.fixture
def raw_reads(monkeypatch):
    """The paths that readers of text, JSON and CSV are given."""
    from pyspark.sql import DataFrameReader

    seen = []
    for name in ("text", "json", "csv"):
        plain = getattr(DataFrameReader, name)

        def noted(self, path, *args, plain=plain, **more):
            seen.append(path)
            return plain(self, path, *args, **more)

        monkeypatch.setattr(DataFrameReader, name, noted)
    return seen


def test_each_file_is_read_once(spark, export_dir, tmp_path, raw_reads):
    rows = fs.read_records(spark, export_dir)
    # Lines of CSV and whole files of JSON: one read of the folder for either kind.
    assert [p for p in raw_reads if str(p).startswith(export_dir)] == [export_dir, export_dir]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [value") == 1  # JSON; lines of CSV come from the shared folder
    one = str(tmp_path / "one.json")
    write_json(one, [{"a": 1, "b": {"c": 2.5}}, {"a": 2, "b": {"c": None}}])
    raw_reads.clear()
    df = fs.load_json(spark, one)
    os.remove(one)
    assert sorted(map(tuple, df.select("a", "`b.c`").collect())) == [(1, 2.5), (2, None)] and raw_reads.count(one) == 1
    given = str(tmp_path / "given.json")
    write_json(given, [{"a": 1}])
    assert fs.load_json(spark, given, "a string, z int").collect() == [("1", None)]


def test_a_column_counts_by_name(spark, tmp_path):
    """The first candidate column is taken though it holds nothing but nulls."""
    root = str(tmp_path / "in")
    both = [{"createdTime": T0 + i, "temperature": None, "temp": 98.0} for i in range(2)]
    write_json(f"{root}/physio_data/temperature_1.json", both)
    write_json(f"{root}/physio_data/temperature_2.json", [{"createdTime": T0, "temp": 99.0}])
    write_json(f"{root}/physio_data/spo2_3.json", {"createdTime": [T0, T0 + 1], "spo2": [95, 96], "device": "d"})
    write_json(f"{root}/physio_data/spo2_4.json", {"createdTime": [T0], "spo2": [95, 96]})
    write_json(f"{root}/physio_data/spo2_5.json", [{"createdTime": float(T0) + 7, "spo2": "97"}, 5, None])
    write_json(f"{root}/physio_data/spo2_6.json", [])
    for name, text in (("7", ""), ("8", "\ufeff \n [{\"createdTime\": 1734000009, \"spo2\": 9.8e1}]"), ("9", "[{\"a\": "), ("10", "7")):
        with open(f"{root}/physio_data/spo2_{name}.json", "w") as f:
            f.write(text)
    rows = sorted((r["metric_type"], r["epoch_raw"], r["value_1"]) for r in fs.read_records(spark, root).collect())
    assert rows == [("spo2", T0, 95.0), ("spo2", T0 + 1, 96.0), ("spo2", T0 + 7, 97.0), ("spo2", 1734000009, 98.0), ("temp", T0, 99.0)]


def test_parity_mode(spark, export_dir):
    rows = fs.read_records(spark, export_dir, mode="parity").collect()
    assert not [r for r in rows if r["metric_type"] == "spo2"]
    sleep = {r["value_1"] for r in rows if r["metric_type"] == "sleep"}
    assert sleep == {312.0, 301.0, 302.0}
    assert {r["datetime"].year for r in rows if r["participant_id"] == "participant-default"} == {1970}


def test_expanded_sessions(spark, export_dir):
    rows = fs.read_records(spark, export_dir, expand_sessions=True)
    hr = rows.where("metric_type = 'hr'").collect()
    assert len(hr) == 3  # two readings of one session and a session without any


def test_load_file(spark, tmp_path, export_dir):
    one = fs.load_file(spark, f"{export_dir}/physio_data/bp_1734000001.csv")
    assert one.count() == 5 and "systolic" in one.columns
    assert fs.load_file(spark, str(tmp_path / "missing.csv")).columns == []
    assert fs.load_file(spark, str(tmp_path / "x.txt")).columns == []
    nested = str(tmp_path / "n.json")
    write_json(nested, [{"a": {"b": 1, "c": {"d": 2}}, "e": 3}])
    assert sorted(fs.load_file(spark, nested).columns) == ["a.b", "a.c.d", "e"]
    arrays = str(tmp_path / "p.json")
    write_json(arrays, {"timestamps": [1, 2], "values": [3.0, 4.0]})
    assert fs.load_file(spark, arrays).count() == 2
    uneven = str(tmp_path / "u.json")
    write_json(uneven, {"timestamps": [1, 2], "values": [3.0]})
    assert fs.load_file(spark, uneven).count() == 0
    broken = str(tmp_path / "b.json")
    with open(broken, "w") as f:
        f.write("{not json")
    assert fs.load_file(spark, broken).columns == []


def test_empty_folder(spark, tmp_path):
    os.makedirs(tmp_path / "in" / "physio_data")
    assert fs.read_records(spark, str(tmp_path / "in")).count() == 0
    assert fs.read_meals(spark, str(tmp_path / "in")).count() == 0


def test_unnest_only_column(spark):
    df = spark.createDataFrame([([{"t": 1, "v": 2.0}, {"t": 2, "v": 3.0}],)], "items array<struct<t:int,v:double>>")
    assert [tuple(r) for r in sd.unnest_only_column(df, "items").collect()] == [(1, 2.0), (2, 3.0)]
    df = spark.createDataFrame([((1, (2, 3)),)], "o struct<a:int,b:struct<c:int,d:int>>")
    assert sd.unnest_only_column(df, "o").columns == ["a", "b.c", "b.d"]


def test_declared_tables(spark):
    df = spark.createDataFrame(
        [("2024-01-01 10:00:00", "80", None, "d1"), ("2024-01-01 11:00:00", "x", "60", "d2"),
         ("bad", "70", "60", "d3"), ("2024-01-01 12:00:00", None, "61", "d4")],
        "datetime string, heart_rate string, resting_hr string, device string",
    )
    rows = sd.standardize_declared(df, "p1", "hr", tz="Asia/Kolkata").orderBy("datetime").collect()
    assert [(r["value_1"], r["value_2"], r["metadata"]["device"]) for r in rows] == [
        (80.0, None, "d1"), (None, 61.0, "d4"),
    ]
    assert rows[0]["datetime"].hour == 4 and rows[0]["unit"] == "bpm"
    with pytest.raises(ValueError):
        sd.standardize_declared(df, "p1", "weight")
    found = [r["problem"] for r in sd.validate_table(df, "hr").collect()]
    assert found == ["Invalid datetime format: 1 rows"]
    assert sd.validate_table(df.drop("datetime"), "bp").first()["problem"] == (
        "Missing required columns: datetime, diastolic, systolic"
    )


def test_flat_table(spark):
    rows = [("1", "a", "60"), ("2", None, "61")]
    df = spark.createDataFrame(rows, "heart_rate string, device string, device_id string").withColumn(
        "datetime", F.lit("2024-01-01")
    )
    records = sd.standardize_declared(df, "p", "hr")
    named = rec.flat_table(records, rec.metadata_keys(records))
    assert "device" in named.columns and named.where("device = 'a'").count() == 1
    # Without keys nothing is asked of the data: declared columns, and the rest by path.
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    flat = rec.flat_table(records)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert "device" not in flat.columns and {"pulse", "device_id", "other"} <= set(flat.columns)
    got = flat.select("device_id", F.variant_get("other", "$.device", "string"), F.to_json("other"), "pulse").collect()
    assert sorted(map(tuple, got)) == [("60", "a", '{"device":"a"}', None), ("61", None, '{"device":null}', None)]
    bare = rec.flat_table(records.withColumn("metadata", F.lit(None).cast("map<string,string>")))
    assert {r["v"] for r in bare.select(F.to_json("other").alias("v")).collect()} == {"{}"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("participant-a", 1), ("participant-b", 2)], "participant_id string, n int")
    path = write_table(df, str(tmp_path), "t")
    write_table(df, str(tmp_path), "t")
    assert spark.read.json(path).count() == 2
    out = str(tmp_path / "docs")
    write_participant_documents(df, out, file_per_participant=True)
    assert {"patient=a", "patient=b"} <= set(os.listdir(out))


def test_whole_run(spark, export_dir, tmp_path):
    out = str(tmp_path / "out")
    run_all(spark, export_dir, out)
    results = [json.loads(r["document"]) for r in spark.read.json(f"{out}/analysis_results").collect()]
    assert {d["participant_id"] for d in results} == {"participant-default", "participant-7", "participant-a"}
    steps = next(d for d in results if d["participant_id"] == "participant-7")
    assert steps["health_baselines"][0]["mean"] == 2500.0
    assert steps["generated_at"][4] == "-" and steps["data_period"] is None
    flags = {r["metric_type"]: r for r in spark.read.json(f"{out}/cleaning_report/metric_stats").collect()}
    # The second file is a copy: four duplicates; 300 is out of range, 0 means not measured.
    assert (flags["bp"]["duplicate"], flags["bp"]["invalid"], flags["bp"]["good"]) == (4, 1, 3)
    heads = {r["title"]: r["text"] for r in spark.read.json(f"{out}/report/headlines").collect()}
    assert heads["FEV1"] == "3.20" and heads["Calories"] == "N/A" and heads["SpO2"] == "96"
    dishes = [r["dish"] for r in spark.read.json(f"{out}/report/top_dishes").collect()]
    assert sorted(dishes) == ["Bread", "Rice", "Soup", "Tea"]


def test_mixed_json_columns(spark, tmp_path):
    root = str(tmp_path / "in")
    write_json(f"{root}/physio_data/temperature_1.json", [{"createdTime": T0, "temperature": 98.0}])
    write_json(f"{root}/physio_data/temperature_2.json", [{"logDate": T0 + DAY, "temp": 99.0}])
    write_csv(f"{root}/physio_data/bp_1.csv", [{"when": 1, "systolic": 2}])
    nested = [{"data": [{"createdTime": T0 + 2 * DAY, "spo2": 97}, {"createdTime": T0 + 3 * DAY, "spo2": 98}]}]
    write_json(f"{root}/physio_data/spo2_3.json", nested)
    rows = fs.read_records(spark, root).orderBy("epoch_raw").collect()
    assert [(r["epoch_raw"], r["value_1"]) for r in rows] == [
        (T0, 98.0), (T0 + DAY, 99.0), (T0 + 2 * DAY, 97.0), (T0 + 3 * DAY, 98.0),
    ]


def test_epochs_no_timestamp_can_hold_become_null(spark):
    from vitaframe.sources.standardize import parse_datetime

    df = spark.createDataFrame([("1734445125000000000",), ("99999999999999",), ("1734445125",)], "t string")
    got = [r[0] for r in df.select(parse_datetime(df["t"])).collect()]
    assert got[:2] == [None, None] and got[2] is not None


def test_two_staged_tables_of_one_name_do_not_meet(spark):
    from vitaframe.session import stage_table

    one, two = stage_table(spark.range(3), "same"), stage_table(spark.range(5), "same")
    assert one.count() == 3 and two.count() == 5


def test_a_rewritten_table_is_read_anew(spark, tmp_path):
    from vitaframe.plans.workspace import event_workspace

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path)
    events.limit(50).write.parquet(f"{folder}/events.parquet")
    one = event_workspace(spark, folder)
    assert event_workspace(spark, folder) is one
    n = one["cleaned"].count()
    events.limit(200).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    two = event_workspace(spark, folder)
    assert two is not one and two["cleaned"].count() > n
