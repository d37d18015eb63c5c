from __future__ import annotations

import csv
import datetime as dt
import json
import os
import sys

import pytest

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [os.path.dirname(HERE), HERE]

from vitaframe.schemas import RECORD_SCHEMA  # noqa: E402
from vitaframe.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "vitaframe-tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_records(spark):
    """Builds records from (participant, metric, datetime, value_1[, value_2[, flag]])."""

    def build(rows):
        out = []
        for i, row in enumerate(rows):
            pid, metric, at, v1, *rest = row
            v2 = rest[0] if rest else None
            flag = rest[1] if len(rest) > 1 else "good"
            if isinstance(at, str):
                at = dt.datetime.fromisoformat(at)
            at = at.replace(tzinfo=dt.timezone.utc)
            epoch = int(at.timestamp())
            out.append((pid, metric, at, epoch, v1, v2, "", {}, flag, "f", i))
        return spark.createDataFrame(out, RECORD_SCHEMA)

    return build


def write_csv(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        writer = csv.DictWriter(f, fieldnames=list(rows[0]))
        writer.writeheader()
        writer.writerows(rows)


def write_json(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(data, f)


T0 = 1_734_000_000  # 2024-12-12 10:40:00 UTC
DAY = 86_400


@pytest.fixture(scope="session")
def export_dir(tmp_path_factory):
    """Invented exports in every shape the loader has to know."""
    root = str(tmp_path_factory.mktemp("input"))
    bp = [
        {"l_activityid": i, "logDate": T0, "createdTime": T0 + i * DAY, "systolic": s, "diastolic": d, "status": "x"}
        for i, (s, d) in enumerate([(121, 81), (118, 0), (300, 80), (119, ""), ("bad", 80)])
    ]
    write_csv(f"{root}/physio_data/bp_1734000001.csv", bp)
    write_csv(f"{root}/physio_data/bp_1734000002.csv", bp)
    narrow = [
        {"logDateTime": T0 + i * DAY, "createdTime": 5, "lightSleep": 200, "deepSleep": 100 + i,
         "almostAwake": "" if i else 12, "description": '1~2,"q"', "status": "s"}
        for i in range(3)
    ]
    write_csv(f"{root}/physio_data/sleep_1734000003.csv", narrow)
    wide = [{"remSleep": 7, **row, "logDateTime": row["logDateTime"] + 10 * DAY} for row in narrow]
    write_csv(f"{root}/physio_data/sleep_1739000000.csv", wide)
    steps = [
        {"createdTime": 9, "logDateTime": T0 + i * DAY, "steps": 1000 * i, "distance": i, "calories": 3}
        for i in range(6)
    ]
    write_csv(f"{root}/Participant_7/steps_1734100000.csv", steps)
    write_csv(
        f"{root}/participant-a/steps_1734100001.csv",
        [{"logDateTime": "2024-12-12 08:00:00", "steps": 4000}, {"logDateTime": "never", "steps": 1}],
    )
    sessions = [
        {"averageSessionHeartRate": 61, "maxRate": 70, "minRate": 50, "logDateTime": T0,
         "jsonData": [{"createdTime": T0, "heartRate": 60}, {"createdTime": T0 + 60, "heartRate": 62}]},
        {"averageSessionHeartRate": 66, "maxRate": 71, "minRate": 51, "logDateTime": T0 + DAY, "jsonData": []},
    ]
    write_json(f"{root}/physio_data/heartrate_1734000004.json", sessions)
    write_json(
        f"{root}/physio_data/spo2_1734000005.json",
        [{"createdTime": T0 + i, "spo2Value": 95 + i, "status": "ok"} for i in range(3)],
    )
    write_json(
        f"{root}/physio_data/temperature_1734000006.json",
        [{"createdTime": T0 + i * DAY, "temperature": 97.5 + i, "skipable": 0} for i in range(2)],
    )
    write_json(
        f"{root}/physio_data/temperature_1734000007.json",
        {"createdTime": [T0 + 90 * DAY, T0 + 91 * DAY], "temperature": [98.1, 98.3]},
    )
    os.makedirs(f"{root}/other", exist_ok=True)
    write_csv(f"{root}/other/bp_1.csv", bp)
    with open(f"{root}/physio_data/notes_1.csv", "w") as f:
        f.write("a\n1\n")
    meals = [
        {"meal_id": i, "user_id": "u", "dish": dish, "time": (T0 + day * DAY) * 1000 + i, "rating": "",
         "customization": "", "season_id": "", "image_url": "", "is_deleted": ""}
        for i, (day, dish) in enumerate([(0, "Soup"), (0, "Rice"), (0, "Soup"), (1, "Tea"), (40, "Bread")])
    ]
    write_csv(f"{root}/meals_data/Combined Meals Data.csv", meals)
    os.makedirs(f"{root}/lungs_data")
    with open(f"{root}/lungs_data/spirometry.csv", "w") as f:
        f.write("Patient ID,FirstName,Gender,FEV1,FEV1/FVC,,\np1,A,F,3.1,0.81,,\np2,B,M,3.3,0.86,,\n")
    return root
