"""Times the headline queries and prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].
Each query is written to the noop sink, so that all its rows are produced.
The times are those of a warm session: see ``main``.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vitaframe.plans.catalog import QUERIES  # noqa: E402
from vitaframe.plans.workspace import event_workspace  # noqa: E402
from vitaframe.session import build_session  # noqa: E402

# The shared tables a full analysis stages, in order; timed as steps of their own.
STAGES = [
    "flagged",
    "cleaned",
    "daily",
    "baselines",
    "hourly",
    "weekdays",
    "correlations",
    "lags",
    "rolling",
    "trends",
    "anomaly_days",
    "anomalies",
]
# Queries run on the staged tables.
HEADLINES = [
    "overall_quality",
    "participant_quality",
    "metric_quality",
    "metric_statistics",
    "metric_noise",
    "outlier_clustering",
    "calendar_profiles",
    "metric_compliance",
    "daily_compliance_summary",
    "cohort_compliance",
    "cohort_correlations",
    "cohort_insights",
    "z_deviations",
    "threshold_deviation_meals",
    "all_insights",
    "participant_overview",
    "correlation_matrix",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "vitaframe-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            # The tables are a few megabytes: keep all cores busy all the same.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.sql.files.openCostInBytes": "65536",
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # A run over the smallest tables first, so that starting and compiling are not
    # counted. It shares no tables with the timed run.
    small = os.path.join(os.path.dirname(os.path.normpath(sf_dir)), "sf0.001")
    if os.path.isdir(small) and os.path.normpath(small) != os.path.normpath(sf_dir):
        warm = event_workspace(spark, small)
        for name in STAGES:
            warm[name]
        for name in HEADLINES:
            run(QUERIES[name](spark, small))
    times: dict[str, float] = {}
    ws = event_workspace(spark, sf_dir)
    for name in STAGES:
        start = time.perf_counter()
        ws[name]
        times[f"stage_{name}"] = round(time.perf_counter() - start, 3)
    for name in HEADLINES:
        start = time.perf_counter()
        run(QUERIES[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "records": ws.records.count(),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
