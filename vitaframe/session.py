"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Group values are joined back onto rows by participant and metric, and one
# participant may hold a third of all rows. Such a join is split at run time by
# the adaptive skew join; forcing it keeps the split also where a later step
# has to shuffle once more because of it.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Put the settings the library is written for on a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app: str = "vitaframe", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library is written for."""
    builder = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of its own: on a cluster the
    folder must be one that every executor can reach.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    named = tempfile.mkdtemp(prefix="vitaframe-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new place in the shared folder and read it back, cutting its lineage."""
    spark = df.sparkSession
    path = os.path.join(
        checkpoint_dir(spark), f"{spark.sparkContext.applicationId}-{name}-{uuid.uuid4().hex[:12]}"
    )
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
