"""Result tables and documents on disk."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, folder: str, name: str, fmt: str = "json") -> str:
    """One result table per folder, replacing an earlier one."""
    path = os.path.join(folder, name)
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "json") -> dict[str, str]:
    return {name: write_table(df, folder, name, fmt) for name, df in tables.items()}


def combined_documents(documents: DataFrame, generated_at) -> DataFrame:
    """One JSON text per participant, with the time of the run in ISO form."""
    body = [c for c in documents.columns if c != "participant_id"]
    return documents.select(
        "participant_id",
        F.to_json(
            F.struct(
                "participant_id",
                F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
                *body,
            ),
            {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss", "ignoreNullFields": "false"},
        ).alias("document"),
    )


def write_participant_documents(
    documents: DataFrame, path: str, file_per_participant: bool = False
) -> None:
    """Participant documents as JSON lines, or as one folder per participant.

    One folder each is the familiar layout for a small cohort; for millions of
    participants keep the default, which writes a few large files.
    """
    named = documents.withColumn(
        "patient", F.regexp_replace("participant_id", "participant-", "")
    )
    if file_per_participant:
        named.repartition("patient").write.mode("overwrite").partitionBy("patient").json(path)
    else:
        named.write.mode("overwrite").json(path)
