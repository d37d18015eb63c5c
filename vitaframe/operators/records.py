"""Selecting, combining and reshaping records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitaframe.functions.scalar import clock, month_name, weekday
from vitaframe.schemas import DECLARED_SCHEMAS


def of_participant(records: DataFrame, participant_id: str) -> DataFrame:
    return records.where(F.col("participant_id") == participant_id)


def of_metric(records: DataFrame, metric: str) -> DataFrame:
    return records.where(F.col("metric_type") == metric)


def of_participant_metric(records: DataFrame, participant_id: str, metric: str) -> DataFrame:
    return of_metric(of_participant(records, participant_id), metric)


def between_dates(records: DataFrame, start, end) -> DataFrame:
    """Readings from ``start`` to ``end``, both included."""
    return records.where(F.col("datetime").between(F.lit(start), F.lit(end)))


def with_quality(records: DataFrame, flags: list[str]) -> DataFrame:
    return records.where(F.col("quality_flag").isin(flags))


def participants(records: DataFrame) -> DataFrame:
    return records.select("participant_id").distinct()


def metric_types(records: DataFrame) -> DataFrame:
    return records.select("metric_type").distinct()


def record_counts(records: DataFrame) -> DataFrame:
    """Rows, participants and metrics of a record table.

    Counted per participant and metric first, so that the distinct counts run
    over a small table.
    """
    per_group = records.groupBy("participant_id", "metric_type").agg(F.count(F.lit(1)).alias("n"))
    return per_group.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.countDistinct("participant_id").alias("participants"),
        F.countDistinct("metric_type").alias("metrics"),
    )


def append_records(*tables: DataFrame) -> DataFrame:
    """All rows of all tables, copies included."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


# Columns that tables of declared metrics may bring along, in the order they are declared.
DECLARED_KEYS = list(
    dict.fromkeys(
        name
        for declared in DECLARED_SCHEMAS.values()
        for name in [*declared["required"], *declared["optional"]]
        if name != "datetime"
    )
)


def metadata_keys(records: DataFrame) -> list[str]:
    """The metadata keys in use, for ``flat_table``. They come to the driver: each is to be a column."""
    rows = records.select(F.explode(F.map_keys("metadata")).alias("key")).distinct().collect()
    return sorted(row["key"] for row in rows)


def flat_table(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Records with one column per metadata key.

    Without ``keys`` these are the declared ones, and whatever else a record carries is in
    ``other``, a variant whose fields are read by path (``other:device``): which keys
    occur needs not be known, so nothing is collected and the plan is the same for all data.
    """
    columns = DECLARED_KEYS if keys is None else keys
    rest = F.map_filter("metadata", lambda k, v: ~k.isin(columns))
    other = [F.to_variant_object(F.coalesce(rest, F.create_map().cast("map<string,string>"))).alias("other")]
    return records.select(
        "participant_id",
        "metric_type",
        "datetime",
        "value_1",
        "value_2",
        "unit",
        "quality_flag",
        *[F.try_element_at("metadata", F.lit(k)).alias(k) for k in columns],
        *(other if keys is None else []),
    )


def with_calendar(records: DataFrame) -> DataFrame:
    """Date, hour, weekday, month, clock time and ISO date of each reading."""
    ts = F.col("datetime")
    return (
        records.withColumn("date", F.to_date(ts))
        .withColumn("hour", F.hour(ts))
        .withColumn("weekday", weekday(ts))
        .withColumn("month", month_name(ts))
        .withColumn("clock", clock(ts))
        .withColumn("iso_date", F.date_format(ts, "yyyy-MM-dd"))
    )


def common_dates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Dates that occur in both tables."""
    return left.select("date").intersect(right.select("date"))
