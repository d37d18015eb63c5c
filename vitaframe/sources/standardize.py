"""From raw tables to the record table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaframe.config import GOOD
from vitaframe.functions.columns import first_existing
from vitaframe.functions.scalar import within_timestamps
from vitaframe.schemas import DECLARED_SCHEMAS, EXPORT_COLUMNS, RECORD_COLUMNS

# ``corrected`` reads epochs as seconds, sleep in hours and the oximeter's own
# column; ``parity`` reproduces the first published behaviour (epochs taken as
# nanoseconds, sleep minutes judged as hours, no oxygen saturation).
MODES = ("corrected", "parity")


def parse_number(column: Column) -> Column:
    """A double, or null for anything that is not a number."""
    value = column.try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_datetime(column: Column, mode: str = "corrected") -> Column:
    """A timestamp from an epoch or from date text; null when neither."""
    epoch = column.try_cast("long")
    if mode == "parity":
        from_epoch = F.timestamp_micros(F.floor(epoch / F.lit(1000)).cast("long"))
    else:
        from_epoch = F.timestamp_seconds(within_timestamps(epoch, 1))
    return F.when(epoch.isNotNull(), from_epoch).otherwise(
        F.try_to_timestamp(column.cast("string"))
    )


SLEEP_PARTS = EXPORT_COLUMNS["sleep"]["value"]


def candidates(metric: str, role: str, mode: str) -> list[str]:
    """Names of columns that may hold a metric's time, value or second value."""
    names = list(EXPORT_COLUMNS[metric][role])
    if metric == "spo2" and role == "value" and mode == "corrected":
        names.append("spo2Value")
    return names


def resolve_export_columns(
    df: DataFrame, metric: str, mode: str = "corrected"
) -> dict[str, str | None] | None:
    """Which columns hold time, value and secondary value; None if unusable.

    The choice depends on the columns that exist, not on their values.
    """
    chosen = {
        role: first_existing(df, candidates(metric, role, mode))
        for role in ("datetime", "value", "secondary")
    }
    return chosen if chosen["datetime"] and chosen["value"] else None


def sleep_total(df: DataFrame) -> Column:
    """Light, deep and almost-awake sleep added up, absent parts as 0."""
    parts = [c for c in SLEEP_PARTS if c in df.columns]
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(parse_number(F.col(part)), F.lit(0.0))
    return total


def standardize_export(df: DataFrame, metric: str, mode: str = "corrected") -> DataFrame | None:
    """Raw export rows to records.

    ``df`` carries ``participant_id``, ``source_file`` and ``row_pos`` beside
    the export's own columns. Rows without a readable time or value are dropped;
    an unreadable secondary value becomes null.
    """
    chosen = resolve_export_columns(df, metric, mode)
    if chosen is None:
        return None
    second = F.col(f"`{chosen['secondary']}`") if chosen["secondary"] else F.lit(None)
    is_total = metric == "sleep" and {"lightSleep", "deepSleep"} <= set(df.columns)
    readings = df.select(
        "participant_id",
        F.lit(metric).alias("metric_type"),
        "source_file",
        "row_pos",
        F.lit(is_total).alias("is_total"),
        F.col(f"`{chosen['datetime']}`").alias("raw_time"),
        F.col(f"`{chosen['value']}`").alias("raw_value"),
        second.alias("raw_second"),
        *[(F.col(p) if p in df.columns else F.lit(None)).alias(p) for p in SLEEP_PARTS],
    )
    return readings_to_records(readings, mode)


def readings_to_records(readings: DataFrame, mode: str = "corrected") -> DataFrame:
    """Raw readings of any metric to records.

    ``readings``: participant_id, metric_type, source_file, row_pos, raw_time, raw_value,
    raw_second, is_total (sleep given by its parts) and the parts of sleep.
    """
    value = F.when(F.col("is_total"), sleep_total(readings)).otherwise(parse_number(F.col("raw_value")))
    if mode == "corrected":
        value = F.when(F.col("metric_type") == "sleep", value / 60.0).otherwise(value)
    raw_time = F.col("raw_time")
    when = parse_datetime(raw_time, mode)
    return (
        readings.select(
            "participant_id",
            "metric_type",
            when.alias("datetime"),
            F.coalesce(raw_time.try_cast("long"), F.unix_micros(when)).alias("epoch_raw"),
            value.alias("value_1"),
            parse_number(F.col("raw_second")).alias("value_2"),
            F.lit("").alias("unit"),
            F.create_map().cast("map<string,string>").alias("metadata"),
            F.lit(GOOD).alias("quality_flag"),
            "source_file",
            "row_pos",
        )
        .where(F.col("datetime").isNotNull() & F.col("value_1").isNotNull())
        .select(RECORD_COLUMNS)
    )


def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested objects as dotted top-level columns, at every depth."""

    def leaves(prefix: str, name: str, dtype: T.DataType) -> list[Column]:
        path = f"{prefix}.`{name}`" if prefix else f"`{name}`"
        label = path.replace("`", "")
        if isinstance(dtype, T.StructType):
            return [c for f in dtype.fields for c in leaves(path, f.name, f.dataType)]
        return [F.col(path).alias(label)]

    return df.select([c for f in df.schema.fields for c in leaves("", f.name, f.dataType)])


def explode_sessions(df: DataFrame, nested: str = "jsonData") -> DataFrame:
    """One row per nested reading; its fields win over the session's fields.

    Sessions without readings keep one row.
    """
    item_type = df.schema[nested].dataType.elementType
    inner = item_type.fieldNames()
    outer = [c for c in df.columns if c != nested]
    exploded = df.select(*[F.col(f"`{c}`") for c in outer], F.explode_outer(nested).alias("_item"))
    columns = []
    for name in outer:
        own = F.col(f"`{name}`")
        if name in inner:
            own = F.when(F.col("_item").isNotNull(), F.col(f"_item.`{name}`")).otherwise(own)
        columns.append(own.alias(name))
    columns += [F.col(f"_item.`{n}`").alias(n) for n in inner if n not in outer]
    return exploded.select(columns)


def unnest_only_column(df: DataFrame, column: str) -> DataFrame:
    """Use the objects nested in an export's only column as its rows.

    Columns that describe the row's origin are kept beside them.
    """
    dtype = df.schema[column].dataType
    others = [f"`{c}`" for c in df.columns if c != column]
    if isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        return flatten_structs(df.select(*others, F.inline(f"`{column}`")))
    if isinstance(dtype, T.StructType):
        return flatten_structs(df.select(*others, f"`{column}`.*"))
    return df


def rows_from_parallel_arrays(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One object of equally long arrays to one row per position."""
    same = F.lit(True)
    for name in columns[1:]:
        same = same & (F.size(f"`{name}`") == F.size(f"`{columns[0]}`"))
    others = [c for c in df.columns if c not in columns]
    zipped = F.arrays_zip(*[F.col(f"`{c}`") for c in columns])
    return df.where(same).select(*[f"`{c}`" for c in others], F.inline(zipped))


def to_utc(column: Column, tz: str = "UTC", aware: bool = False) -> Column:
    """Naive times are read in ``tz``; aware times are already instants."""
    return column if aware or tz == "UTC" else F.to_utc_timestamp(column, tz)


def validate_table(df: DataFrame, metric: str) -> DataFrame:
    """Schema problems of a declared table, one row each: (metric_type, problem)."""
    spark = df.sparkSession
    problems: list[str] = []
    declared = DECLARED_SCHEMAS.get(metric)
    if declared is None:
        problems.append(f"Unknown metric type: {metric}")
    else:
        absent = sorted(set(declared["required"]) - set(df.columns))
        if absent:
            problems.append("Missing required columns: " + ", ".join(absent))
    found = spark.range(1).select(
        F.lit(metric).alias("metric_type"),
        F.explode(
            F.array(*[F.lit(p) for p in problems]).cast("array<string>")
        ).alias("problem"),
    )
    if declared is not None and "datetime" in df.columns:
        raw = F.col("datetime")
        bad = F.count_if(raw.isNotNull() & parse_datetime(raw).isNull())
        unread = (
            df.agg(bad.alias("bad"))
            .where("bad > 0")
            .select(
                F.lit(metric).alias("metric_type"),
                F.format_string("Invalid datetime format: %d rows", "bad").alias("problem"),
            )
        )
        found = found.unionByName(unread)
    return found


def standardize_declared(
    df: DataFrame,
    participant_id: Column | str,
    metric: str,
    tz: str = "UTC",
    source_file: Column | None = None,
    row_pos: Column | None = None,
) -> DataFrame:
    """A table with declared columns to records.

    Unit comes from the declared schema, every other column goes to the
    metadata map. A missing value is kept (and later flagged), text that is no
    number drops the row.
    """
    if metric not in DECLARED_SCHEMAS:
        raise ValueError(f"Unknown metric type: {metric}")
    declared = DECLARED_SCHEMAS[metric]
    first, second = declared["value_1"], declared["value_2"]
    extra = [c for c in df.columns if c not in ("datetime", first, second)]
    metadata = (
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in extra]),
            F.array(*[F.col(f"`{c}`").cast("string") for c in extra]),
        )
        if extra
        else F.create_map().cast("map<string,string>")
    )
    raw = F.col(f"`{first}`")
    when = to_utc(parse_datetime(F.col("datetime")), tz)
    return (
        df.where(raw.isNull() | raw.try_cast("double").isNotNull())
        .select(
            (participant_id if isinstance(participant_id, Column) else F.lit(participant_id)).alias(
                "participant_id"
            ),
            F.lit(metric).alias("metric_type"),
            when.alias("datetime"),
            F.unix_micros(when).alias("epoch_raw"),
            raw.try_cast("double").alias("value_1"),
            (
                parse_number(F.col(f"`{second}`"))
                if second in df.columns
                else F.lit(None).cast("double")
            ).alias("value_2"),
            F.lit(declared["unit"]).alias("unit"),
            metadata.alias("metadata"),
            F.lit(GOOD).alias("quality_flag"),
            (F.lit("") if source_file is None else source_file).alias("source_file"),
            (F.monotonically_increasing_id() if row_pos is None else row_pos).alias("row_pos"),
        )
        .where(F.col("datetime").isNotNull())
    )
