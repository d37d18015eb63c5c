"""Export folders: discovery, reading and the loading summary."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaframe.functions.scalar import within_timestamps
from vitaframe.schemas import (
    FILE_PATTERNS,
    LUNGS_FILE,
    MEALS_FILE,
    MEALS_SCHEMA,
)
from vitaframe.session import checkpoint_dir, stage_table
from vitaframe.sources.standardize import (
    SLEEP_PARTS,
    candidates,
    flatten_structs,
    readings_to_records,
    rows_from_parallel_arrays,
)

PHYSIO_FOLDER = "physio_data"
DEFAULT_PARTICIPANT = "participant-default"
BYTE_ORDER_MARK = "\ufeff"
# The lower bits of a row's number count the rows of its partition.
ROWS_OF_PARTITION = 2**33


def participant_from_folder(folder: Column) -> Column:
    """Participant id of a folder name."""
    return (
        F.when(folder == PHYSIO_FOLDER, F.lit(DEFAULT_PARTICIPANT))
        .when(folder.startswith("participant-"), folder)
        .when(
            F.lower(folder).startswith("participant"),
            F.concat(F.lit("participant-"), F.element_at(F.split(folder, "_"), -1)),
        )
        .otherwise(folder)
    )


def metric_from_file(name: Column) -> Column:
    """Metric of an export file name; null for any other file."""
    found = F.lit(None).cast("string")
    for metric, pattern in FILE_PATTERNS.items():
        prefix, suffix = pattern.split("*")
        found = F.when(
            name.startswith(prefix) & name.endswith(suffix), F.lit(metric)
        ).otherwise(found)
    return found


def _placed(df: DataFrame, path: Column, input_dir: str) -> DataFrame:
    """Adds folder, file_name and participant_id of files directly below a folder."""
    root = re.escape(os.path.basename(os.path.normpath(input_dir)))
    shape = rf"{root}/([^/]+)/([^/]+)$"
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return (
        df.withColumn("folder", F.regexp_extract(plain, shape, 1))
        .withColumn("file_name", F.regexp_extract(plain, shape, 2))
        .withColumn("participant_id", participant_from_folder(F.col("folder")))
    )


def _exports(df: DataFrame, path: Column, input_dir: str) -> DataFrame:
    """What belongs to an export file of a known metric, with its origin."""
    return (
        _placed(df, path, input_dir)
        .where((F.col("folder") == PHYSIO_FOLDER) | F.col("folder").contains("articipant"))
        .withColumn("metric_type", metric_from_file(F.col("file_name")))
        .where(F.col("metric_type").isNotNull())
    )


def discover_files(spark: SparkSession, input_dir: str) -> DataFrame:
    """The export files of every participant, one row per file."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*_*.{csv,json}")
        .load(input_dir)
        .select("path", "length")
    )
    return (
        _exports(listed, F.col("path"), input_dir)
        .withColumn("file_epoch", file_epoch(F.col("file_name")))
    )


def file_epoch(name: Column) -> Column:
    """The time in seconds that an export file's name ends with; null if none."""
    return F.regexp_extract(name, r"_(\d+)\.[^.]*$", 1).try_cast("long")


def file_date_range(files: DataFrame) -> DataFrame:
    """First and last export time by file name, with whole days between."""
    at = F.timestamp_seconds(within_timestamps(F.col("file_epoch"), 1))
    return files.agg(F.min(at).alias("first"), F.max(at).alias("last")).select(
        F.to_date("first").alias("start"),
        F.to_date("last").alias("end"),
        F.floor((F.unix_timestamp("last") - F.unix_timestamp("first")) / 86400)
        .cast("int")
        .alias("span_days"),
    )


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([]))


def load_csv(spark: SparkSession, path, columns: list[str] | None = None) -> DataFrame:
    """A CSV with a header, all columns as text; empty if unreadable."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    try:
        return reader.csv(path)
    except AnalysisException:
        return _empty(spark)


def _document(column: str = "value") -> Column:
    """The text of a JSON file without a byte order mark and leading white space."""
    return F.regexp_replace(F.col(column), rf"^[{BYTE_ORDER_MARK}\s]+", "")


def load_json(spark: SparkSession, path, schema: T.StructType | str | None = None) -> DataFrame:
    """A JSON array of objects, or one object of parallel arrays; empty if unreadable.

    Each file is read once: its objects are put into the shared folder, one a line, where
    their columns are found out (unless ``schema`` gives them) and their values read.
    """
    try:
        files = spark.read.option("wholetext", True).text(path)
    except AnalysisException:
        return _empty(spark)
    document = _document()
    is_list = document.startswith("[")
    # A line break of JSON text is white space: inside of strings it is escaped.
    objects = F.when(is_list, F.from_json(document, "array<string>")).otherwise(
        F.array(F.translate(document, "\r\n", "  "))
    )
    folder = f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}-json-{uuid.uuid4().hex[:12]}"
    files.select(
        F.when(is_list, "list").otherwise("object").alias("_shape"), F.explode(objects).alias("value")
    ).where("value IS NOT NULL").write.partitionBy("_shape").text(folder)
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        df = reader.json(folder)
    except AnalysisException:
        return _empty(spark)
    if "_corrupt_record" in df.columns or "_shape" not in df.columns:
        return _empty(spark)
    only_object = df.where("_shape = 'list'").isEmpty()
    df = df.drop("_shape")
    if only_object:
        arrays = _array_columns(df)
        if not arrays:
            return _empty(spark)
        df = rows_from_parallel_arrays(df, arrays)
    return flatten_structs(df)


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """Reader chosen by extension; other files give an empty table."""
    suffix = os.path.splitext(path)[1].lower()
    if suffix == ".csv":
        return load_csv(spark, path)
    if suffix == ".json":
        return load_json(spark, path)
    return _empty(spark)


def _array_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.ArrayType)
        and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType))
    ]


def _chosen_columns(columns: Column, mode: str) -> dict[str, Column]:
    """The columns that hold time, value and second value, by the names a file has.

    The first candidate that exists is taken, whatever values it holds.
    """
    found = {}
    for role in ("datetime", "value", "secondary"):
        name = F.lit(None).cast("string")
        for metric in FILE_PATTERNS:
            first = [F.when(F.array_contains(columns, c), F.lit(c)) for c in candidates(metric, role, mode)]
            if first:
                name = F.when(F.col("metric_type") == metric, F.coalesce(*first)).otherwise(name)
        found[f"_{role}"] = name
    parts = F.array_contains(columns, "lightSleep") & F.array_contains(columns, "deepSleep")
    found["is_total"] = (F.col("metric_type") == "sleep") & parts
    return found


ORIGIN = ["participant_id", "metric_type", "source_file"]


def _usable(files: DataFrame, mode: str) -> DataFrame:
    """Files whose columns (``columns``) name a time and a value, and which these are."""
    chosen = files.withColumns(_chosen_columns(F.col("columns"), mode))
    return chosen.where("_datetime IS NOT NULL AND _value IS NOT NULL")


def _export_text(spark: SparkSession, input_dir: str, suffix: str, whole: bool) -> DataFrame:
    """The text of the exports of a kind: a row per line, or per file if ``whole``."""
    text = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*_*.{suffix}")
        .option("wholetext", whole)
        .text(input_dir)
        .select("value", "_metadata.file_path", "_metadata.file_block_start")
    )
    place = F.col("file_block_start") + F.monotonically_increasing_id() % ROWS_OF_PARTITION
    return (
        _exports(text.withColumn("row_pos", place), F.col("file_path"), input_dir)
        .withColumn("source_file", F.concat_ws("/", "folder", "file_name"))
        .select(*ORIGIN, "file_block_start", "row_pos", "value")
    )


def _fields(line: Column, width: int) -> Column:
    """The fields of a line of CSV as an array of text."""
    names = [f"c{i}" for i in range(width)]
    parsed = F.from_csv(line, ", ".join(f"{n} string" for n in names))
    return F.array(*[parsed[n] for n in names])


def _csv_readings(spark: SparkSession, input_dir: str, mode: str) -> DataFrame:
    """Raw readings of all CSV exports, whatever their headers.

    Files are read once, line by line, into the shared folder. A header is the first line
    of its file: what it names is a row of a table of files, which tells the lines joined
    to it where their time and values stand. Headers stay off the driver, but for the
    largest number of fields.

    A line's position is the start of its part of the file and its number there; parts
    that are not a file's last fill a partition alone, so positions rise within a file.
    """
    lines = stage_table(_export_text(spark, input_dir, "csv", False), "export-lines")
    header = F.regexp_replace(F.min_by("value", "row_pos"), BYTE_ORDER_MARK, "")
    heads = (
        lines.where("file_block_start = 0")
        .groupBy(*ORIGIN)
        .agg(header.alias("header"), F.min("row_pos").alias("_first"))
    )
    heads = stage_table(heads, "export-headers")
    commas = F.max(F.length("header") - F.length(F.replace("header", F.lit(","), F.lit(""))))
    width = (heads.agg(commas).first()[0] or 0) + 1
    files = _usable(heads.withColumn("columns", _fields(F.col("header"), width)), mode)
    places = {
        name: F.array_position("columns", F.col(column)).cast("int")
        for name, column in (("_at", "_datetime"), ("_v1", "_value"), ("_v2", "_secondary"))
    }
    places |= {f"_{part}": F.array_position("columns", F.lit(part)).cast("int") for part in SLEEP_PARTS}
    files = files.select("source_file", "_first", "is_total", *[c.alias(n) for n, c in places.items()])
    rows = (
        lines.join(files, "source_file")
        .where("row_pos > _first OR file_block_start > 0")
        .withColumn("_fields", _fields(F.col("value"), width))
    )

    def field(place: str) -> Column:
        return F.when(F.col(place) > 0, F.get("_fields", F.col(place) - 1))

    return rows.select(
        *ORIGIN, "row_pos", "is_total", field("_at").alias("raw_time"), field("_v1").alias("raw_value"),
        field("_v2").alias("raw_second"), *[field(f"_{p}").alias(p) for p in SLEEP_PARTS],
    )


def _objects(texts: Column) -> Column:
    """JSON objects as maps from column to text."""
    return F.transform(texts, lambda t: F.from_json(t, "map<string,string>"))


def _json_rows(document: Column) -> Column:
    """The rows of a JSON file as maps: a list of objects, or an object of parallel arrays."""
    listed = F.filter(_objects(F.from_json(document, "array<string>")), lambda r: r.isNotNull())
    whole = F.from_json(document, "map<string,string>")
    is_array = lambda text: F.coalesce(F.ltrim(text).startswith("["), F.lit(False))
    arrays = F.transform_values(
        F.map_filter(whole, lambda k, v: is_array(v)), lambda k, v: F.from_json(v, "array<string>")
    )
    single = F.map_filter(whole, lambda k, v: ~is_array(v))
    sizes = F.array_distinct(F.transform(F.map_values(arrays), F.size))
    position = F.sequence(F.lit(0), sizes[0] - 1)
    parallel = F.transform(
        position, lambda i: F.map_concat(single, F.transform_values(arrays, lambda k, a: F.get(a, i)))
    )
    return F.when(document.startswith("["), listed).when((F.size(sizes) == 1) & (sizes[0] > 0), parallel)


def _names(rows: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(rows, F.map_keys)))


def _nested_rows(rows: Column, column: Column) -> Column:
    """The objects nested in an only column as the rows."""

    def inner(row: Column) -> Column:
        text = F.ltrim(F.try_element_at(row, column))
        return (
            F.when(text.startswith("["), _objects(F.from_json(text, "array<string>")))
            .when(text.startswith("{"), F.array(F.from_json(text, "map<string,string>")))
            .otherwise(F.array(row))
        )

    return F.filter(F.flatten(F.transform(rows, inner)), lambda r: r.isNotNull())


def _session_rows(rows: Column, nested: str = "jsonData") -> Column:
    """One row per reading nested in a session; its fields win over the session's fields."""

    def inner(row: Column) -> Column:
        own = F.map_filter(row, lambda k, v: k != nested)
        readings = F.filter(
            _objects(F.from_json(F.try_element_at(row, F.lit(nested)), "array<string>")),
            lambda r: r.isNotNull(),
        )
        merged = F.transform(
            readings,
            lambda r: F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(r, k)), r),
        )
        return F.when(F.size(readings) > 0, merged).otherwise(F.array(own))

    return F.flatten(F.transform(rows, inner))


def _json_readings(spark: SparkSession, input_dir: str, mode: str, expand_sessions: bool) -> DataFrame:
    """Raw readings of all JSON exports, whatever their shape and columns.

    A file is one row until its objects are rows of their own: its shape, the columns it
    names and its values come from the same read, and a reading's position is its place
    in the file.
    """
    files = _export_text(spark, input_dir, "json", True).select(*ORIGIN, _document().alias("document"))
    files = files.withColumn("rows", _json_rows(F.col("document"))).drop("document")
    files = files.withColumn("columns", _names(F.col("rows")))
    only = (F.col("metric_type") != "hr") & (F.size("columns") == 1)
    nested = F.when(only, _nested_rows(F.col("rows"), F.get("columns", F.lit(0))))
    if expand_sessions:
        sessions = (F.col("metric_type") == "hr") & F.array_contains("columns", "jsonData")
        nested = nested.when(sessions, _session_rows(F.col("rows")))
    files = files.withColumn("rows", nested.otherwise(F.col("rows")))
    files = _usable(files.withColumn("columns", _names(F.col("rows"))), mode)
    rows = files.select(
        *ORIGIN, "is_total", "_datetime", "_value", "_secondary", F.posexplode("rows").alias("_place", "_row")
    )

    def field(name: Column) -> Column:
        return F.try_element_at("_row", name)

    at = field(F.col("_datetime"))
    # A whole number may be written with a fraction or an exponent.
    whole = F.coalesce(at.try_cast("long"), at.try_cast("double").try_cast("long")).cast("string")
    return rows.select(
        *ORIGIN, F.col("_place").cast("long").alias("row_pos"), "is_total", F.coalesce(whole, at).alias("raw_time"),
        field(F.col("_value")).alias("raw_value"), field(F.col("_secondary")).alias("raw_second"),
        *[field(F.lit(p)).alias(p) for p in SLEEP_PARTS],
    )


def read_records(
    spark: SparkSession,
    input_dir: str,
    mode: str = "corrected",
    expand_sessions: bool = False,
) -> DataFrame:
    """All export files below ``input_dir`` as one record table.

    A record's place is its file and its position there (``source_file``, ``row_pos``).
    The plan is the same however many files and different headers there are.
    """
    readings = _csv_readings(spark, input_dir, mode).unionByName(
        _json_readings(spark, input_dir, mode, expand_sessions)
    )
    return readings_to_records(readings, mode)


def read_meals(spark: SparkSession, input_dir: str) -> DataFrame:
    """The meals table with its calendar date; empty when there is no file."""
    try:
        meals = spark.read.schema(MEALS_SCHEMA).option("header", True).csv(
            os.path.join(input_dir, MEALS_FILE)
        )
    except AnalysisException:
        meals = spark.createDataFrame([], MEALS_SCHEMA)
    return meals.withColumn("date", F.to_date(F.timestamp_millis(within_timestamps(F.col("time"), 1000))))


def read_lungs(spark: SparkSession, input_dir: str) -> DataFrame:
    """The lung-function table; empty when there is no file."""
    return load_csv(spark, os.path.join(input_dir, LUNGS_FILE))
