"""Every operator as a query on the analytical tables.

Results are plain scalars: doubles to six places, whole numbers as long.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaframe.config import METRICS
from vitaframe.functions.columns import find_column, rename_aliases
from vitaframe.operators import anomalies as an
from vitaframe.operators import baseline as bl
from vitaframe.operators import cleaning as cl
from vitaframe.operators import compliance as cm
from vitaframe.operators import correlation as co
from vitaframe.operators import daily as da
from vitaframe.operators import deviations as de
from vitaframe.operators import insights as ins
from vitaframe.operators import meals as me
from vitaframe.operators import noise as no
from vitaframe.operators import quality as qu
from vitaframe.operators import records as rec
from vitaframe.operators import reports as rep
from vitaframe.operators import statistics as st
from vitaframe.plans.documents import document_rows, participant_documents
from vitaframe.plans.workspace import Workspace, event_workspace
from vitaframe.sources import standardize as sd
from vitaframe.sources.files import file_date_range, file_epoch, metric_from_file
from vitaframe.sources.tables import EVENT_SETTINGS, event_records, read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PARTICIPANT = "participant-3"
START = dt.datetime(2024, 1, 10)
END = dt.datetime(2024, 1, 20)


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """The chosen columns with doubles rounded and integers widened.

    The small offset keeps means that end exactly on half a unit of the sixth
    place from hanging on the order in which they were summed.
    """
    out = []
    for name in columns or df.columns:
        kind = df.schema[name].dataType
        c = F.col(name)
        if isinstance(kind, T.DoubleType):
            c = F.round(c + 1e-9, 6)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(out)


def on_workspace(name: str):
    """Register a query that works on the shared tables."""

    def register(build: Callable[[Workspace], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(build(event_workspace(spark, sf_dir)))
        return build

    return register


def on_tables(name: str):
    """Register a query that works on the raw tables."""

    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plain(build(spark, sf_dir))
        return build

    return register


# --- raw exports -----------------------------------------------------------


def _raw(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    """The events as the rows of a raw export."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    k = F.get_json_object("props", "$.k")
    return (
        read_table(spark, sf_dir, "events")
        .withColumn("k", k)
        .withColumn("epoch", F.unix_seconds(F.col("ts").cast("timestamp")))
        .select(
            F.concat(F.lit("participant-"), F.col("user_id").cast("string")).alias(
                "participant_id"
            ),
            F.lit("events").alias("source_file"),
            F.col("event_id").alias("row_pos"),
            *[F.expr(text).alias(name) for name, text in columns.items()],
        )
    )


RECORD_VIEW = ["participant_id", "row_pos", "epoch_raw", "value_1", "value_2"]


@on_tables("resolved_columns")
def _(spark, sf_dir):
    raw = _raw(
        spark, sf_dir, createdTime="epoch + 60", logDateTime="epoch", calories="k",
        steps="value", other="value * 2",
    )
    return sd.standardize_export(raw, "steps").select(RECORD_VIEW)


@on_tables("sleep_totals")
def _(spark, sf_dir):
    raw = _raw(
        spark, sf_dir, logDateTime="epoch", lightSleep="value",
        deepSleep="case when event_type = 'view' then null else k end",
        almostAwake="case when event_type = 'click' then 'none' else '12' end",
    )
    return sd.standardize_export(raw, "sleep").select(RECORD_VIEW)


@on_tables("parsed_datetimes")
def _(spark, sf_dir):
    raw = _raw(
        spark, sf_dir,
        createdTime=(
            "case event_type when 'error' then 'unknown' "
            "when 'view' then date_format(ts, 'yyyy-MM-dd HH:mm:ss') "
            "else cast(epoch as string) end"
        ),
        systolic="value", diastolic="k",
    )
    out = sd.standardize_export(raw, "bp")
    return out.select(
        "participant_id",
        "row_pos",
        F.date_format("datetime", "yyyy-MM-dd HH:mm:ss").alias("at"),
        "value_1",
    )


@on_tables("parsed_numbers")
def _(spark, sf_dir):
    raw = _raw(
        spark, sf_dir, logDateTime="epoch",
        steps="case when event_type = 'error' then 'n/a' else cast(value as string) end",
        distance="case when event_type = 'view' then 'far' else k end",
    )
    return sd.standardize_export(raw, "steps").select(RECORD_VIEW)


@on_tables("session_readings")
def _(spark, sf_dir):
    raw = _raw(
        spark, sf_dir, logDateTime="epoch", lastRate="value",
        jsonData=(
            "case when event_type = 'signup' then null else array("
            "named_struct('logDateTime', epoch + 60, 'heartRate', cast(k as double)), "
            "named_struct('logDateTime', epoch + 120, 'heartRate', value + 1)) end"
        ),
    )
    return sd.explode_sessions(raw).select(
        "participant_id", "row_pos", "logDateTime", "lastRate", "heartRate"
    )


@on_tables("declared_records")
def _(spark, sf_dir):
    raw = _raw(
        spark, sf_dir, datetime="epoch", heart_rate="value", resting_hr="k", device="event_type"
    ).drop("source_file")
    out = sd.standardize_declared(
        raw, F.col("participant_id"), "hr", row_pos=F.col("row_pos")
    )
    return out.select(
        *RECORD_VIEW, "unit", F.col("metadata")["device"].alias("device"), "quality_flag"
    )


@on_tables("utc_times")
def _(spark, sf_dir):
    raw = _raw(spark, sf_dir, at="cast(ts as timestamp)")
    return raw.select(
        "row_pos",
        F.date_format(sd.to_utc(F.col("at"), "Asia/Kolkata"), "yyyy-MM-dd HH:mm:ss").alias(
            "utc_time"
        ),
    )


@on_tables("aliased_columns")
def _(spark, sf_dir):
    raw = _raw(spark, sf_dir, pulse="value", bpm="cast(k as double)")
    renamed = rename_aliases(raw, [(["heart_rate", "pulse"], "value"), (["bpm"], "second")])
    return renamed.drop("source_file")


# Events whose ids agree but for the last digits make up one file of arrays or objects.
PER_FILE = 500


@on_tables("parallel_array_rows")
def _(spark, sf_dir):
    events = _raw(spark, sf_dir, at="epoch", value="value")
    one = F.array_sort(F.collect_list(F.struct("row_pos", "at", "value")))
    files = events.groupBy(F.expr(f"row_pos div {PER_FILE}").alias("file")).agg(one.alias("rows"))
    arrays = files.select("file", "rows.row_pos", "rows.at", "rows.value")
    return sd.rows_from_parallel_arrays(arrays, ["row_pos", "at", "value"])


@on_tables("nested_only_rows")
def _(spark, sf_dir):
    events = _raw(spark, sf_dir, createdTime="epoch", spo2="value", confidence="k")
    reading = F.struct("row_pos", "createdTime", F.struct("spo2", "confidence").alias("of"))
    files = events.groupBy(
        F.col("participant_id"), F.expr(f"row_pos div {PER_FILE}").alias("file")
    ).agg(F.collect_list(reading).alias("data"))
    nested = sd.unnest_only_column(files.drop("file"), "data")
    named = nested.withColumnsRenamed({"of.spo2": "spo2", "of.confidence": "confidence"})
    return sd.standardize_export(named.withColumn("source_file", F.lit("f")), "spo2").select(RECORD_VIEW)


@on_tables("file_dates")
def _(spark, sf_dir):
    names = _raw(spark, sf_dir, file_name="concat('steps_', epoch, if(event_type = 'view', '.json', '.csv'))")
    files = names.withColumn("metric_type", metric_from_file(F.col("file_name"))).where("metric_type is not null")
    return file_date_range(files.withColumn("file_epoch", file_epoch(F.col("file_name"))))


@on_tables("found_columns")
def _(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    price, size = find_column(part, "PRICE"), find_column(part, "size")
    return part.select(
        "p_partkey", F.col(price).alias("price"), F.col(size).cast("double").alias("size")
    )


@on_tables("schema_problems")
def _(spark, sf_dir):
    raw = _raw(
        spark, sf_dir,
        datetime="case when event_type = 'error' then 'unknown' else cast(epoch as string) end",
        systolic="value",
    )
    return sd.validate_table(raw, "bp").unionByName(sd.validate_table(raw, "weight"))


# --- selecting and combining ------------------------------------------------

VIEW = ["participant_id", "metric_type", "epoch_raw", "value_1", "value_2", "row_pos"]


@on_workspace("flat_records")
def _(ws):
    flat = rec.flat_table(ws.records, ["event_type", "props"])
    return flat.withColumn("datetime", F.unix_micros("datetime"))


@on_workspace("flat_records_by_path")
def _(ws):
    flat = rec.flat_table(ws.records)
    return flat.select(
        "participant_id",
        "metric_type",
        F.unix_micros("datetime").alias("datetime"),
        "value_1",
        F.variant_get("other", "$.event_type", "string").alias("event_type"),
        F.variant_get("other", "$.props", "string").alias("props"),
        "device_id",
    )


@on_workspace("calendar_parts")
def _(ws):
    return rec.with_calendar(ws.records).select(
        "row_pos", "date", "hour", "weekday", "month", "clock", "iso_date"
    )


@on_workspace("participant_records")
def _(ws):
    return rec.of_participant(ws.records, PARTICIPANT).select(VIEW)


@on_workspace("metric_records")
def _(ws):
    return rec.of_metric(ws.records, "hr").select(VIEW)


@on_workspace("participant_metric_records")
def _(ws):
    return rec.of_participant_metric(ws.records, PARTICIPANT, "sleep").select(VIEW)


@on_workspace("date_range_records")
def _(ws):
    return rec.between_dates(ws.records, START, END).select(VIEW)


@on_workspace("quality_records")
def _(ws):
    return rec.with_quality(ws["cleaned"], ["outlier", "invalid"]).select(*VIEW, "quality_flag")


@on_workspace("record_counts")
def _(ws):
    return rec.record_counts(ws.records)


@on_workspace("distinct_participants")
def _(ws):
    return rec.participants(ws.records)


@on_workspace("distinct_metrics")
def _(ws):
    return rec.metric_types(ws.records)


@on_workspace("finding_severity")
def _(ws):
    found = ins.key_findings(ws["baselines"], ws["correlations"], ws["anomalies"], EVENT_SETTINGS)
    return ins.finding_severity(found).select("participant_id", "code", "severity")


@on_tables("appended_records")
def _(spark, sf_dir):
    # Two whole tables, the second without a column of the first.
    plain_events = event_records(spark, sf_dir, with_repeats=False).drop("value_2")
    return rec.append_records(event_workspace(spark, sf_dir).records, plain_events).select(VIEW)


@on_workspace("common_dates")
def _(ws):
    return rec.common_dates(ws.meals, ws["daily"])


# --- cleaning ---------------------------------------------------------------


@on_workspace("duplicate_flags")
def _(ws):
    return cl.flag_duplicates(ws.records).select("row_pos", "participant_id", "quality_flag")


@on_workspace("range_flags")
def _(ws):
    return cl.flag_out_of_range(ws.records, EVENT_SETTINGS).select(
        "row_pos", "metric_type", "quality_flag"
    )


@on_workspace("bp_flags")
def _(ws):
    return cl.flag_out_of_range(rec.of_metric(ws.records, "bp"), EVENT_SETTINGS).select(
        "row_pos", "value_1", "value_2", "quality_flag"
    )


@on_workspace("outlier_limits")
def _(ws):
    flagged = cl.flag_out_of_range(cl.flag_duplicates(ws.records), EVENT_SETTINGS)
    return cl.outlier_limits(flagged, EVENT_SETTINGS)


@on_workspace("missing_flags")
def _(ws):
    gaps = ws.records.withColumn(
        "value_1", F.when(F.col("metric_type") != "temp", F.col("value_1"))
    )
    return cl.flag_missing(gaps).select("row_pos", "quality_flag")


@on_workspace("quality_flags")
def _(ws):
    return cl.clean(ws.records, EVENT_SETTINGS).select("row_pos", "quality_flag")


@on_workspace("time_ordered_records")
def _(ws):
    return cl.in_time_order(ws.records).select(VIEW)


@on_workspace("cleaning_stats")
def _(ws):
    return cl.cleaning_stats(ws["cleaned"])


@on_workspace("range_lookup")
def _(ws):
    return cl.range_lookup(ws.records, EVENT_SETTINGS).select(
        "row_pos", "metric_type", "low", "high", "z_threshold", "expected_per_day", "config_unit"
    )


# --- quality and availability -------------------------------------------------


@on_workspace("overall_quality")
def _(ws):
    return qu.overall_quality(ws["cleaned"])


@on_workspace("participant_quality")
def _(ws):
    return qu.participant_quality(ws["cleaned"])


@on_workspace("metric_quality")
def _(ws):
    return qu.metric_quality(ws["cleaned"])


@on_workspace("flag_distribution")
def _(ws):
    return qu.flag_distribution(ws["cleaned"])


@on_workspace("daily_quality")
def _(ws):
    return qu.daily_quality(ws["cleaned"])


@on_workspace("date_range")
def _(ws):
    return qu.date_range(ws["cleaned"])


@on_workspace("quality_summary")
def _(ws):
    return qu.quality_summary(ws["cleaned"])


def _files(ws: Workspace) -> DataFrame:
    """A file catalogue: one export per participant, metric and day."""
    return ws.records.select(
        "participant_id", "metric_type", F.to_date("datetime").alias("day")
    ).distinct()


@on_workspace("participant_files")
def _(ws):
    return qu.participant_files(_files(ws))


@on_workspace("file_count_histogram")
def _(ws):
    return qu.file_count_histogram(qu.participant_files(_files(ws)))


@on_workspace("metric_availability")
def _(ws):
    return qu.metric_availability(qu.participant_files(_files(ws)))


# --- statistics ----------------------------------------------------------------


@on_workspace("meals_summary")
def _(ws):
    return me.meals_summary(ws.meals)


@on_tables("table_summary")
def _(spark, sf_dir):
    out = st.table_summary(read_table(spark, sf_dir, "part"))
    return out.withColumn("metrics", F.array_join("metrics", ","))


@on_workspace("metric_statistics")
def _(ws):
    return st.metric_statistics(ws["cleaned"])


@on_workspace("metric_noise")
def _(ws):
    return no.metric_noise(ws["cleaned"])


@on_workspace("calendar_profiles")
def _(ws):
    return st.calendar_profiles(ws["cleaned"])


@on_workspace("health_baselines")
def _(ws):
    return bl.health_baselines(ws["cleaned"], EVENT_SETTINGS).drop("mean_1", "interpretation")


@on_workspace("baseline_bands")
def _(ws):
    return ws["baselines"].select("participant_id", "metric_type", "series", "interpretation")


@on_workspace("hourly_pattern")
def _(ws):
    return bl.hourly_pattern(ws["cleaned"])


@on_workspace("weekday_pattern")
def _(ws):
    return bl.weekday_pattern(ws["cleaned"])


@on_workspace("daily_values")
def _(ws):
    return da.daily_values(ws["cleaned"])


@on_workspace("daily_wide")
def _(ws):
    return da.daily_wide(ws["cleaned"])


@on_workspace("daily_named_means")
def _(ws):
    return da.daily_named_means(ws["cleaned"])


@on_workspace("headline_means")
def _(ws):
    return st.headline_means(ws["cleaned"])


@on_tables("fuzzy_means")
def _(spark, sf_dir):
    return st.fuzzy_means(
        read_table(spark, sf_dir, "part"),
        {"avg_price": "retailprice", "avg_size": "SIZE", "avg_protein": "protein"},
    )


@on_workspace("daily_meals")
def _(ws):
    return me.daily_meals(ws.meals)


@on_workspace("participant_daily_meals")
def _(ws):
    return me.daily_meals(ws.meals, ["participant_id"])


@on_workspace("correlation_data_summary")
def _(ws):
    return st.correlation_data_summary(ws["daily"]).withColumn(
        "available_metrics", F.array_join("available_metrics", ",")
    )


@on_workspace("metric_insight_inputs")
def _(ws):
    return st.metric_insight_inputs(ws["cleaned"], EVENT_SETTINGS)


@on_workspace("cohort_insights")
def _(ws):
    return st.cohort_insights(ws["cleaned"], EVENT_SETTINGS).select("insight_code", "insight")


@on_workspace("report_metadata")
def _(ws):
    return st.report_metadata(ws["cleaned"]).withColumn(
        "metrics_analyzed", F.array_join("metrics_analyzed", ",")
    )


# --- compliance ------------------------------------------------------------------


@on_workspace("participant_spans")
def _(ws):
    return cm.participant_spans(ws["cleaned"])


@on_workspace("metric_compliance")
def _(ws):
    return cm.metric_compliance(ws["cleaned"], EVENT_SETTINGS)


@on_workspace("daily_compliance")
def _(ws):
    return cm.daily_compliance(ws["cleaned"], EVENT_SETTINGS)


@on_workspace("daily_compliance_summary")
def _(ws):
    return cm.daily_compliance_summary(cm.daily_compliance(ws["cleaned"], EVENT_SETTINGS))


@on_workspace("overall_compliance")
def _(ws):
    return cm.overall_compliance(cm.metric_compliance(ws["cleaned"], EVENT_SETTINGS))


@on_workspace("cohort_compliance")
def _(ws):
    return cm.cohort_compliance(cm.metric_compliance(ws["cleaned"], EVENT_SETTINGS))


# --- noise and windows -------------------------------------------------------------


@on_workspace("outlier_gaps")
def _(ws):
    return (
        no.outlier_gaps(ws["cleaned"]).withColumn("at_micros", F.unix_micros("at")).drop("at")
    )


@on_workspace("outlier_clustering")
def _(ws):
    return no.outlier_clustering(ws["cleaned"])


@on_workspace("participant_outlier_clustering")
def _(ws):
    return no.outlier_clustering(ws["cleaned"], ["participant_id", "metric_type"])


@on_workspace("next_day_values")
def _(ws):
    return co.next_day_values(ws["daily"]).select(
        "participant_id", "date", *[f"{m}_next" for m in METRICS]
    )


@on_workspace("average_ranks")
def _(ws):
    pairs = co.same_day_pairs(co.eligible_days(ws["daily"]))
    return co.average_ranks(pairs, co.PAIR_KEYS).drop("pair_order", "a", "b")


@on_workspace("rolling_correlations")
def _(ws):
    return co.rolling_correlations(ws["daily"]).drop("pair_order")


@on_workspace("rolling_summary")
def _(ws):
    return co.rolling_summary(ws["rolling"]).select(
        "participant_id", "pair", "windows", "valid_windows", "mean_correlation", "std_correlation"
    )


@on_workspace("rolling_trends")
def _(ws):
    return co.rolling_summary(ws["rolling"]).select(
        "participant_id", "pair", "trend", "slope", "strength_change"
    )


@on_workspace("anomaly_gaps")
def _(ws):
    return an.anomaly_gaps(ws["anomaly_days"]).select(
        "participant_id", "metric_type", "date", "gap_days"
    )


# --- correlation --------------------------------------------------------------------

COEFFICIENTS = [
    "pearson_r",
    "pearson_p",
    "pearson_significant",
    "spearman_r",
    "spearman_p",
    "spearman_significant",
]


@on_workspace("eligible_days")
def _(ws):
    return co.eligible_days(ws["daily"]).select("participant_id", "date", "days")


@on_workspace("daily_correlations")
def _(ws):
    return co.daily_correlations(ws["daily"]).select(
        "participant_id", "pair", "n_days", *COEFFICIENTS
    )


@on_workspace("lag_correlations")
def _(ws):
    return co.lag_correlations(ws["daily"]).select(
        "participant_id", "pair", "n_days", *COEFFICIENTS
    )


@on_workspace("confidence_levels")
def _(ws):
    return ws["correlations"].select("participant_id", "pair", "confidence")


@on_workspace("interpretations")
def _(ws):
    return ws["correlations"].select("participant_id", "pair", "interpretation")


@on_workspace("lag_interpretations")
def _(ws):
    return ws["lags"].select("participant_id", "pair", "confidence", "interpretation")


@on_workspace("cohort_correlations")
def _(ws):
    return co.cohort_correlations(ws["cleaned"]).select("pair", "n_participants", *COEFFICIENTS)


@on_workspace("correlation_totals")
def _(ws):
    return co.correlation_totals(ws["correlations"])


# --- anomalies and deviations -----------------------------------------------------------


@on_workspace("anomaly_bounds")
def _(ws):
    return an.anomaly_bounds(co.eligible_days(ws["daily"]))


@on_workspace("anomaly_days")
def _(ws):
    return an.anomaly_days(ws["daily"]).drop("recovered_after")


@on_workspace("recovery_days")
def _(ws):
    return an.anomaly_days(ws["daily"]).select(
        "participant_id", "metric_type", "date", "recovered_after"
    )


@on_workspace("recovery_summary")
def _(ws):
    return an.recovery_summary(ws["anomaly_days"])


@on_workspace("anomaly_insights")
def _(ws):
    return an.anomaly_summary(ws["anomaly_days"]).select(
        "participant_id",
        "metric_type",
        "anomaly_count",
        "anomaly_percentage",
        "frequency_code",
        "recovery_code",
        "clustered",
        F.array_join("insights", "; ").alias("sentences"),
    )


@on_workspace("deviation_stats")
def _(ws):
    return de.deviation_stats(da.daily_named_means(ws["cleaned"]))


@on_workspace("z_deviations")
def _(ws):
    return de.z_deviations(ws["cleaned"])


@on_workspace("participant_z_deviations")
def _(ws):
    return de.z_deviations(ws["cleaned"], ["participant_id"])


@on_workspace("deviation_day_meals")
def _(ws):
    out = de.meals_on_deviation_days(de.z_deviations(ws["cleaned"]), ws.meals)
    return out.withColumn("deviating_metrics", F.array_join("deviating_metrics", ","))


@on_workspace("threshold_deviations")
def _(ws):
    return de.threshold_deviations(ws["cleaned"], settings=EVENT_SETTINGS)


@on_workspace("cohort_threshold_deviations")
def _(ws):
    return de.threshold_deviations(ws["cleaned"], (), EVENT_SETTINGS)


@on_workspace("threshold_deviation_meals")
def _(ws):
    found = de.threshold_deviations(ws["cleaned"], settings=EVENT_SETTINGS)
    out = de.deviation_days_with_meals(found, ws.meals)
    return out.select(
        "participant_id",
        "date",
        F.array_join(F.transform("deviations", lambda x: x["metric_type"]), ",").alias("metrics"),
        "meal_time",
        "dish",
        "servings",
    )


@on_workspace("deviating_days")
def _(ws):
    found = de.threshold_deviations(ws["cleaned"], settings=EVENT_SETTINGS)
    item = F.col("item")
    # One row per day, its list turned into columns of the first and the number.
    return de.deviating_days(found, ws.meals).select(
        "day_id",
        "participant_id",
        "date",
        "meals",
        F.size("deviations").alias("deviating_metrics"),
        F.array_join(
            F.transform(
                "deviations",
                lambda x: F.concat(x["metric_type"], F.when(x["outside_threshold"], "!").otherwise("")),
            ),
            ",",
        ).alias("metrics"),
        F.element_at("deviations", 1).alias("item"),
    ).select("*", item["value"].alias("first_value"), item["deviation_pct"].alias("first_pct")).drop("item")


@on_workspace("deviating_day_dishes")
def _(ws):
    found = de.threshold_deviations(ws["cleaned"], settings=EVENT_SETTINGS)
    return de.deviating_day_dishes(found, ws.meals)


@on_workspace("deviation_report")
def _(ws):
    return de.deviation_report(de.z_deviations(ws["cleaned"]), ws.meals)


# --- meals and top lists -------------------------------------------------------------------


def _cohort_days(ws: Workspace) -> DataFrame:
    return da.daily_wide(ws["cleaned"], ())


@on_workspace("meal_interactions")
def _(ws):
    return me.meal_interactions(ws.meals, _cohort_days(ws))


@on_workspace("recent_common_dates")
def _(ws):
    return me.recent_common_dates(ws.meals, _cohort_days(ws))


@on_workspace("top_dishes")
def _(ws):
    return me.top_dishes(ws.meals)


@on_workspace("ranked_correlations")
def _(ws):
    return rep.ranked_correlations(ws["correlations"]).select(
        "participant_id", "pair", "rank", "pearson_r3"
    )


@on_workspace("top_weak_correlations")
def _(ws):
    return rep.top_weak_correlations(rep.correlation_buckets(ws["correlations"])).select(
        "participant_id", "pair", "place", "strength"
    )


@on_workspace("first_anomalies")
def _(ws):
    return rep.first_anomalies(ws["anomaly_days"])


# --- insights ----------------------------------------------------------------------------------


def _advice(ws: Workspace) -> DataFrame:
    return ins.recommendations(
        ws["baselines"], ws["correlations"], ws["anomalies"], EVENT_SETTINGS
    )


def _findings(ws: Workspace) -> DataFrame:
    return ins.key_findings(ws["baselines"], ws["correlations"], ws["anomalies"], EVENT_SETTINGS)


INSIGHT = ["participant_id", "family", "code", "text"]


@on_workspace("health_summary")
def _(ws):
    return ins.health_summary(ws["baselines"]).select("participant_id", "code", "text")


@on_workspace("data_quality_score")
def _(ws):
    return ins.data_quality_score(ws["baselines"])


@on_workspace("baseline_findings")
def _(ws):
    return ins.baseline_findings(ws["baselines"], EVENT_SETTINGS).select(
        "participant_id", "code", "text"
    )


@on_workspace("correlation_findings")
def _(ws):
    return ins.correlation_findings(ws["correlations"]).select("participant_id", "code", "text")


@on_workspace("anomaly_findings")
def _(ws):
    return ins.anomaly_findings(ws["anomalies"], EVENT_SETTINGS).select(
        "participant_id", "code", "text"
    )


@on_workspace("peak_hour_insights")
def _(ws):
    return ins.peak_hour_insights(ws["hourly"]).select(INSIGHT)


@on_workspace("lag_insights")
def _(ws):
    return ins.lag_insights(ws["lags"]).select("participant_id", "code", "text")


@on_workspace("weekday_insights")
def _(ws):
    return ins.weekday_insights(ws["weekdays"]).select(INSIGHT)


@on_workspace("recommendations")
def _(ws):
    return _advice(ws).select(
        "participant_id",
        "code",
        "category",
        "priority",
        "target",
        F.array_join("action_items", "; ").alias("actions"),
        "recommendation",
    )


@on_workspace("recommendations_by_priority")
def _(ws):
    return ins.by_priority(_advice(ws)).select(
        "participant_id", "priority_rank", "item_order", "code"
    )


@on_workspace("priority_groups")
def _(ws):
    return rep.priority_groups(_advice(ws))


@on_workspace("progress_insights")
def _(ws):
    return ins.progress_insights(ws["trends"], ws["anomalies"]).select(
        "participant_id", "code", "text"
    )


@on_workspace("all_insights")
def _(ws):
    return ins.all_insights(ws.insight_tables(), EVENT_SETTINGS).select(INSIGHT)


@on_workspace("participant_assembly")
def _(ws):
    return document_rows(participant_documents(ws))


# --- report tables --------------------------------------------------------------------------------


@on_workspace("participant_overview")
def _(ws):
    return rep.participant_overview(ws["baselines"], _findings(ws))


@on_workspace("quality_tiers")
def _(ws):
    return rep.quality_tiers(qu.metric_quality(ws["cleaned"]))


@on_workspace("data_coverage")
def _(ws):
    return rep.data_coverage(qu.metric_availability(qu.participant_files(_files(ws))))


@on_workspace("correlation_matrix")
def _(ws):
    return rep.correlation_matrix(ws["correlations"])


@on_workspace("correlation_buckets")
def _(ws):
    return rep.correlation_buckets(ws["correlations"]).select(
        "participant_id", "pair", "strength", "direction", "bucket", "shown"
    )


@on_workspace("pattern_badges")
def _(ws):
    return rep.with_pattern_texts(rep.correlation_buckets(ws["correlations"])).select(
        "participant_id", "pair", "badge", "explanation_code", "badge_text", "explanation"
    )


@on_workspace("correlation_cards")
def _(ws):
    return rep.correlation_cards(ws["correlations"])


@on_workspace("correlation_counts")
def _(ws):
    return rep.correlation_counts(ws["correlations"])


@on_workspace("significant_correlations")
def _(ws):
    return rep.significant_correlations(ws["correlations"])


@on_workspace("metrics_overview")
def _(ws):
    return rep.metrics_overview(ws["baselines"])


@on_workspace("cohort_totals")
def _(ws):
    return rep.cohort_totals(ws["cleaned"], _findings(ws), _advice(ws))


@on_workspace("completeness_tiers")
def _(ws):
    return rep.completeness_tiers(
        cm.overall_compliance(cm.metric_compliance(ws["cleaned"], EVENT_SETTINGS))
    )


@on_workspace("data_types_table")
def _(ws):
    return rep.data_types_table(
        qu.metric_availability(qu.participant_files(_files(ws))), qu.metric_quality(ws["cleaned"])
    )


@on_tables("source_availability")
def _(spark, sf_dir):
    ws = event_workspace(spark, sf_dir)
    lungs = read_table(spark, sf_dir, "part")
    return rep.source_availability({"physio": ws.records, "meals": ws.meals, "lungs": lungs})


@on_tables("headline_table")
def _(spark, sf_dir):
    ws = event_workspace(spark, sf_dir)
    part = read_table(spark, sf_dir, "part")
    return rep.headline_table(
        st.headline_means(ws["cleaned"]),
        st.fuzzy_means(part, {**st.MEAL_PATTERNS, "avg_fat": "size"}),
        st.fuzzy_means(part, {"avg_fev1": "price", "avg_fvc": "fvc"}),
    )
