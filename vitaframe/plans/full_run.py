"""The whole analysis, from export folders to result tables and documents."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.config import DEFAULTS, PARITY_DEVIATION_LIMITS, Settings
from vitaframe.operators import compliance as cm
from vitaframe.operators import correlation as co
from vitaframe.operators import daily as da
from vitaframe.operators import deviations as de
from vitaframe.operators import insights as ins
from vitaframe.operators import meals as me
from vitaframe.operators import noise as no
from vitaframe.operators import quality as qu
from vitaframe.operators import reports as rep
from vitaframe.operators import statistics as st
from vitaframe.plans.documents import participant_documents
from vitaframe.plans.workspace import Workspace
from vitaframe.session import stage_table, tune
from vitaframe.sources.files import discover_files, read_lungs, read_meals, read_records
from vitaframe.sources.sinks import (
    combined_documents,
    write_participant_documents,
    write_table,
    write_tables,
)


def open_workspace(
    spark: SparkSession, input_dir: str, settings: Settings = DEFAULTS, mode: str = "corrected"
) -> Workspace:
    """Records and meals of an export folder, ready for analysis."""
    tune(spark)
    label = "files-" + hashlib.sha256(f"{input_dir}|{mode}".encode()).hexdigest()[:12]
    # Parsed once: positions are then fixed on disk, and no step reads text again.
    records = stage_table(read_records(spark, input_dir, mode), f"{label}-records")
    return Workspace(records, read_meals(spark, input_dir), settings, label)


def loading_tables(spark: SparkSession, input_dir: str, meals: DataFrame) -> dict[str, DataFrame]:
    tables = qu.loading_summary(discover_files(spark, input_dir))
    tables["meals_data"] = me.meals_summary(meals)
    tables["lungs_data"] = st.table_summary(read_lungs(spark, input_dir))
    return tables


def technical_tables(ws: Workspace) -> dict[str, DataFrame]:
    cleaned, settings = ws["cleaned"], ws.settings
    scores = cm.metric_compliance(cleaned, settings)
    daily = cm.daily_compliance(cleaned, settings)
    return {
        "report_metadata": st.report_metadata(cleaned),
        "participant_spans": cm.participant_spans(cleaned),
        "metric_compliance": scores,
        "daily_compliance": daily,
        "daily_compliance_summary": cm.daily_compliance_summary(daily),
        "overall_compliance": cm.overall_compliance(scores),
        "cohort_compliance": cm.cohort_compliance(scores),
        "metric_noise": no.metric_noise(cleaned),
        "outlier_clustering": no.outlier_clustering(cleaned),
        "summary_statistics": st.metric_statistics(cleaned),
        "cross_metric_correlations": co.cohort_correlations(cleaned),
        "temporal_trends": st.calendar_profiles(cleaned),
        "cohort_insights": st.cohort_insights(cleaned, settings),
    }


def correlation_tables(ws: Workspace) -> dict[str, DataFrame]:
    return {
        "data_summary": st.correlation_data_summary(ws["daily"], ws.settings.min_days),
        "daily_correlations": ws["correlations"],
        "lag_correlations": ws["lags"],
        "rolling_correlations": ws["trends"],
        "anomaly_analysis": ws["anomalies"],
        "correlation_totals": co.correlation_totals(ws["correlations"]),
    }


def deviation_tables(ws: Workspace, parity: bool = False) -> dict[str, DataFrame]:
    cleaned = ws["cleaned"]
    z = de.z_deviations(cleaned)
    limits = (
        Settings(ws.settings.metrics, ws.settings.rules, PARITY_DEVIATION_LIMITS)
        if parity
        else ws.settings
    )
    by = () if parity else ("participant_id",)
    found = de.threshold_deviations(cleaned, by, limits)
    # Exported meals name their own users, not participants: join by date.
    together = found if parity else de.threshold_deviations(cleaned, (), limits)
    return {
        "deviation_metrics": de.deviation_stats(da.daily_named_means(cleaned)),
        "significant_changes": z,
        "meal_correlations": de.meals_on_deviation_days(z, ws.meals),
        "deviation_report": de.deviation_report(z, ws.meals),
        "threshold_deviations": found,
        "deviating_days": de.deviating_days(together, ws.meals, ()),
        "deviating_day_dishes": de.deviating_day_dishes(together, ws.meals, ()),
    }


def report_tables(
    spark: SparkSession, ws: Workspace, input_dir: str
) -> dict[str, DataFrame]:
    cleaned, settings = ws["cleaned"], ws.settings
    lungs = read_lungs(spark, input_dir)
    correlations = ws["correlations"]
    quality = qu.metric_quality(cleaned)
    available = qu.metric_availability(qu.participant_files(discover_files(spark, input_dir)))
    findings = ins.key_findings(ws["baselines"], correlations, ws["anomalies"], settings)
    advice = ins.recommendations(ws["baselines"], correlations, ws["anomalies"], settings)
    buckets = rep.with_pattern_texts(rep.correlation_buckets(correlations))
    days = da.daily_wide(cleaned, ())
    return {
        "participant_overview": rep.participant_overview(ws["baselines"], findings),
        "finding_severity": ins.finding_severity(findings),
        "quality_tiers": rep.quality_tiers(quality),
        "data_types": rep.data_types_table(available, quality),
        "data_coverage": rep.data_coverage(available),
        "completeness": rep.completeness_tiers(
            cm.overall_compliance(cm.metric_compliance(cleaned, settings))
        ),
        "metrics_overview": rep.metrics_overview(ws["baselines"]),
        "correlation_matrix": rep.correlation_matrix(correlations),
        "correlation_patterns": buckets,
        "correlation_cards": rep.correlation_cards(correlations),
        "correlation_counts": rep.correlation_counts(correlations),
        "ranked_correlations": rep.ranked_correlations(correlations),
        "significant_correlations": rep.significant_correlations(correlations),
        "first_anomalies": rep.first_anomalies(ws["anomaly_days"]),
        "priority_groups": rep.priority_groups(advice),
        "cohort_totals": rep.cohort_totals(cleaned, findings, advice),
        "source_availability": rep.source_availability(
            {"physio": ws.records, "meals": ws.meals, "lungs": lungs}
        ),
        "headlines": rep.headline_table(
            st.headline_means(cleaned),
            st.fuzzy_means(ws.meals, st.MEAL_PATTERNS),
            st.fuzzy_means(lungs, st.LUNG_PATTERNS),
        ),
        "daily_meals": me.daily_meals(ws.meals),
        "top_dishes": me.top_dishes(ws.meals),
        "meal_interactions": me.meal_interactions(ws.meals, days),
    }


def run_all(
    spark: SparkSession,
    input_dir: str,
    output_dir: str,
    settings: Settings = DEFAULTS,
    mode: str = "corrected",
    fmt: str = "json",
    file_per_participant: bool = False,
) -> Workspace:
    """Read, clean, analyse and write everything below ``output_dir``."""
    ws = open_workspace(spark, input_dir, settings, mode)

    def folder(name: str) -> str:
        return os.path.join(output_dir, name)

    write_tables(loading_tables(spark, input_dir, ws.meals), folder("raw_data_summary"), fmt)
    write_tables(qu.quality_reports(ws["cleaned"]), folder("cleaning_report"), fmt)
    write_tables(technical_tables(ws), folder("technical_analysis"), fmt)
    write_tables(correlation_tables(ws), folder("correlation_analysis"), fmt)
    write_tables(deviation_tables(ws, mode == "parity"), folder("deviations"), fmt)
    write_tables(report_tables(spark, ws, input_dir), folder("report"), fmt)
    documents = participant_documents(ws)
    write_participant_documents(
        documents, folder("participant_insights"), file_per_participant
    )
    write_table(
        combined_documents(documents, F.current_timestamp()), output_dir, "analysis_results", fmt
    )
    return ws
