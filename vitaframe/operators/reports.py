"""Tables behind the report pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaframe.config import METRIC_TITLES, METRICS, OVERVIEW_TITLES
from vitaframe.functions.scalar import fixed, percent, sentence
from vitaframe.operators.insights import primary
from vitaframe.texts import BADGES, CARD_TEXTS, EXPLANATIONS


def tier(value: Column, high: float, medium: float) -> Column:
    return (
        F.when(value >= high, F.lit("high"))
        .when(value >= medium, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def quality_tiers(metric_quality: DataFrame) -> DataFrame:
    """Quality tier of each metric by its share of good rows."""
    return metric_quality.select(
        "metric_type",
        "total_records",
        F.col("good").alias("good_records"),
        "good_data_percentage",
        tier(F.col("good_data_percentage"), 80, 50).alias("quality_tier"),
    )


def data_coverage(availability: DataFrame) -> DataFrame:
    """How many of the six metrics have data at all."""
    return availability.agg(
        F.count_if(F.col("participants") > 0).alias("available_metrics")
    ).withColumn("data_coverage", F.col("available_metrics") / float(len(METRICS)) * 100.0)


def completeness_tiers(scores: DataFrame) -> DataFrame:
    """Completeness tier of overall compliance scores."""
    return scores.withColumn("completeness_tier", tier(F.col("score"), 90, 70))


def _dimension(df: DataFrame, rows: list[Column]) -> DataFrame:
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def data_types_table(availability: DataFrame, metric_quality: DataFrame) -> DataFrame:
    """The six metrics with availability and record statistics, 0 where absent."""
    titles = _dimension(
        availability,
        [
            F.struct(F.lit(m).alias("metric_type"), F.lit(t).alias("title"))
            for m, t in METRIC_TITLES.items()
        ],
    )
    seen = availability.where(F.col("participants") > 0).select(
        "metric_type", F.lit(True).alias("available")
    )
    stats = metric_quality.select(
        "metric_type", "total_records", "good_data_percentage", "participants_with_data"
    )
    joined = titles.join(seen, "metric_type", "left").join(stats, "metric_type", "left")

    def known(name: str, default: float | int) -> Column:
        return F.coalesce(F.when(F.col("available"), F.col(name)), F.lit(default)).alias(name)

    return joined.select(
        "metric_type",
        "title",
        F.coalesce("available", F.lit(False)).alias("available"),
        known("total_records", 0),
        known("good_data_percentage", 0.0),
        known("participants_with_data", 0),
    )


def participant_overview(baselines: DataFrame, findings: DataFrame) -> DataFrame:
    """Records, score, number of metrics and first two findings per participant."""
    totals = primary(baselines).groupBy("participant_id").agg(
        F.sum("count").alias("total_records"), F.count(F.lit(1)).alias("metrics")
    )
    first = findings.groupBy("participant_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("item_order", "code", "text"))), 1, 2).alias(
            "_first"
        )
    )
    return totals.join(first, "participant_id", "left").select(
        "participant_id",
        "total_records",
        F.least(F.col("total_records"), F.lit(100)).alias("quality_score"),
        "metrics",
        F.array_join(F.transform("_first", lambda x: x["code"]), "; ").alias("finding_codes"),
        F.coalesce(
            F.array_join(F.transform("_first", lambda x: x["text"]), "; "),
            F.lit("No significant findings"),
        ).alias("findings"),
    )


def metrics_overview(baselines: DataFrame) -> DataFrame:
    """Six rows per participant, null where a metric has no baseline."""
    means = primary(baselines).groupBy("participant_id").agg(
        *[
            F.max(F.when(F.col("metric_type") == m, F.col("mean_1"))).alias(m)
            for m in METRICS
        ]
    )
    return means.select(
        "participant_id",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric_type"),
                        F.lit(title).alias("title"),
                        F.lit(unit).alias("unit"),
                        F.col(m).alias("mean"),
                    )
                    for m, (title, unit) in OVERVIEW_TITLES.items()
                ]
            )
        ),
    )


def _ranked(correlations: DataFrame) -> Column:
    order = W.partitionBy("participant_id").orderBy(
        F.desc(F.abs(F.coalesce("pearson_r3", F.lit(0.0)))), "pair_order"
    )
    return F.row_number().over(order)


def ranked_correlations(correlations: DataFrame) -> DataFrame:
    """A participant's correlations from strong to weak; at most 15."""
    return correlations.withColumn("rank", _ranked(correlations))


def correlation_matrix(correlations: DataFrame) -> DataFrame:
    """Symmetric matrix per participant: diagonal 1, unknown pairs 0."""
    r = F.col("pearson_r3")

    def cell(row: str | Column, column: str | Column, value: Column) -> Column:
        row = F.col(row) if isinstance(row, str) else row
        column = F.col(column) if isinstance(column, str) else column
        return F.struct(row.alias("metric_type"), column.alias("other"), value.alias("v"))

    cells = F.array(
        cell("metric_1", "metric_2", r),
        cell("metric_2", "metric_1", r),
        cell("metric_1", "metric_1", F.lit(1.0)),
        cell("metric_2", "metric_2", F.lit(1.0)),
    )
    return (
        correlations.select("participant_id", F.inline(cells))
        .groupBy("participant_id", "metric_type")
        .agg(
            *[
                F.coalesce(F.max(F.when(F.col("other") == m, F.col("v"))), F.lit(0.0)).alias(m)
                for m in METRICS
            ]
        )
    )


def correlation_buckets(correlations: DataFrame) -> DataFrame:
    """Correlations sorted into patterns, with badge and explanation code.

    Weak patterns are marked ``shown`` only when a participant has nothing
    stronger, and then only the strongest three.
    """
    r, size = F.col("pearson_r3"), F.abs("pearson_r3")
    bucket = (
        F.when((size >= 0.6) & (r > 0), F.lit("strong_positive"))
        .when(size >= 0.6, F.lit("strong_negative"))
        .when(size >= 0.3, F.lit("moderate"))
        .when(size >= 0.1, F.lit("weak"))
    )
    everyone = W.partitionBy("participant_id")
    weak_order = W.partitionBy("participant_id", "bucket").orderBy(F.desc("strength"), "pair_order")
    weak = F.col("bucket") == "weak"
    return (
        correlations.where((F.col("n_days") >= 3) & r.isNotNull())
        .withColumn("strength", size)
        .withColumn("bucket", bucket)
        .where("bucket is not null")
        .withColumn("direction", F.when(r > 0, "positive").otherwise("negative"))
        .withColumn("_stronger", F.max((~weak).cast("int")).over(everyone))
        .withColumn("_place", F.row_number().over(weak_order))
        .withColumn("shown", ~weak | ((F.col("_stronger") == 0) & (F.col("_place") <= 3)))
        .withColumn("badge", confidence_badge())
        .withColumn("explanation_code", explanation_code())
        .drop("_stronger", "_place")
    )


def confidence_badge() -> Column:
    return (
        F.when(F.col("pearson_significant"), F.lit("significant"))
        .when(F.col("confidence") == "pretty sure", F.lit("likely"))
        .otherwise(F.lit("emerging"))
    )


def explanation_code() -> Column:
    level = F.when(F.col("strength") >= 0.7, F.lit("high")).otherwise(F.lit("medium"))
    return F.concat_ws("_", "direction", level)


def with_pattern_texts(buckets: DataFrame) -> DataFrame:
    """Badge and explanation sentences of the codes."""
    badge = F.lit(None).cast("string")
    for code, text in BADGES.items():
        badge = F.when(F.col("badge") == code, F.lit(text)).otherwise(badge)
    explanation = F.lit(None).cast("string")
    for (direction, level), text in EXPLANATIONS.items():
        explanation = F.when(
            F.col("explanation_code") == f"{direction}_{level}", F.lit(text)
        ).otherwise(explanation)
    return buckets.withColumn("badge_text", badge).withColumn("explanation", explanation)


def top_weak_correlations(buckets: DataFrame, n: int = 3) -> DataFrame:
    """The strongest weak patterns of each participant."""
    order = W.partitionBy("participant_id").orderBy(F.desc("strength"), "pair_order")
    return (
        buckets.where("bucket = 'weak'")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= n)
    )


def correlation_cards(correlations: DataFrame) -> DataFrame:
    """Significance, strength, sample note and sentence of each correlation."""
    r, p, n = F.col("pearson_r3"), F.col("pearson_p4"), F.col("n_days")
    significant = F.col("pearson_significant") | F.col("spearman_significant")
    marginal = F.coalesce((p < 0.1) | (F.col("spearman_p4") < 0.1), F.lit(False))
    strongest = F.coalesce(F.greatest(F.abs(r), F.abs("spearman_r3")), F.lit(0.0))
    label: Callable[[Column], Column] = lambda size: (
        F.when(size >= 0.7, F.lit("strong")).when(size >= 0.4, F.lit("moderate")).otherwise(F.lit("weak"))
    )
    wording = (
        F.when(p < 0.05, F.lit("statistically significant"))
        .when(p < 0.1, F.lit("marginally significant"))
        .otherwise(F.lit("not statistically significant"))
    )
    sign = F.when(r > 0, F.lit("positive")).otherwise(F.lit("negative"))
    note = F.when(n < 10, "small").when(n < 20, "moderate").otherwise("good")
    has = lambda m: (F.col("metric_1") == m) | (F.col("metric_2") == m)
    extra = (
        F.when(has("steps") & has("sleep") & (r > 0), F.lit("steps_sleep_positive"))
        .when(has("steps") & has("sleep"), F.lit("steps_sleep_negative"))
        .when(has("hr") & has("steps") & (r > 0), F.lit("steps_hr"))
        .when(has("hr") & has("temp"), F.lit("hr_temp"))
    )

    def text_of(code: Column) -> Column:
        out = F.lit("")
        for name, text in CARD_TEXTS.items():
            out = F.when(code == name, F.lit(text)).otherwise(out)
        return out

    r_text, p_text = fixed(r, 3), fixed(p, 4)
    main = F.when(
        p < 0.05,
        sentence(
            CARD_TEXTS["clear"], label(F.abs(r)), sign, "metric_1", "metric_2", r_text, p_text,
            wording,
        ),
    ).otherwise(
        sentence(
            CARD_TEXTS["unclear"], label(F.abs(r)), sign, "metric_1", "metric_2", r_text,
            wording, p_text,
        )
    )
    return correlations.select(
        "participant_id",
        "pair",
        "n_days",
        "confidence",
        F.when(significant, F.lit("Significant"))
        .when(marginal, F.lit("Marginal"))
        .otherwise(F.lit("Not Significant"))
        .alias("significance_badge"),
        F.initcap(label(strongest)).alias("strength"),
        note.alias("sample_note"),
        extra.alias("context_code"),
        F.concat(main, text_of(F.coalesce(extra, F.lit(""))), text_of(note)).alias(
            "interpretation"
        ),
    )


def significant_correlations(correlations: DataFrame) -> DataFrame:
    """Significant same-day correlations with their tier."""
    return correlations.where("pearson_significant").select(
        "participant_id",
        "metric_1",
        "metric_2",
        F.col("pearson_r3").alias("strength"),
        F.col("pearson_p4").alias("p_value"),
        tier(F.abs("pearson_r3"), 0.7, 0.4).alias("strength_tier"),
    )


def correlation_counts(correlations: DataFrame) -> DataFrame:
    """Tests, significant results and possible trends per participant."""
    significant = F.col("pearson_significant") | F.col("spearman_significant")
    trend = F.col("confidence").isin("might be a thing", "pretty sure")
    return correlations.groupBy("participant_id").agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(significant).alias("significant_count"),
        F.count_if(trend).alias("potential_trends"),
        percent(F.count_if(significant), F.count(F.lit(1))).alias("success_rate"),
    )


def first_anomalies(anomalies: DataFrame, n: int = 3) -> DataFrame:
    """The first anomalies of each participant's metric and how many more there are."""
    keys = ["participant_id", "metric_type"]
    order = W.partitionBy(*keys).orderBy("date")
    total = F.count(F.lit(1)).over(W.partitionBy(*keys))
    return (
        anomalies.withColumn("place", F.row_number().over(order))
        .withColumn("more", F.greatest(total - n, F.lit(0)))
        .where(F.col("place") <= n)
        .select(*keys, "place", "date", "value", "more")
    )


def cohort_totals(participants: DataFrame, findings: DataFrame, advice: DataFrame) -> DataFrame:
    """Participants, findings and recommendations of the cohort."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")

    return (
        counted(participants.select("participant_id").distinct(), "participants")
        .unionByName(counted(findings, "findings"))
        .unionByName(counted(advice, "recommendations"))
    )


def priority_groups(advice: DataFrame) -> DataFrame:
    """Number of recommendations per participant and priority."""
    return advice.groupBy("participant_id", "priority").agg(
        F.max("priority_rank").alias("priority_rank"), F.count(F.lit(1)).alias("recommendations")
    )


def source_availability(sources: dict[str, DataFrame]) -> DataFrame:
    """Which sources have any row; one row is enough to tell."""
    out = None
    for name, df in sources.items():
        row = df.limit(1).agg((F.count(F.lit(1)) > 0).alias("available")).select(
            F.lit(name).alias("source"), "available"
        )
        out = row if out is None else out.unionByName(row)
    return out


# Headline rows with the value, decimals and unit of each.
HEADLINES = {
    "Heart Rate": ("avg_hr", 0, "bpm"),
    "Systolic": ("avg_systolic", 0, "mmHg"),
    "Diastolic": ("avg_diastolic", 0, "mmHg"),
    "Steps": ("avg_steps", 0, "steps/day"),
    "Sleep": ("avg_sleep", 1, "hours/day"),
    "SpO2": ("avg_spo2", 0, "%"),
    "Temperature": ("avg_temp", 1, "°F"),
    "Calories": ("avg_calories", 0, "kcal/day"),
    "Protein": ("avg_protein", 1, "g/day"),
    "Carbs": ("avg_carbs", 1, "g/day"),
    "Fat": ("avg_fat", 1, "g/day"),
    "FEV1": ("avg_fev1", 2, "L"),
    "FVC": ("avg_fvc", 2, "L"),
}


def headline_table(*one_row_tables: DataFrame) -> DataFrame:
    """Headline values as rows: name, value, text and unit; N/A where unknown."""
    out = None
    for table in one_row_tables:
        rows = [
            F.struct(
                F.lit(title).alias("title"),
                F.col(name).alias("value"),
                F.coalesce(fixed(name, digits), F.lit("N/A")).alias("text"),
                F.lit(unit).alias("unit"),
            )
            for title, (name, digits, unit) in HEADLINES.items()
            if name in table.columns
        ]
        part = table.select(F.inline(F.array(*rows)))
        out = part if out is None else out.unionByName(part)
    return out
