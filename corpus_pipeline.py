"""The corpus pipeline: documents through five of the text operators.

Each stage takes (spark, docs, sf_dir) and returns the rows for the next one, which
reads them again from Parquet. All stages but the last return the columns of
``documents``. Null texts are rejected by the first stage; the later stages handle
them as their operators state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.llm.bpe import round_trip, vocabulary_path
from vitaframe.llm.common import read_table, stage
from vitaframe.llm.exact_dedup import drop_copies
from vitaframe.llm.jaccard_join import drop_near_copies
from vitaframe.llm.language_id import UNKNOWN, identify
from vitaframe.llm.mixing import mix

MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language cannot be told: no letters, or a low score."""
    found = identify(docs, F.lit(True), with_rows=True)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles (0.8 or more), the smallest doc_id stays."""
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    mixed = mix(docs, with_rows=True)
    again = mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select("row.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    return round_trip(docs, vocabulary_path())


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("mixture", mixture),
    ("tokens", tokens),
]

# SQL cannot express the language model, the join or the tokens.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
