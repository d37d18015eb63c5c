"""Exact dedup: groups by a 128-bit hash, proven by comparing bytes.

Texts move only once, and only those of groups with more than one row are
kept: the rows of such groups are staged, and each group's smallest and largest
text are compared. They are equal exactly if all texts of the group are. Both
combine before the shuffle, so a group of any size is no burden. Groups that
fail are grouped once more by the text itself.

Null texts count as empty. Rows that repeat a document (same id, same text)
count in ``group_size`` and get the same answer.
Null ids come after all others. Other columns of the input play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.llm.common import STAGED, discard_since, read_table, stage


def _groups(rows: DataFrame, keep: str, *keys: str) -> DataFrame:
    """One row per group of equal keys: rows, and the id that stays."""
    best = F.max("id") if keep == "largest" else F.min("id")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size"), best.alias("keep_id"))


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """Every row's id, keep_id, group_size, kept and text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), content_hash(text).alias("hash"))
    slim = stage(
        rows.select("id", "hash", F.sha2("text", 256).alias("text_sha256")), "exact-hashes"
    )
    groups = stage(_groups(slim, keep, "hash"), "exact-groups")
    copies = groups.filter("group_size > 1").select(F.col("hash").alias("copied"))
    members = stage(rows.join(copies, F.col("hash") == F.col("copied")).select("hash", "text"), "exact-members")
    collided = stage(
        members.groupBy("hash")
        .agg(F.min("text").alias("lo"), F.max("text").alias("hi"))
        .filter("lo != hi")
        .select("hash"),
        "exact-collided",
    )
    found = slim.withColumn("content", F.lit(None).cast("string"))
    if not collided.isEmpty():
        apart = rows.join(collided, "hash").select(
            "id", "hash", F.sha2("text", 256).alias("text_sha256"), F.col("text").alias("content")
        )
        found = found.join(collided, "hash", "left_anti").unionByName(apart)
        groups = groups.join(collided, "hash", "left_anti").withColumn(
            "content", F.lit(None).cast("string")
        ).unionByName(_groups(apart, keep, "hash", "content"))
        on = (found["hash"] == groups["hash"]) & found["content"].eqNullSafe(groups["content"])
    else:
        on = found["hash"] == groups["hash"]
    joined = found.join(groups, on).select(
        "id", "keep_id", "group_size", found["text_sha256"],
        F.coalesce(F.col("id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"),
    )
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, all their columns, one per distinct text.

    A document whose row is repeated stays once.
    """
    mark = len(STAGED)
    groups = exact_groups(docs, id_col, text_col, keep).filter("kept")
    twice = F.col("n") > 1
    ids = stage(
        groups.groupBy(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha256")).agg(F.count(F.lit(1)).alias("n")),
        "exact-kept",
    )
    discard_since(mark, ids)
    sha = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    stay = docs.join(ids, docs[id_col].eqNullSafe(ids["kept_id"]) & (sha == ids["kept_sha256"]))
    once = stay.filter(~twice).select(*[docs[c] for c in docs.columns])
    again = stay.filter(twice).dropDuplicates(["kept_id", "kept_sha256"]).select(*[docs[c] for c in docs.columns])
    return once.unionByName(again)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_groups(read_table(spark, sf_dir, "documents"), keep="largest")


OP3_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""
