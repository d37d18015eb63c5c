"""Mixing sources to target weights by weighted fair queueing.

Every document may be taken up to ``epochs`` times. Within a source and round the
documents stand in shuffled order (by md5), and each copy gets its virtual finish
time: the words of its source up to and including it, divided by the source's
target. All copies are then put in one order by finish time, and those are taken
whose words, added up in that order, stay within the budget.

No task holds a source: running sums are taken within slices of the shuffled
order, whose number follows the row count, on top of the sums of the slices
before. The place where the budget ends is found the same way: by sums per slice
of the finish time, and then by sorting the one slice in which it ends.

Targets: sources in the order of their code points, null last, weigh as in
``weights``, repeated; they share ``budget`` times all words; a target stops at
``epochs`` times its source's words and the excess goes to the others by weight.

Null texts have no words. Documents without words are never taken (``taken`` 0).
Rows that repeat a document are documents of their own; such rows are alike, so
their order does not matter. Null ids shuffle like an empty id. Extra columns play
no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaframe.llm.common import count_words, read_table, stage

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
EPOCHS = 2
SLICE_ROWS = 4096
LEVEL_SLICES = 4096


def source_targets(
    sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS
) -> DataFrame:
    """One row per source: its words, weight and target.

    With sources in the order of limit per weight, those at the front stop at
    their limit; the level of the rest is what remains, divided by their weights.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    t = per_source.withColumn("weight", F.get(cycle, (F.row_number().over(place) - 1) % len(weights)))
    t = t.withColumn("limit", (epochs * F.col("source_size")).cast("double"))
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy())
    level = (budget * total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    t = t.withColumn("rank", F.row_number().over(order)).withColumn("level", level)
    under = F.when(F.col("limit") / F.col("weight") > F.col("level"), F.struct("rank", "level"))
    t = t.withColumn("first", F.min(under).over(W.partitionBy()))
    full = F.col("first").isNull() | (F.col("rank") < F.col("first.rank"))
    target = F.when(full, F.col("limit")).otherwise(F.col("first.level") * F.col("weight"))
    return t.select("source", "source_size", target.alias("target"))


def _before(sums: DataFrame, group: list[str], slice_col: str, level: int = LEVEL_SLICES) -> DataFrame:
    """Per group and slice, the words in the slices before.

    Added up in two levels: over each ``level`` slices, and within them.
    """
    sums = sums.withColumn("_part", F.floor(F.col(slice_col) / level).cast("long"))
    keys = [*group, "_part"]

    def running(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
        window = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum("words").over(window), F.lit(0)))

    parts = running(sums.groupBy(*keys).agg(F.sum("words").alias("words")), group, "_part", "_earlier")
    parts = parts.select(*[F.col(k).alias(f"p_{k}") for k in keys], "_earlier")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"p_{k}"))
    inside = running(sums, keys, slice_col, "_inside").join(parts, same)
    return inside.withColumn("words_before", F.col("_earlier") + F.col("_inside")).select(*sums.columns[:-1], "words_before")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    budget: float = BUDGET,
    epochs: int = EPOCHS,
    with_rows: bool = False,
) -> DataFrame:
    """Every document's id, source, size, source_size, target, taken and copies.

    ``with_rows`` adds the struct ``row`` with all columns of ``docs``.
    """
    payload = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if with_rows else []
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        count_words(F.col(text_col)).alias("size"), *payload,
    )
    shuffled = F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = sized.withColumn("shuffled", shuffled)
    slim = stage(rows.drop("row"), "mix-sizes")
    slices = max(1, -(-slim.count() * epochs // SLICE_ROWS))
    place = F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long")
    slice_of = F.floor(place * slices / F.lit(2.0**32)).cast("long")
    targets = stage(source_targets(slim, weights, budget, epochs), "mix-targets")
    sums = slim.groupBy("source", slice_of.alias("slice")).agg(F.sum("size").alias("words"))
    start = _before(sums, ["source"], "slice").select(
        F.col("source").alias("s"), F.col("slice").alias("p"), "words_before"
    )

    def finished(part: DataFrame) -> DataFrame:
        """Adds target, source_size and the words up to the row in its source."""
        part = part.withColumn("slice", slice_of)
        part = part.join(start, part["source"].eqNullSafe(start["s"]) & (part["slice"] == start["p"])).drop("s", "p")
        order = W.partitionBy("source", "slice").orderBy("shuffled", "id", "size")
        within = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
        part = part.withColumn("through", F.col("words_before") + within).drop("words_before", "slice")
        t = targets.withColumnRenamed("source", "t")
        return part.join(t, part["source"].eqNullSafe(t["t"])).drop("t")

    def finish(epoch) -> Column:
        """Virtual finish time of the copy of a round (0 is the first)."""
        words = F.col("through") + epoch * F.col("source_size")
        return F.try_divide(words.cast("double"), F.col("target"))

    copies = finished(slim).filter("size > 0 AND target > 0")
    copies = copies.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.withColumn("finish", finish(F.col("epoch"))).select("finish", "shuffled", "id", "size")
    # The budget ends about finish 1, so what comes after 4 is counted, never sorted.
    finish_slice = F.floor(F.least("finish", F.lit(4.0)) * slices).cast("long")
    copies = stage(copies.withColumn("slice", finish_slice), "mix-copies")
    total = targets.agg(F.round(F.sum("target")).cast("long").alias("total"))
    served = _before(copies.groupBy("slice").agg(F.sum("size").alias("words")), [], "slice")
    # The first slice that does not fit as a whole; one row at most.
    last = served.join(total, F.col("words_before") + F.col("words") > F.col("total")).agg(
        F.min(F.struct("slice", "words_before", "total")).alias("last")
    )
    last = last.select("last.*").first()
    cut = None
    if last["slice"] is not None:
        order = W.orderBy("finish", "shuffled", "id", "size")
        through = last["words_before"] + F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
        inside = copies.filter(F.col("slice") == last["slice"]).withColumn("served", through)
        cut = inside.filter(F.col("served") > last["total"]).orderBy("served").first()
    taken = F.lit(0)
    for epoch in range(epochs):
        fits = F.lit(True)
        if cut is not None:
            key = F.struct(finish(F.lit(epoch)).alias("f"), F.col("shuffled"), F.col("id"))
            first_out = F.struct(F.lit(cut["finish"]).alias("f"), F.lit(cut["shuffled"]).alias("shuffled"), F.lit(cut["id"]).cast(slim.schema["id"].dataType).alias("id"))
            fits = key < first_out
        taken = taken + F.when(fits & (F.col("size") > 0) & (F.col("target") > 0), 1).otherwise(0)
    out = finished(rows if with_rows else slim).withColumn("copies", taken)
    return out.select(
        "id", "source", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies",
        *(["row"] if with_rows else []),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(read_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP6_SQL = """
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffled,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
    (2 * source_size)::DOUBLE AS lim FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS rank FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(lim) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM o),
f AS (
  SELECT min(rank) AS rank, min_by(level, rank) AS level FROM l WHERE lim / weight > level),
t AS (
  SELECT l.source, source_size,
    CASE WHEN f.rank IS NULL OR l.rank < f.rank THEN lim ELSE f.level * weight END AS target FROM l, f),
c AS (
  SELECT d.*, source_size, target,
    sum(size) OVER (PARTITION BY d.source ORDER BY shuffled, doc_id, size ROWS UNBOUNDED PRECEDING) AS through
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT c.*, CAST(through + epoch * source_size AS DOUBLE) / target AS finish
  FROM c, (VALUES (0), (1)) AS v(epoch) WHERE size > 0 AND target > 0),
q AS (
  SELECT *, sum(size) OVER (ORDER BY finish, shuffled, doc_id, size ROWS UNBOUNDED PRECEDING) AS served FROM e),
k AS (
  SELECT doc_id, sum(size) AS taken FROM q, (SELECT round(sum(target)) AS total FROM t) WHERE served <= total GROUP BY doc_id)
SELECT c.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM c LEFT JOIN k ON c.doc_id = k.doc_id
"""
