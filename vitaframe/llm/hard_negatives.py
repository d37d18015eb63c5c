"""Hard-negative mining with exact integer scores from residue products.

Components become whole numbers, and a score is an inner product of whole numbers. The
product of an anchor block and a row block is taken modulo several small primes: the
residues are so small that every sum of their products is exact in float32, and what
is left modulo the primes gives the signed score by Chinese remaindering (mixed radix
digits, each reduced to its smallest absolute value). How many primes are needed
follows from the longest vectors (no score is beyond the product of two lengths), and
long vectors are multiplied in stretches of dimensions.

The anchors are a stated query set, every row is scored against each. Rows stay where
they are; anchors visit them in waves of bounded size (``wave_bytes``), one broadcast
each, and a task keeps only the best few rows per anchor over all the rows it reads.
Its candidates are ranked by a window per anchor, which meets a few rows per task.
A first pass finds positives, a second the rows of other labels whose score lies in the
window that each positive opens.

Rows without a label, without a vector, or with an entry that is null or not finite
take no part. Shorter vectors count as filled up with zeros. Rows equal in id, label and
vector are one row; rows with an anchor's own id are never its positives or negatives. Vectors
so long that a score could reach 2^55 raise an error. Rows without an id take no part.
An empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vitaframe.llm.common import read_table, stage

SCALE = 256
# Bytes of one wave of anchors, which is what the driver and a broadcast hold.
WAVE_BYTES = 32 << 20
# Rows scored at a time, and anchors multiplied with them at a time.
ROW_BLOCK, ANCHOR_BLOCK = 2048, 512
# Dimensions multiplied before the sums are reduced.
STRETCH = 64
NONE = -(1 << 62)  # below any score; can be negated


def primes_for(bound: int) -> list[int]:
    """Primes whose product exceeds four times ``bound``, each small enough for float32.

    Sums of STRETCH products of residues up to (p - 1) / 2 and the sum carried over
    stay below 2^24, where every whole number is a float32.
    """
    top = 2 * int((((1 << 24) - (1 << 10)) / STRETCH) ** 0.5)
    out, product = [], 1
    for p in range(top, 2, -1):
        if product > 4 * bound:
            return out
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
    raise ValueError(f"no set of primes reaches scores of {bound}")


def reduced(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers below 2^24 in float32 to their residue of least absolute value."""
    return x - np.rint(x * np.float32(1 / p)) * np.float32(p)


def residues(vectors: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """A float32 matrix per prime."""
    out = []
    for p in primes:
        r = np.mod(vectors, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(one: list[np.ndarray], two: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products (rows of ``one`` by rows of ``two``) as int64."""
    digits: list[np.ndarray] = []
    total = np.zeros((len(one[0]), len(two[0])), np.int64)
    weight = 1
    for k, p in enumerate(primes):
        left = np.zeros(total.shape, np.float32)
        for at in range(0, one[k].shape[1], STRETCH):
            left = reduced(left + one[k][:, at : at + STRETCH] @ two[k][:, at : at + STRETCH].T, p)
        # Subtract what the digits so far make, modulo p, and divide by their weight.
        for q, digit in zip(primes, digits):  # noqa: B905
            left = reduced(reduced(left - digit, p) * np.float32(_least(pow(q, -1, p), p)), p)
        digits.append(left)
        total += left.astype(np.int64) * weight
        weight *= p
    return total


def _least(x: int, p: int) -> int:
    return x - p if x > p // 2 else x


@dataclass
class Wave:
    """A bounded set of anchors, in order of id."""

    ids: np.ndarray
    labels: np.ndarray
    parts: list[np.ndarray]
    low: np.ndarray | None = None  # per anchor and positive, the window's ends
    high: np.ndarray | None = None


class _Best:
    """The best few rows per slot: highest score first, then smallest id."""

    def __init__(self, slots: int, keep: int) -> None:
        self.score = np.full((slots, keep), NONE, np.int64)
        self.id = np.zeros((slots, keep), np.int64)

    def add(self, at: slice, found: np.ndarray, ids: np.ndarray) -> None:
        """``found``: scores by slot and row (NONE: not allowed), rows in order of id."""
        keep = self.score.shape[1]
        hit = np.flatnonzero((found >= self.score[at, -1:]).any(axis=1))
        for _ in range(keep):
            # One row at a time: the first of equal scores has the smallest id.
            hit = hit[(found[hit] != NONE).any(axis=1)]
            if not len(hit):
                return
            best = found[hit].argmax(axis=1)
            top, name = found[hit, best], ids[best]
            found[hit, best] = NONE
            slot = hit + at.start
            worse = (self.score[slot, -1] < top) | ((self.score[slot, -1] == top) & (self.id[slot, -1] > name))
            hit, slot, top, name = hit[worse], slot[worse], top[worse], name[worse]
            score = np.concatenate([self.score[slot], top[:, None]], axis=1)
            names = np.concatenate([self.id[slot], name[:, None]], axis=1)
            order = np.lexsort((names, -score), axis=1)[:, :keep]
            self.score[slot] = np.take_along_axis(score, order, axis=1)
            self.id[slot] = np.take_along_axis(names, order, axis=1)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """A list column of whole numbers as a matrix, filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _search(rows: DataFrame, wave: Wave, primes: list[int], width: int, keep: int, negatives: bool) -> DataFrame:
    """anchor (its place in the wave), anchor_id, slot, vec_id, score: the best rows per anchor and positive."""
    sent = rows.sparkSession.sparkContext.broadcast(wave)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = sent.value
        slots = anchors.low.shape[1] if negatives else 1
        best = [_Best(len(anchors.ids), keep) for _ in range(slots)]
        for batch in batches:
            for k in range(0, batch.num_rows, ROW_BLOCK):
                block = batch.slice(k, ROW_BLOCK)
                ids, labels = (block.column(i).to_numpy() for i in (0, 1))
                order = np.argsort(ids, kind="stable")
                ids, labels = ids[order], labels[order]
                parts = residues(_vectors(block.column(2), width)[order], primes)
                for a in range(0, len(anchors.ids), ANCHOR_BLOCK):
                    at = slice(a, min(a + ANCHOR_BLOCK, len(anchors.ids)))
                    found = scores([p[at] for p in anchors.parts], parts, primes)
                    same = anchors.labels[at, None] == labels
                    if negatives:
                        found[same | (anchors.ids[at, None] == ids)] = NONE
                        for s in range(slots):
                            inside = (found >= anchors.low[at, s, None]) & (found <= anchors.high[at, s, None])
                            if inside.any():
                                best[s].add(at, np.where(inside, found, NONE), ids)
                    else:
                        found[~same | (anchors.ids[at, None] == ids)] = NONE
                        best[0].add(at, found, ids)
        for s, held in enumerate(best):
            slot, place = np.nonzero(held.score != NONE)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(anchors.ids[slot]), pa.array(np.full(len(slot), s, np.int32)), pa.array(held.id[slot, place]), pa.array(held.score[slot, place])],
                ["anchor", "anchor_id", "slot", "vec_id", "score"],
            )

    found = rows.select("vec_id", "label", "x").mapInArrow(run, "anchor long, anchor_id long, slot int, vec_id long, score long")
    # Best of all tasks. A window per anchor meets ``keep`` rows of each task.
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    out = stage(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep), "negatives-found")
    sent.destroy()
    return out


def usable(rows: DataFrame, id_col: str, vector_col: str, label: Column, scale: int = SCALE) -> DataFrame:
    """vec_id, label, x (whole numbers): the rows that take part."""
    whole = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * scale))
    finite = F.forall(F.col(vector_col), lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    kept = rows.filter(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull() & finite)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("x")).distinct()


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    wave_bytes: int = WAVE_BYTES,
) -> DataFrame:
    """``rows``: vec_id, label, x as ``usable`` gives them; ``is_anchor`` is a test on vec_id.

    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for
    each anchor and each of its best rows of the same label, the best rows of other labels
    that score between the two percentages of the positive's score.
    """
    spark = rows.sparkSession
    rows = stage(rows, "negatives-rows")
    entry = "CAST(c AS DOUBLE)"
    square = F.expr(f"aggregate(x, 0D, (s, c) -> s + {entry} * {entry})")
    width, longest, n = rows.agg(F.max(F.size("x")), F.max(square), F.count_if(is_anchor)).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not n or not width:
        return empty
    if longest >= 1 << 55:
        raise ValueError(f"scores up to {longest:.3g}: percentages of them do not fit a long")
    # Room for the rounding of the squares' sum.
    primes = primes_for(int(longest * 1.000001) + 1)
    each = 8 * width + 4 * width * len(primes) + 64 * (positives + 2)
    waves = -(-n // max(1, wave_bytes // each))
    parts = []
    for k in range(waves):
        here = is_anchor & (F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == k)
        parts.append(stage(_mine_wave(rows, rows.filter(here), primes, width, positives, negatives, low_percent, high_percent), f"negatives-{k}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _mine_wave(rows: DataFrame, anchors: DataFrame, primes, width, positives, negatives, low_percent, high_percent) -> DataFrame:
    table = anchors.toArrow().sort_by("vec_id").combine_chunks()
    vectors = _vectors(table["x"].chunk(0), width) if table.num_rows else np.zeros((0, width), np.int64)
    wave = Wave(table["vec_id"].to_numpy(), table["label"].to_numpy(), residues(vectors, primes))
    best = _search(rows, wave, primes, width, positives, False)
    got = best.select("anchor", "rank", "score").toArrow()
    place, slot, score = got["anchor"].to_numpy(), got["rank"].to_numpy() - 1, got["score"].to_numpy()
    # Where low > high nothing fits: anchors with fewer positives, and negative scores.
    wave.low, wave.high = np.ones((len(vectors), positives), np.int64), np.zeros((len(vectors), positives), np.int64)
    wave.low[place, slot] = -(-score * low_percent // 100)
    wave.high[place, slot] = score * high_percent // 100
    chosen = _search(rows, wave, primes, width, negatives, True)
    best = best.select(F.col("anchor").alias("b_anchor"), F.col("rank").alias("b_rank"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    joined = chosen.join(best, (F.col("anchor") == F.col("b_anchor")) & (F.col("slot") + 1 == F.col("b_rank")))
    return joined.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(table, "vec_id", "embedding", moved)
    return mine(rows, F.pmod(F.col("vec_id"), F.lit(50)) == 0)


OP13_SQL = """
WITH t AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
s AS (
    SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.x, b.x)::BIGINT AS score
    FROM t a JOIN t b ON a.vec_id != b.vec_id WHERE a.vec_id % 50 = 0
),
p AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
