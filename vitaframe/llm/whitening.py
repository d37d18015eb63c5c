"""Embedding whitening: principal directions refined to more than double precision.

Vectors become whole numbers. Each distinct vector counts once: sums and, after taking
off the nearest whole number to the mean, sums of products are gathered as whole numbers
by every task and added by Spark, so the covariance is an exact fraction whatever the
mean. It is turned into a matrix of extended precision on the driver (dimensions
squared, not rows).

Its eigenvectors start from a float32 solver and are corrected by the iteration of
Ogita and Aishima: with R = I - X'X and S = X'VX, each pass takes X to X + XE, where E
follows from R, S and the differences of the eigenvalues, and squares the error. Where
eigenvalues lie so close that the division means nothing (a cluster), E only makes the
columns orthonormal; the cluster is then turned by the eigenvectors of its own small
block, formed in extended precision with the common value taken off first, and refined
with the rest. Equal eigenvalues keep any orthonormal basis of their space.

Rows with a null vector, or with an entry that is null, not finite or too large
(2^44 and more after scaling) take no part, nor do vectors shorter than the longest.
Repeated rows are all returned. Directions without any spread have no component. An empty
table gives an empty result. Ids may be null. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitaframe.llm.common import read_table, stage

SCALE, OFFSET = 64, 1_000_000
LARGEST = 1 << 44
COMPONENTS = 16
# Tasks that add up products: each sends its own sums.
GRAM_TASKS = 4096
# Rows multiplied at a time.
STEP = 8192
EXACT = 1 << 53
ROUNDS = 12
WHOLE = T.DecimalType(38, 0)
WIDE = np.longdouble


# ------------------------------------------------------------------ covariance


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, x: the rows that take part, entries as whole numbers."""
    fits = F.forall(F.col(vector_col), lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < LARGEST))
    x = F.transform(F.col(vector_col), lambda c: F.floor(c.cast("double") * SCALE) + OFFSET)
    return rows.filter(F.col(vector_col).isNotNull() & fits).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _steps(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for k in range(0, batch.num_rows, STEP):
            yield _matrix(batch.slice(k, STEP).column(0), width)


def products(y: np.ndarray) -> np.ndarray:
    """Y'Y of whole numbers, exactly, as an array of Python integers."""
    largest = int(np.abs(y).max(initial=0))
    out = np.zeros((y.shape[1], y.shape[1]), object)
    if largest**2 <= EXACT:
        step = max(1, EXACT // max(1, largest**2))
        for k in range(0, len(y), step):
            part = y[k : k + step].astype(np.float64)
            out += (part.T @ part).astype(np.int64).astype(object)
        return out
    high, low = y >> 22, y & ((1 << 22) - 1)
    cross = _cross(high, low)
    return (products(high) << 44) + ((cross + cross.T) << 22) + products(low)


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = products(np.concatenate([a, b], axis=1))
    return both[: a.shape[1], a.shape[1] :]


def _sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for x in _steps(batches, width):
            n += len(x)
            # Sums of 8,192 numbers below 2^45 fit 64 bits.
            total += x.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, width), pa.int32()), pa.array([Decimal(v) for v in (n, *total)], pa.decimal128(38, 0))], ["i", "s"]
            )

    found = _few(fit).select("x").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    by = {r["i"]: int(r["s"]) for r in found.collect()}
    return by.get(-1, 0), [by.get(i, 0) for i in range(width)]


def _few(fit: DataFrame) -> DataFrame:
    """At most GRAM_TASKS tasks, so that sums per task stay few."""
    return fit.coalesce(GRAM_TASKS)


def covariance(fit: DataFrame, n: int, sums: list[int]) -> list[list[tuple[int, int]]]:
    """The covariance as exact fractions (numerator, denominator), upper triangle."""
    width = len(sums)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        any_rows = False
        for x in _steps(batches, width):
            total += products(x - centre)
            any_rows = True
        if any_rows:
            values = pa.array([Decimal(v) for v in total[upper]], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(upper[0].astype(np.int32)), pa.array(upper[1].astype(np.int32)), values], ["i", "j", "s"])

    found = _few(fit).select("x").mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = [[(0, 1)] * width for _ in range(width)]
    rest = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    for row in found.toArrow().to_pylist():
        i, j = row["i"], row["j"]
        out[i][j] = out[j][i] = (n * int(row["s"]) - rest[i] * rest[j], n * n)
    return out


def wide(numerator: int, denominator: int) -> np.longdouble:
    """A fraction in extended precision."""
    shared = gcd(numerator, denominator) or 1
    whole, rest = divmod(numerator // shared, denominator // shared)
    return _wide_int(whole) + _wide_int(rest) / _wide_int(denominator // shared)


def _wide_int(x: int) -> np.longdouble:
    high, low = divmod(x, 1 << 52)
    if abs(high) >= 1 << 52:
        return _wide_int(high) * WIDE(1 << 52) + WIDE(low)
    return WIDE(high) * WIDE(1 << 52) + WIDE(low)


# ------------------------------------------------------------------ eigenvectors


def _clusters(values: np.ndarray, gap: np.longdouble) -> list[np.ndarray]:
    """Runs of two or more values, sorted, that are no further apart than the gap."""
    order = np.argsort(values)
    apart = np.flatnonzero(np.diff(values[order]) > gap) + 1
    return [run for run in np.split(order, apart) if len(run) > 1]


def _residual(x: np.ndarray) -> np.ndarray:
    r = np.eye(x.shape[1], dtype=WIDE) - x.T @ x
    return (r + r.T) / 2


def _pass(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.longdouble, np.longdouble]:
    """One correction: new vectors, eigenvalues, size of the correction, gap trusted."""
    # Exactly symmetric, so that E divides one rounding error by both signs of a distance
    # and columns stay orthogonal however small it is.
    r = _residual(x)
    s = x.T @ (a @ x)
    s = (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    # Frobenius norms bound the spectral ones.
    gap = 2 * (np.sqrt((off * off).sum()) + np.sqrt((a * a).sum()) * np.sqrt((r * r).sum()))
    distance = values[None, :] - values[:, None]
    clear = np.abs(distance) > gap
    e = np.where(clear, (s + values[None, :] * r) / np.where(clear, distance, 1), r / 2)
    np.fill_diagonal(e, np.diag(r) / 2)
    return x + x @ e, values, np.abs(e).max(), gap


def _turn_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, gap: np.longdouble) -> np.ndarray:
    """Turns the columns of each cluster by the eigenvectors of its own block."""
    x = x.copy()
    for run in _clusters(values, gap):
        part = x[:, run]
        middle = values[run].mean()
        # The common value is taken off first, so that the small differences keep their digits.
        block = part.T @ (a @ part) - middle * (part.T @ part)
        block = (block + block.T) / 2
        size = np.abs(block).max()
        if size:
            small = np.linalg.eigh((block / size).astype(np.float64))[1].astype(WIDE)
            x[:, run] = part @ small
    return x


def refined_eigenvectors(a: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric longdouble matrix."""
    size = np.abs(a).max()
    if not size:
        return np.zeros(len(a), WIDE), np.eye(len(a), dtype=WIDE)
    scaled = a / size
    x = np.linalg.eigh(scaled.astype(np.float32))[1].astype(WIDE)
    enough = 64 * np.finfo(WIDE).eps
    for _ in range(rounds):
        x, values, moved, gap = _pass(scaled, x)
        if _clusters(values, gap):
            x = _turn_clusters(scaled, x, values, gap)
        elif moved <= enough:
            break
    x = x + x @ _residual(x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (scaled @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


# ------------------------------------------------------------------ whitening


@dataclass
class Whitening:
    """What it takes to whiten a vector of whole numbers."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the components
    directions: np.ndarray  # a column per component
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows of x whitened: (x - mean) on the directions, over the deviations."""
        centre = np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)
        rest = np.array([float(wide(s - self.n * int(c), self.n)) for s, c in zip(self.sums, centre, strict=True)])
        return ((x - centre).astype(np.float64) - rest) @ (self.directions / np.sqrt(self.values))


def fit_whitening(fit: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """``fit``: x, distinct vectors of one width. None without any."""
    n, sums = _sums(fit, width)
    if not n:
        return None
    exact = covariance(fit, n, sums)
    matrix = np.array([[wide(*cell) for cell in row] for row in exact], WIDE).reshape(width, width)
    values, vectors = refined_eigenvectors(matrix)
    trace = np.diag(matrix).sum()
    kept = np.flatnonzero(values > trace * width * np.finfo(np.float64).eps)[:components]
    return Whitening(n, sums, values[kept].astype(np.float64), vectors[:, kept].astype(np.float64), float(trace))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity."""
    k, width = len(model.values), len(model.sums)
    mean = np.zeros(k)
    pairs = np.triu_indices(k)
    for square in (False, True):

        def run(batches: Iterator[pa.RecordBatch], mean=mean, square=square) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(pairs[0]) if square else k)
            for x in _steps(batches, width):
                w = model.apply(x) - mean
                total += (w.T @ w)[pairs] if square else w.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["i", "s"])

        found = _few(fit).select("x").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
        got = np.zeros(len(pairs[0]) if square else k)
        for row in found:
            got[row["i"]] = row["s"] / model.n
        if not square:
            mean = got
    return float(np.abs(got - (pairs[0] == pairs[1])).max(initial=0.0))


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is null where it does not fit a long.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    usable = stage(whole_vectors(rows, id_col, vector_col), "whiten-rows")
    width = usable.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return spark.createDataFrame([], schema).withColumnRenamed("vec_id", id_col)
    usable = usable.filter(F.size("x") == width)
    fit = stage(usable.select("x").distinct(), "whiten-fit")
    model = fit_whitening(fit, width, components)
    k = len(model.values)
    error = identity_error(fit, model)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        explained = own.values / own.trace
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                w = own.apply(_matrix(part.column(1), width))
                m = len(w)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                     pa.array(np.full(m * k, own.n, np.int64)), part.column(2).take(pa.array(np.repeat(np.arange(m), k))),
                     pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return usable.select("vec_id", "x", _deviation(model).alias("deviation")).mapInArrow(run, schema).withColumnRenamed("vec_id", id_col)


def _deviation(model: Whitening) -> Column:
    """Sum over dimensions of (n*x - S)^2, exact, as a long where it fits."""
    sums = F.array(*[F.lit(Decimal(s)).cast(WHOLE) for s in model.sums])
    off = F.zip_with("x", sums, lambda x, s: (x * F.lit(model.n)).cast(WHOLE) - s)
    total = F.aggregate(off, F.lit(0).cast(WHOLE), lambda t, d: (t + (d * d).cast(WHOLE)).cast(WHOLE))
    return total.try_cast("long")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
