import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitaframe.functions.order_stats import (
    _banded,
    band_edges,
    exact_quantiles,
    group_summary,
    previous_values,
    value_positions,
)
from vitaframe.functions.scalar import correlation_p_value, fixed, round_even

PROBS = {"p0": 0.0, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}


def _groups():
    rng = random.Random(5)
    groups = {
        "one": [3.25],
        "constant": [0.1] * 7,
        "negative": [-rng.random() * 10 for _ in range(50)] + [rng.random() for _ in range(30)],
        "ties": [float(rng.randint(0, 5)) for _ in range(400)],
        "wide": [rng.lognormvariate(0, 8) * rng.choice([-1, 1]) for _ in range(300)],
        "narrow": [1e6 + rng.random() * 1e-3 for _ in range(200)],
        # One group with a third of all rows.
        "large": [rng.gauss(100, 20) for _ in range(3000)],
    }
    groups.update({f"small{i}": [rng.random() for _ in range(i % 9 + 1)] for i in range(700)})
    return groups


# The default leaves these groups whole; 40 cuts the larger ones into bands.
@pytest.mark.parametrize("band", [1 << 16, 40])
def test_group_summary(spark, band):
    groups = _groups()
    df = spark.createDataFrame(
        [(g, v) for g, vs in groups.items() for v in vs] + [("one", None), ("one", float("nan"))],
        "g string, v double",
    )
    rows = {r["g"]: r for r in group_summary(df, ["g"], "v", PROBS, band).collect()}
    assert set(rows) == set(groups)
    for g, vs in groups.items():
        a = np.array(vs)
        r = rows[g]
        assert r["n"] == len(vs) and r["min"] == a.min() and r["max"] == a.max()
        assert r["mean"] == pytest.approx(a.mean(), rel=1e-12, abs=1e-12)
        assert r["std"] == pytest.approx(a.std(), rel=1e-9, abs=1e-9)
        for name, p in PROBS.items():
            assert r[name] == pytest.approx(np.percentile(a, p * 100), rel=1e-12, abs=1e-12), (g, name)


# Values that a grid fixed in advance would put into a few of its cells.
SHAPES = {
    "tenths of a range of two": lambda rng: 97 + 2 * rng.random(20_000),
    "a thousand far from zero": lambda rng: 1e9 + 1000 * rng.random(20_000),
    "milliseconds since 1970": lambda rng: (1_734_000_000_000 + rng.integers(0, 86_400_000, 20_000)).astype(float),
    "all sizes": lambda rng: np.exp(rng.normal(0, 40, 20_000)) * rng.choice([-1, 1], 20_000),
    "nearly all equal": lambda rng: np.where(rng.random(60_000) < 0.7, 5.0, rng.random(60_000) * 1e-6),
}


@pytest.mark.parametrize("shape", sorted(SHAPES))
def test_bands_are_alike_in_size_wherever_values_lie(spark, shape):
    values = SHAPES[shape](np.random.default_rng(8))
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("small", 1.0)], "g string, v double")
    edges = band_edges(df, ["g"], "v", 512)
    assert [r["g"] for r in edges.collect()] == ["g"]
    distinct = df.distinct()
    banded = _banded(distinct, edges, ["g"], "v")
    sizes = [r["count"] for r in banded.where("g = 'g'").groupBy("_band").count().collect()]
    n = len(np.unique(values))
    assert len(sizes) >= n / 512 / 1.5 and max(sizes) <= 2.5 * n / len(sizes)
    # Bands follow the values.
    ends = banded.where("g = 'g'").groupBy("_band").agg(F.min("v"), F.max("v")).orderBy("_band").collect()
    assert all(a[2] < b[1] for a, b in zip(ends, ends[1:], strict=False))
    r = exact_quantiles(df.where("g = 'g'"), ["g"], "v", PROBS, band=512).first()
    for name, p in PROBS.items():
        assert r[name] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)


def test_previous_values_across_bands(spark):
    rng = np.random.default_rng(9)
    moments = np.unique(1_734_000_000_000_000 + rng.integers(0, 3_600_000_000, 30_000))
    df = spark.createDataFrame([("m", int(t)) for t in moments] + [("one", 5)], "g string, t long")
    for band in (256, 1 << 16):
        got = {(r["g"], r["t"]): r["previous"] for r in previous_values(df, ["g"], "t", band_edges(df, ["g"], "t", band)).collect()}
        assert got.pop(("one", 5)) is None and len(got) == len(moments)
        assert [got["m", int(t)] for t in moments] == [None, *map(int, moments[:-1])]
    # One hour is not one task: it is cut into ranges.
    edges = band_edges(df, ["g"], "t", 256)
    sizes = [r["count"] for r in _banded(df, edges, ["g"], "t").groupBy("g", "_band").count().collect()]
    assert len(sizes) > 80 and max(sizes) < 1000


def test_weights_count_as_copies(spark):
    df = spark.createDataFrame([("a", 1.0, 3), ("a", 5.0, 1), ("a", 2.0, 2)], "g string, v double, w long")
    r = exact_quantiles(df, ["g"], "v", {"m": 0.5, "q": 0.75}, "w").first()
    assert (r["m"], r["q"]) == (1.5, 2.0)
    many = spark.createDataFrame([("a", float(i), 1 + i % 4) for i in range(3000)], "g string, v double, w long")
    plain = np.repeat(np.arange(3000.0), 1 + np.arange(3000) % 4)
    for band in (64, 1 << 16):
        r = exact_quantiles(many, ["g"], "v", PROBS, "w", band).first()
        assert all(r[name] == pytest.approx(np.percentile(plain, p * 100)) for name, p in PROBS.items())


@pytest.mark.parametrize("band", [1 << 16, 40])
def test_average_ranks(spark, band):
    groups = _groups()
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {(r["g"], r["v"]): r["average_rank"] for r in value_positions(df, ["g"], "v", band=band).collect()}
    for g, vs in groups.items():
        a = np.sort(np.array(vs))
        for v in set(vs):
            left, right = np.searchsorted(a, v, "left"), np.searchsorted(a, v, "right")
            assert got[g, v] == (left + 1 + right) / 2


def test_p_values(spark):
    known = [(0.5, 10, 0.1411), (0.632, 10, 0.0500), (0.602, 11, 0.0500), (0.878, 5, 0.0502)]
    rows = [(r, n) for r, n, _ in known] + [(1.0, 7), (0.0, 8), (None, 9), (0.3, 2), (0.0, 9), (0.7, 3)]
    df = spark.createDataFrame(rows, "r double, n long").withColumn("i", F.monotonically_increasing_id())
    p = [r["p"] for r in df.withColumn("p", correlation_p_value("r", "n")).orderBy("i").collect()]
    assert [round(x, 4) for x in p[:4]] == [k[2] for k in known]
    assert p[4:8] == [0.0, 1.0, None, None] and p[8] == 1.0
    # Three pairs: one degree of freedom, 1 - 2/pi * asin(r).
    assert p[9] == pytest.approx(1 - 2 / np.pi * np.arcsin(0.7), abs=1e-12)


def exact_tail(r, n):
    """Integral of cos**(n - 3) above asin r over the one from 0, by the recurrence in the power, as fractions of the whole."""
    from fractions import Fraction

    q, power = Fraction(r) ** 2, n - 3
    # Even n: an odd power, a polynomial in r.
    assert power % 2 == 1
    term = total = Fraction(1)
    for j in range(1, (power - 1) // 2 + 1):
        term *= (1 - q) * Fraction(2 * j - 1, 2 * j)
        total += term
    return float(1 - Fraction(r) * total)


def test_p_values_for_any_number_of_pairs(spark):
    rows = [(r, n) for r in (0.03125, 0.125, 0.25, 0.5, 0.75) for n in (4, 6, 10, 40, 200, 998, 1000, 1002)]
    df = spark.createDataFrame(rows, "r double, n long")
    for row in df.withColumn("p", correlation_p_value("r", "n")).collect():
        assert row["p"] == pytest.approx(exact_tail(row["r"], row["n"]), rel=1e-10)
    # No jump anywhere, and no null, up to very many pairs.
    many = spark.range(990, 1010).select(F.col("id").alias("n"), F.lit(0.1).alias("r"))
    p = [x["p"] for x in many.withColumn("p", correlation_p_value("r", "n")).orderBy("n").collect()]
    steps = np.diff(np.log(p))
    assert (steps < 0).all() and np.allclose(steps, steps[0], rtol=0.01)
    big = spark.createDataFrame([(1e-4, 10**9), (1e-6, 10**9), (0.5, 10**6)], "r double, n long")
    p = [x["p"] for x in big.withColumn("p", correlation_p_value("r", "n")).collect()]
    # Normal tails at z = sqrt(10) and sqrt(0.001), and a value below the smallest double.
    assert p[0] == pytest.approx(0.001565402258, rel=1e-6) and p[1] == pytest.approx(0.974773, rel=1e-5) and p[2] == 0.0


def test_number_texts(spark):
    rng = random.Random(1)
    values = [0.835, 0.125, 0.005, 2.675, 1.005, 122.25, 122.35, 0.0, 99.95, 0.5, 1.5, 2.5, 511.5, 4096.5, 0.25]
    values += [round(rng.uniform(0, 500), 3) for _ in range(500)] + [round(rng.random(), 4) for _ in range(500)]
    # One way for all magnitudes: around 512 and 0.001, far above and below, and negative.
    values += [round(rng.uniform(500, 530), 3) for _ in range(300)] + [round(rng.uniform(0, 0.002), 6) for _ in range(300)]
    values += [rng.randrange(10**9) / 8 for _ in range(300)] + [-round(rng.uniform(0, 2000), 2) for _ in range(300)]
    values += [1234567.005, 511.995, 512.005, 1000.125, 0.0009765, 1e-300, 4503599627370497.5, 1e15 + 0.125, -0.005]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        for r in df.withColumn("t", fixed("v", digits)).collect():
            assert r["t"] == f"{r['v']:.{digits}f}"
    r = df.where("v in (2.5, 0.125, 122.25)").withColumn("t", round_even("v", 1)).collect()
    assert {x["v"]: x["t"] for x in r} == {2.5: 2.5, 0.125: 0.1, 122.25: 122.2}
    assert spark.range(1).select(fixed(F.lit(None), 1).alias("t")).first()["t"] is None
