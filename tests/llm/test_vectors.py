"""Whitening, SimHash and hard negatives against brute force and on odd rows."""

from __future__ import annotations

import os
import sys
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from vitaframe.llm import hard_negatives, simhash, whitening  # noqa: E402
from vitaframe.llm.queries import QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int, x long, score double, component int"
NAN, INF = float("nan"), float("inf")


# ------------------------------------------------------------------ SimHash


def plain_fingerprint(text, n=3):
    """Bit counts in whole numbers, straight from the definition."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    size = min(n, len(words))
    grams = [" ".join(words[k : k + size]) for k in range(len(words) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, radius=3):
    """The smallest node reachable by all-pairs links."""
    nodes = sorted(set(nodes))
    found = {n: n for n in nodes}

    def root(n):
        while found[n] != n:
            n = found[n]
        return n

    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                low, high = sorted((root(a), root(b)))
                found[high] = low
    return {n: root(n) for n in nodes}


def test_variants_meet_for_every_pair_of_three_bits_or_fewer():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3):
        for _ in range(150):
            a = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 2 + int(rng.integers(2))
            b = a
            for bit in rng.choice(64, d, replace=False):
                b ^= 1 << int(bit)
            keys, flips = simhash._variants(np.array([a, b], np.uint64), 0, 0)
            one, two = simhash._met(keys * simhash._SPREAD, flips)
            assert list(zip(one.tolist(), two.tolist(), strict=True)) == [(min(a, b), max(a, b))]
    far = np.array([0, 0b1111, 0b11111 << 9], np.uint64)
    assert not len(simhash._met(*(lambda k, f: (k * simhash._SPREAD, f))(*simhash._variants(far, 0, 0)))[0])


@pytest.mark.parametrize("sizes", [{}, {"pass_variants": 30_000, "range_variants": 50, "block_variants": 3_000}, {"range_variants": 1}])
def test_links_connect_what_all_pairs_connect(spark, sizes):
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = {int(c) for c in centres} | {0, 1, 7, (1 << 64) - 1}
    for c in centres[:10]:
        for _ in range(25):
            x = int(c)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(nodes, **sizes).collect()]
    assert all(a != b for a, b in found)
    chain = {x: x for x in fps}
    changed = True
    while changed:
        changed = False
        for a, b in found:
            low = min(chain[a], chain[b])
            if chain[a] != low or chain[b] != low:
                chain[a] = chain[b] = low
                changed = True
    assert chain == plain_components(fps)


def test_simhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs}
    roots = plain_components(prints.values())
    least: dict[int, int] = {}
    for i, fp in prints.items():
        least[roots[fp]] = min(least.get(roots[fp], i), i)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op12_simhash"](spark, SMALL).collect()}
    assert got == {i: (f"{fp:016x}", least[roots[fp]]) for i, fp in prints.items()}


def test_simhash_on_odd_rows(spark):
    long = " ".join(f"w{i % 1009}" for i in range(200_000))
    rows = [(1, "a B\tc d"), (2, "A b c  D"), (2, "A b c  D"), (3, None), (4, " \n "), (5, ""), (None, "a b c d"), (6, long), (7, "Été là"), (8, "one"), (None, "no other text is like it")]
    docs = spark.createDataFrame([(*r, 9, "x", 1, "f") for r in rows], "doc_id long, text string, id long, fp string, component_id long, fingerprint string")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_copies(docs).collect()]
    assert len(got) == len(rows)
    by = {i: (fp, c) for i, fp, c in got if i is not None}
    assert all(by[i][0] == f"{plain_fingerprint(t):016x}" for i, t in rows if i is not None)
    assert by[1][1] == by[2][1] == 1 and by[3] == by[4] == by[5] == ("0" * 16, 3)
    assert sorted(c is None for i, _, c in got if i is None) == [False, True]
    assert sorted(str(r["doc_id"]) for r in simhash.drop_near_copies(docs).collect()) == ["1", "3", "6", "7", "8", "None", "None"]
    assert simhash.near_copies(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ whitening


def plain_whitening(vectors, keep=16):
    """Exact fractions for the covariance, numpy for its eigenvectors."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = n * fit - sums
    cov = centred.T @ centred
    cov = np.array([[float(Fraction(int(c), n**3)) for c in row] for row in cov])
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:keep], vecs[:, ::-1][:, :keep]
    off = n * x - sums
    whitened = (off.astype(float) / n) @ vecs / np.sqrt(values)
    return n, (off * off).sum(axis=1), whitened, values / np.trace(cov)


def test_whitening_query_equals_plain_arithmetic(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviation, whitened, explained = plain_whitening([r["embedding"] for r in rows])
    got = QUERIES["op11_whitening"](spark, SMALL).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == 16 * len(rows) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1
    assert got["identity_error"].iloc[0] < 1e-9
    assert got["deviation"].to_numpy().reshape(-1, 16)[:, 0].tolist() == [int(d) for d in deviation]
    mine = got["whitened"].to_numpy().reshape(-1, 16)
    signs = np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine * signs - whitened).max() < 1e-8
    assert np.allclose(got["explained"].to_numpy().reshape(-1, 16), explained, rtol=1e-9, atol=0)


def test_eigenvectors_beyond_double_and_in_clusters():
    rng = np.random.default_rng(3)
    wide = np.longdouble
    for values in ([5, 4, 3, 2, 1, 0.5], [1, 1 + 1e-9, 1 - 2e-9, 1e-3, 2, 2 + 1e-8], [3, 3, 3, 2, 2, 1], [1e8, 1e8 + 1, 1, 1 + 1e-7, 1e-6, 0]):
        # A rotation with entries exact in few bits, orthonormal to extended precision.
        q = np.linalg.qr(rng.normal(size=(6, 6)))[0].astype(wide)
        for _ in range(3):
            q = q @ (1.5 * np.eye(6, dtype=wide) - 0.5 * (q.T @ q))
        truth = np.array(values, wide)
        a = (q * truth) @ q.T
        found, x = whitening.refined_eigenvectors((a + a.T) / 2)
        scale = np.abs(truth).max()
        assert np.abs(found - np.sort(truth)[::-1]).max() < 1e-16 * scale
        assert np.abs(x.T @ x - np.eye(6)).max() < 1e-17
        assert np.abs(a @ x - x * found).max() < 1e-16 * scale
        for k, v in enumerate(truth):
            # Directions of clear eigenvalues agree with the true ones.
            gap = np.abs(truth - v)[np.arange(6) != k].min()
            if gap > 1e-4 * scale:
                assert 1 - np.abs(x.T @ q[:, k]).max() < 1e-16
            elif gap:
                assert 1 - np.abs(x.T @ q[:, k]).max() < 1e-9


def test_products_of_large_numbers_are_exact():
    rng = np.random.default_rng(4)
    for top in (9, 1 << 20, 1 << 30, 1 << 45):
        y = rng.integers(-top, top, (50, 5))
        assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()


def test_whitening_on_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [[float(np.float32(v)) for v in rng.normal(size=3)] for _ in range(20)]
    rows = [*enumerate(good), (3, good[3]), (100, good[3]), (None, good[4]), (21, None), (22, [1.0, None, 2.0]), (23, [NAN, 1.0, 1.0]), (24, [1.0, INF, 1.0]), (25, [1.0]), (26, []), (27, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 5, 0.5, 2) for i, v in rows], VECTORS)
    n, deviation, whitened, _ = plain_whitening(good)
    got = whitening.whiten(df).toPandas()
    assert len(got) == 3 * 23 and set(got["n"]) == {n} and got["identity_error"].iloc[0] < 1e-9
    one = got[got["vec_id"] == 100].sort_values("component")
    assert np.allclose(np.abs(one["whitened"]), np.abs(whitened[3])) and set(one["deviation"]) == {int(deviation[3])}
    assert got["vec_id"].isna().sum() == 3 and len(got[got["vec_id"] == 3]) == 6
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 100")).count() == 0  # a single vector has no spread
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], 0, 0, 0.0, 0) for i in range(9)], VECTORS)
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}


# ------------------------------------------------------------------ hard negatives


def plain_negatives(rows, is_anchor, positives=5, negatives=3):
    out = []
    for a, la, xa in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(p * q for p, q in zip(xa, x, strict=False)), i, lab) for i, lab, x in rows if i != a)
        for p, i, _ in [s for s in scored if s[2] == la][:positives]:
            fit = [s for s in scored if s[2] != la and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(a, i, k + 1, j, -p, -s) for k, (s, j, _) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("bound", [10, 10**6, 10**12, 1 << 54])
def test_scores_are_exact(bound):
    rng = np.random.default_rng(6)
    primes = hard_negatives.primes_for(bound)
    for width in (1, 64, 200):
        top = max(2, int((bound / width) ** 0.5))
        a, b = rng.integers(-top, top, (7, width)), rng.integers(-top, top, (9, width))
        a[0], b[0] = top - 1, top - 1
        a[1] = 1 - top
        got = hard_negatives.scores(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
        assert (got == (a.astype(object) @ b.astype(object).T)).all()


@pytest.mark.parametrize("wave_bytes", [32 << 20, 4_000])
def test_hard_negatives_equal_brute_force(spark, wave_bytes, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 37)
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 5)
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(3)), [int(v) for v in rng.integers(-2, 4, 4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, label long, x array<bigint>").repartition(5)
    got = hard_negatives.mine(df, F.col("vec_id") % 9 == 0, wave_bytes=wave_bytes).collect()
    expected = plain_negatives(rows, lambda i: i % 9 == 0)
    assert expected and sorted(map(tuple, got)) == expected


def test_hard_negatives_on_odd_rows(spark):
    rows = [
        (0, [1.0, 1.0], 1), (1, [1.0, 0.5], 1), (2, [0.5, 0.5], 2), (2, [0.5, 0.5], 2), (3, None, 1), (4, [1.0, None], 1),
        (5, [NAN, 1.0], 1), (6, [1.0, 1.0], None), (None, [1.0, 1.0], 2), (8, [0.5], 2), (9, [-1.0, -1.0], 1), (10, [], 2),
    ]
    df = spark.createDataFrame([(i, v, lab, 4, 0.5, 1) for i, v, lab in rows], VECTORS)
    found = hard_negatives.usable(df, "vec_id", "embedding", F.col("label"))
    got = sorted(map(tuple, hard_negatives.mine(found, F.col("vec_id") == 0).collect()))
    p = 256 * 256 + 256 * 128
    assert got == [(0, 1, 1, 2, p, 2 * 256 * 128)]
    assert hard_negatives.mine(found.limit(0), F.lit(True)).count() == 0
    assert hard_negatives.mine(found, F.lit(False)).count() == 0
    big = spark.createDataFrame([(0, [1e12, 1.0], 1, 0, 0.0, 0)], VECTORS)
    with pytest.raises(ValueError, match="do not fit"):
        hard_negatives.mine(hard_negatives.usable(big, "vec_id", "embedding", F.col("label")), F.lit(True))


def test_hard_negatives_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SMALL}/embeddings.parquet')")
    got = QUERIES["op13_hard_negatives"](spark, SMALL)
    names = got.columns
    expected = con.execute(f"SELECT {', '.join(names)} FROM ({hard_negatives.OP13_SQL})").fetchall()
    assert expected and sorted(map(tuple, got.collect())) == sorted(expected)
