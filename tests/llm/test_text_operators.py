"""The text operators on odd rows, on empty tables, and against brute force."""

from __future__ import annotations

import hashlib
import os
import re
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from vitaframe.llm import bpe, compact_windows, jaccard_join, mixing, quality_rules, suffix_dedup, toxicity, warc  # noqa: E402
from vitaframe.llm.components import components  # noqa: E402
from vitaframe.llm.exact_dedup import drop_copies, exact_groups  # noqa: E402
from vitaframe.llm.language_id import identify  # noqa: E402
from vitaframe.llm.mixing import mix  # noqa: E402
from vitaframe.llm.queries import QUERIES, SQL  # noqa: E402

SMALL = "/root/testdata/sf0.001"
# Columns that clash with names the operators use inside or return.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, kept boolean, score double, size long, row string"
LONG = " ".join(f"word{i % 997}x{i}" for i in range(30_000)) + "."
WORDS = " ".join(f"term{i}" for i in range(60)) + "."
ROWS = [
    (1, WORDS, "en", "a"), (2, WORDS, "en", "a"), (2, WORDS, "en", "a"), (3, None, None, None), (4, "", "en", None),
    (5, " \t\n ", "de", "b"), (6, LONG, "en", "a"), (7, "1234 5678", "de", "b"), (8, "été là <|endoftext|> né", "fr", "b"),
    (9, WORDS + " Extra words.", "en", "c"), (None, WORDS, "en", "a"), (10, None, "de", "b"), (11, "a\x00b  c", None, "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 5, 7, True, 0.5, 3, "x") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(odd, none):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(odd, keep="largest").collect()}
    assert (1, 2, 4, False) in got and (2, 2, 4, True) in got and (3, 10, 3, False) in got and (None, 2, 4, False) in got
    assert sorted(r["doc_id"] for r in drop_copies(odd).collect()) == [1, 3, 5, 6, 7, 8, 9, 11]
    assert exact_groups(none).count() == 0 and drop_copies(none).count() == 0


def test_exact_dedup_survives_hash_collisions(odd):
    weak = exact_groups(odd, keep="largest", content_hash=lambda t: F.substring(F.md5(t), 1, 1))
    assert sorted(map(str, weak.collect())) == sorted(map(str, exact_groups(odd, keep="largest").collect()))


def test_quality_rules(spark, odd, none):
    got = {r["doc_id"]: r for r in quality_rules.judge(odd).collect()}
    assert got[1]["kept"] and not got[3]["kept"] and got[3]["n_words"] == 0 and got[6]["n_repeat_words"] == 0
    assert quality_rules.judge(none).count() == 0
    menu = "Home | News | Sport | Shop | Login\n" * 3 + "x " * 60
    row = quality_rules.judge(spark.createDataFrame([(1, menu)], "doc_id long, text string")).first()
    assert row["n_good_lines"] == 1 and row["n_dup_lines"] == 2 and row["base_failed"]
    clean = spark.createDataFrame([("A cookie banner\nGood line ends here.",)], "t string").select(quality_rules.clean_text(F.col("t")))
    assert clean.first()[0] == "Good line ends here."


def test_bpe_equals_the_library(spark, odd, none):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    for r in bpe.round_trip(odd, path).collect():
        if r["doc_id"] in (None, 2):
            continue
        text = next(x[1] for x in ROWS if x[0] == r["doc_id"]) or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = bpe.decode(bpe.encode(odd, path), path)
    assert {(r[0], r[1]) for r in back.collect()} == {(r[0], r[1] or "") for r in ROWS}
    assert bpe.round_trip(none, path).count() == 0


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/1", "x" * 200), (2, "http://a/2 b", "x" * 200), (2, "http://a/2 b", "x" * 200), (3, None, None), (4, "u", "short"), (5, "u", "short"), (6, "u", "é" * 5_000_000)]
    df = spark.createDataFrame([(*p, "r") for p in pages], "page_id long, url string, html string, refers_to string")
    folder = str(tmp_path / "w")
    warc.write_archives(df, folder, file_bytes=1 << 20)
    got = warc.read_archives(spark, folder).collect()
    assert len(got) == len(pages)
    by = {r["page_id"]: r for r in got}
    assert by["2"]["record_type"] == "revisit" and by["2"]["refers_to"] == "1" and by["2"]["payload_bytes"] == 200
    assert by["5"]["record_type"] == "response" and bytes(by["6"]["payload"]) == ("é" * 5_000_000).encode() and by["3"]["payload_bytes"] == 0


def test_mixing(odd, none):
    got = mix(odd, with_rows=True).collect()
    assert len(got) == len(ROWS) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(map(str, mix(odd).collect())) == sorted(map(str, mix(odd).collect()))
    assert mix(none).count() == 0


def test_running_sums_of_slices(spark):
    rng = np.random.default_rng(15)
    rows = sorted({(str(s) if s else None, int(p)) for s, p in zip(rng.integers(0, 3, 400), rng.integers(0, 300, 400), strict=True)}, key=str)
    rows = [(s, p, int(rng.integers(0, 50))) for s, p in rows]
    sums = spark.createDataFrame(rows, "source string, slice long, words long")
    for level in (1, 7, 4096):
        got = mixing._before(sums, ["source"], "slice", level)
        assert got.columns == ["source", "slice", "words", "words_before"]
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(
            str((s, p, w, sum(v for t, q, v in rows if t == s and q < p))) for s, p, w in rows
        )
    alone = mixing._before(sums.groupBy("slice").agg(F.sum("words").alias("words")), [], "slice", 16).collect()
    assert all(r["words_before"] == sum(v for _, q, v in rows if q < r["slice"]) for r in alone)


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r[0]: r[1] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[103] == 100


def test_jaccard_join_on_odd_rows(odd, none):
    got = {r["doc_id"]: r for r in jaccard_join.join_components(odd, 3, 90).collect()}
    assert got[2]["component_id"] == 1 and got[9]["component_id"] == 1 and got[3]["component_id"] == 3 and got[4]["n_shingles"] == 0
    assert got[7]["n_shingles"] == 1 and got[None]["component_id"] is None
    assert jaccard_join.join_components(none).count() == 0


def linked(texts, n, threshold):
    """Per id the set size and component, from all pairs."""
    sets = {k: set(jaccard_join.shingles(t, n).tolist()) for k, t in texts.items()}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("n,threshold", [(3, 90), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, n, threshold):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r[0]: r[1] for r in docs.select("doc_id", "text").collect()}
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.join_components(docs, n, threshold).collect()}
    assert got == linked(texts, n, threshold)


@pytest.mark.parametrize("lead", [1, 3, 16])
def test_jaccard_join_among_many_near_copies(spark, monkeypatch, lead):
    """Copies of one text of which some are links and most are not, wherever the shared n-grams lie."""
    monkeypatch.setattr(jaccard_join, "LEAD", lead)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        words = [f"w{k}" for k in range(200)]
        for k in rng.choice(200, int(rng.integers(1, 7)), replace=False):
            words[k] = f"v{rng.integers(0, 40)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r[0]: (r[1], r[2]) for r in jaccard_join.join_components(docs, 3, 90).collect()} == linked(dict(rows), 3, 90)


# One level of ranges, and two.
@pytest.mark.parametrize("sizes", [{}, {"range_bytes": 500, "level_ranges": 20}])
def test_suffix_dedup_equals_brute_force(spark, odd, none, sizes):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(10_001, None), (10_002, ""), (10_003, "ab" * 300), (10_004, "x" + "ab" * 100)], docs.schema))
    first, expected = {}, {}
    for i, text in sorted(docs.collect()):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        own = [data[p : p + 50] for p in range(len(data) - 49)]
        for p, s in enumerate(own):
            if s in first:
                gone[p : p + 50] = True
        for s in own:
            first.setdefault(s, i)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        expected[i] = (len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    assert {r[0]: tuple(r)[1:] for r in suffix_dedup.remove_repeats(docs.repartition(5), **sizes).collect()} == expected
    assert suffix_dedup.remove_repeats(odd).count() == len(ROWS) and suffix_dedup.remove_repeats(none).count() == 0


def test_merge_is_a_sort():
    rng = np.random.default_rng(1)
    runs = [sorted(bytes(rng.integers(97, 99, suffix_dedup.LENGTH).astype(np.uint8)) for _ in range(n)) for n in (5, 0, 40, 1, 17)]
    matrices = [np.frombuffer(b"".join(r), np.uint8).reshape(-1, suffix_dedup.LENGTH) for r in runs]
    run, place, prefix = suffix_dedup.merge_runs(runs, [suffix_dedup.common_prefix(m).tolist() for m in matrices])
    merged = [runs[r][p] for r, p in zip(run, place, strict=True)]
    assert merged == sorted(sum(runs, []))
    rows = np.frombuffer(b"".join(merged), np.uint8).reshape(-1, suffix_dedup.LENGTH)
    assert prefix == suffix_dedup.common_prefix(rows).tolist()


def test_compact_windows(spark, odd, none):
    shingles = compact_windows.sequence(WORDS)
    windows = compact_windows.compact_windows(shingles, lambda names: np.ones(len(names), bool))
    values = compact_windows.mixed(shingles ^ compact_windows._SEEDS[:, None])
    for f, _, first, last in windows.tolist():
        inside = values[f, first : last + 1].min()
        assert first == 0 or values[f, first - 1] < inside
        assert last == len(shingles) - 1 or values[f, last + 1] < inside
    got = {r["doc_id"]: r for r in compact_windows.repeated_passages(odd).collect()}
    assert got[1]["class_id"] == got[2]["class_id"] == got[9]["class_id"] == 1 and got[1]["n_passages"] > 0
    assert got[6]["n_links"] == 0 and got[3]["class_id"] == 3 and got[None]["class_id"] is None
    assert compact_windows.repeated_passages(none).count() == 0


def test_language_id(spark, odd, none):
    got = {r["id"]: r for r in identify(odd, F.lit(True)).collect()}
    assert got[3]["lang_pred"] == got[7]["lang_pred"] == "und" and got[7]["score"] == 0 and got[8]["lang_pred"] == "fr"
    assert identify(none, F.lit(True)).count() == 0
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    held = QUERIES["op8_language_id"](spark, SMALL).filter("held_out").join(truth, "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.9


def test_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(1, 0), (9, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, labels, F.lit(True)).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    alike = toxicity.score_toxicity(odd, labels.filter("toxic = 0"), F.lit(True)).collect()
    assert all(r["score"] == 0 for r in alike)
    assert toxicity.score_toxicity(none, labels, F.lit(True)).count() == 0


def test_toxicity_gradients():
    rng = np.random.default_rng(2)
    net = toxicity.Network(["aa", "bb", "cc"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = ["", "aa", "bb", "zz"]
    pieces = [np.empty(0, np.int64) if not w else toxicity.trigrams(w) for w in words]
    rows = np.array([net.place.get(w, 0) for w in words])
    ids, y, weight = rng.integers(0, 4, (6, 3)), np.array([0.0, 1, 1]), np.ones(3)

    def loss():
        x = np.stack([net.inputs(w) if w else np.zeros(2 * toxicity.SIZE) for w in words])
        table = {s: x @ net.p[f"{s}x"] + net.p[f"{s}b"] for s in "fb"}
        states = np.concatenate([net._run(s, table[s][ids], None) for s in "fb"], axis=2)
        p = toxicity._sigmoid(net.head(states)[3])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net.gradients(ids, [rows, pieces], y, weight)
    for name in ("out", "att_v", "fh", "bx"):
        flat, step = net.p[name].reshape(-1), 1e-3
        k = int(np.abs(g[name]).argmax())
        flat[k] += step
        up = loss()
        flat[k] -= 2 * step
        down = loss()
        flat[k] += step
        assert abs((up - down) / (2 * step) - g[name].reshape(-1)[k]) < 2e-3


def test_pipeline(spark, none):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and {r["doc_id"] for r in rows} <= {r[0] for r in docs.select("doc_id").collect()}
    for _, step in corpus_pipeline.STAGES[:-1]:
        out = step(spark, none, SMALL)
        assert out.columns == none.columns and out.count() == 0


def test_every_query_is_listed():
    assert set(SQL) <= set(QUERIES) and sorted(int(n.split('_')[0][2:]) for n in QUERIES) == list(range(1, 14))


def test_functions_that_hold_a_passage():
    rng = np.random.default_rng(5)
    for _ in range(50):
        f, first = rng.integers(0, compact_windows.HASHES, 40), rng.integers(0, 300, 40)
        last = first + compact_windows.SPAN - 1 + rng.integers(0, 60, 40)
        dense = compact_windows._covered(f, first, last, 0, 400)
        starts = np.arange(400)
        assert (compact_windows._functions_at(starts, f, first, last) == dense).all()


def test_passages_against_brute_force():
    rng = np.random.default_rng(6)
    span = compact_windows.SPAN
    one = rng.integers(0, 2**32, 400, dtype=np.uint32).view(np.int32)
    two = rng.integers(0, 2**32, 500, dtype=np.uint32).view(np.int32)
    two[200:300] = one[100:200]
    two[230], two[260] = 1, 2
    ranges = np.array([[f, 90, 210, 190, 310] for f in range(compact_windows.HASHES)])
    starts = np.repeat(ranges, 3, axis=0) + np.array([[0, 0, 0, 0, 0], [0, 12, 0, 0, 0], [0, 60, 0, 0, 0]] * compact_windows.HASHES)
    found = compact_windows.similar_passages(starts, one, compact_windows.Sequence(two, np.empty(0, np.int32)))
    assert found
    for s, u in found:
        a, b = set(one[s : s + span].tolist()), set(two[u : u + span].tolist())
        assert 100 * len(a & b) >= compact_windows.THRESHOLD * len(a | b)
    lone = rng.integers(0, 2**32, 500, dtype=np.uint32).view(np.int32)
    assert not compact_windows.similar_passages(starts, one, compact_windows.Sequence(lone, np.empty(0, np.int32)))


def cut(shingles):
    return shingles.astype(np.uint32).view(np.int32)


def passages_of(x, y):
    """Passages of two texts, as the operator finds them with all windows of the pair."""
    a, b = compact_windows.sequence(x), compact_windows.sequence(y)
    windows = [compact_windows.compact_windows(s, lambda n, o=o: np.isin(n, compact_windows.signatures(o))) for s, o in ((a, y), (b, x))]
    other = compact_windows.Sequence(cut(a), windows[0])
    return compact_windows.similar_passages(compact_windows.meetings(windows[1], other), cut(b), other)


def alike_starts(one, two):
    """For every passage of each side whether any of the other's is alike, from all pairs of passages."""
    span = compact_windows.SPAN
    x, y = ([set(v[s : s + span].tolist()) for s in range(len(v) - span + 1)] for v in (one, two))
    alike = np.array([[100 * len(p & q) >= compact_windows.THRESHOLD * len(p | q) for q in y] for p in x])
    return alike.any(axis=1), alike.any(axis=0)


@pytest.mark.parametrize("length", [50, 52, 55, 60])
def test_short_repeats_in_unrelated_text_are_found(length):
    rng = np.random.default_rng(length)
    for changed in (False, True):
        for _ in range(4 if changed else 40):
            words = [f"w{k}" for k in rng.integers(0, 10**9, 240 + 2 * length)]
            part, rest = words[:length], words[length:]
            copy = [*part[:8], "other", *part[9:]] if changed else part
            x = " ".join(rest[:60] + part + rest[60:120])
            y = " ".join(rest[120:180] + copy + rest[180:])
            if changed:
                a, b = (cut(compact_windows.sequence(t)) for t in (x, y))
                # Signatures may disagree by chance: the pair is taken as a candidate.
                m = np.array([[f, 0, len(a) - 1, 0, len(b) - 1] for f in range(compact_windows.HASHES)])
                found = compact_windows.similar_passages(m, a, compact_windows.Sequence(b, np.empty(0, np.int32)))
                assert bool(found) == alike_starts(a, b)[0].any()
            else:
                assert passages_of(x, y)


def test_all_alike_passages_are_found():
    """Also where shingles repeat, within a passage and far apart, and parts change places."""
    rng = np.random.default_rng(8)
    linked_pairs = 0
    for trial in range(60):
        kinds = [2, 8, 40, 10**9][trial % 4]
        one, two = (rng.integers(0, kinds, int(rng.integers(60, 140))) for _ in range(2))
        for _ in range(trial % 3):
            n = int(rng.integers(20, 58))
            s, u = int(rng.integers(0, len(one) - n + 1)), int(rng.integers(0, len(two) - n + 1))
            two[u : u + n] = one[s : s + n]
            two[u + rng.integers(0, n, int(rng.integers(0, 5)))] = rng.integers(0, kinds, 1)
        if trial % 5 == 0:
            two = np.concatenate([one[25:48], one[2:25], two[:60]])
        one, two = cut(one), cut(two)
        m = np.array([[f, 0, len(one) - 1, 0, len(two) - 1] for f in range(compact_windows.HASHES)])
        found = compact_windows.similar_passages(m, one, compact_windows.Sequence(two, np.empty(0, np.int32)))
        x, y = alike_starts(one, two)
        assert {s for s, _ in found} == set(np.flatnonzero(x).tolist()) and {u for _, u in found} == set(np.flatnonzero(y).tolist())
        linked_pairs += bool(found)
    assert 20 < linked_pairs < 60


def test_repeats_are_counted_to_their_ends(spark):
    rng = np.random.default_rng(9)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    long, short, own = words(140), words(80), [words(200) for _ in range(4)]
    texts = [own[0][:100] + long + own[0][100:], own[1][:30] + long + own[1][30:], own[2] + short, short + own[3][:100] + short[:60]]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in compact_windows.repeated_passages(docs).collect()}
    found, _, _ = compact_windows.find_passages(docs)
    stretches = {(r["a"], r["b"]): r for r in found.collect()}
    assert set(stretches) == {(0, 1), (2, 3)}
    for a, b in stretches:
        one, two = (cut(compact_windows.sequence(texts[k])) for k in (a, b))
        for doc, starts, names in zip((a, b), alike_starts(one, two), (("sa", "ea"), ("sb", "eb")), strict=True):
            held = np.zeros(len(texts[doc].split()), bool)
            for s in np.flatnonzero(starts):
                held[s : s + 50] = True
            edges = np.diff(held.astype(int), prepend=0, append=0)
            assert [stretches[a, b][n] for n in names] == [np.flatnonzero(edges == v).tolist() for v in (1, -1)]
            assert got[doc]["n_words"] == held.sum() and got[doc]["n_passages"] == (edges == 1).sum()
    assert got[0]["n_words"] >= 140 and got[3]["n_words"] >= 140 and got[3]["n_passages"] == 2 and got[2]["n_passages"] == 1


def mixed_copies(rows, weights=(3.0, 1.0, 2.0), budget=1.5, epochs=2):
    """Ids, as often as the mix takes them, in plain Python; rows: id, text, source."""
    sizes = {i: len([w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]) for i, text, _ in rows}
    totals = Counter()
    for i, _, source in rows:
        totals[source] += sizes[i]
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, target, rest = budget * sum(totals.values()), {}, sorted(names, key=lambda s: (epochs * totals[s] / weight[s], s is None, s or ""))
    while rest:
        level = left / sum(weight[s] for s in rest)
        if epochs * totals[rest[0]] / weight[rest[0]] > level:
            target |= {s: level * weight[s] for s in rest}
            break
        target[rest[0]] = float(epochs * totals[rest[0]])
        left -= target[rest.pop(0)]
    queue, through = [], Counter()
    for key, i, source in sorted((hashlib.md5(str(i).encode()).hexdigest(), i, source) for i, _, source in rows):
        through[source] += sizes[i]
        if sizes[i] and target[source]:
            queue += [((through[source] + e * totals[source]) / target[source], key, i) for e in range(epochs)]
    out, served = [], 0
    for _, _, i in sorted(queue):
        served += sizes[i]
        if served > round(sum(target.values())):
            break
        out.append(i)
    return out


def test_pipeline_equals_plain_python(spark, tmp_path):
    """All five stages on the small table and odd rows; the language is the operator's own."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = [(9001, None, "en", "src1"), (9002, "1234 5678 --", None, "src2"), (9003, "", "fr", None), (9004, "<|endoftext|> " + " the is of".join("abcdefgh") * 900, "en", None)]
    odd = spark.createDataFrame([(*r, 7) for r in odd], docs.schema)
    docs.unionByName(odd).unionByName(docs.filter("doc_id = 5")).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    predicted = identify(docs, F.lit(True)).select("id", "lang_pred", "score").collect()
    kept = {r["id"] for r in predicted if r["lang_pred"] != "und" and r["score"] >= 0.5}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect() if r["doc_id"] in kept]
    assert len(rows) == docs.count() - 3 and len(set(rows)) == len(rows) - 1
    rows = sorted(set(rows), key=lambda r: r[0])
    first = {}
    for i, text, _ in sorted(rows):
        first.setdefault(text, i)
    rows = [r for r in rows if first[r[1]] == r[0]]
    near = linked({i: text for i, text, _ in rows}, 5, 80)
    assert any(near[i][1] != i for i, _, _ in rows)
    rows = [r for r in rows if near[r[0]][1] == r[0]]
    library, texts, expected = Tokenizer.from_file(bpe.vocabulary_path()), {i: text for i, text, _ in rows}, []
    for i in mixed_copies(rows):
        ids = library.encode(texts[i], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back))))
    got = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(expected)


def test_far_passages_end_early(monkeypatch):
    """With 46 different shingles each 41 must be common: passages that have 40 are not compared any further."""
    rng = np.random.default_rng(31)
    one = rng.integers(0, 1 << 30, 300).astype(np.int32)
    for common, near in ((41, True), (40, False)):
        two = rng.integers(1 << 30, (1 << 31) - 1, 200).astype(np.int32)
        two[60 : 60 + common] = one[100 : 100 + common]
        other = compact_windows.Sequence(two, np.empty(0, np.int32))
        side = compact_windows._Side(compact_windows.Sequence(one, np.empty(0, np.int32)), other)
        assert side.open.any() == near
        assert bool(compact_windows.alike_passages(one, other)) == near
    shingles = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    few = compact_windows._tokens(shingles)[100:108]
    monkeypatch.setattr(compact_windows, "_bounds", lambda _: pytest.fail("too few shared shingles for a link"))
    assert not len(compact_windows.least_windows(shingles, lambda names: (np.isin(names, few), np.zeros(len(names), np.int64))))


def test_bounds_of_repeating_texts():
    rng = np.random.default_rng(32)
    span, least = compact_windows.SPAN, compact_windows.LEAST
    for kinds in (3, 20, 60, 5000):
        shingles = rng.integers(0, 1 << 62, kinds).astype(np.uint64)[rng.integers(0, kinds, 300)]
        bounds, marks = compact_windows._bounds(shingles)
        for s in range(len(shingles) - span + 1):
            different = sorted(set(shingles[s : s + span].tolist()))
            assert marks[s] == sum(len(different) < k for k in compact_windows.FULL)
            # With fewer all stand for the passage.
            assert bounds[s] == (different[least - 1] if len(different) >= least else ~np.uint64(0))


def test_alike_passages_where_windows_meet():
    """Looking up shingles first and counting windows per passage leaves the same stretches as counting them first."""
    rng, met = np.random.default_rng(33), 0
    for k in range(30):
        one = rng.integers(0, 1 << 62, 20 if k % 3 == 0 else 4000).astype(np.uint64)
        one = one[rng.integers(0, len(one), 260)]
        two = rng.integers(0, 1 << 62, 240).astype(np.uint64)
        two[70:150] = one[90:170]
        two[rng.integers(70, 150, k % 12)] = rng.integers(0, 1 << 62, k % 12).astype(np.uint64)
        names = [compact_windows._tokens(x) for x in (one, two)]
        marks = [compact_windows._bounds(x)[1].max() for x in (one, two)]
        shared = [lambda n, o=o: (np.isin(n, o), np.full(len(n), max(marks))) for o in names[::-1]]
        a, b = (compact_windows.least_windows(x, f).astype(np.int32) for x, f in zip((one, two), shared, strict=True))
        one, two = (x.astype(np.uint32).view(np.int32) for x in (one, two))
        other = compact_windows.Sequence(one, a)
        every = compact_windows.alike_passages(two, other)
        found = compact_windows.alike_passages(two, other, b) if len(a) and len(b) else []
        assert [set(x) for x in zip(*found)] == [set(x) for x in zip(*every)]
        before = compact_windows.similar_passages(compact_windows.meetings(b, other), two, other) if len(a) and len(b) else []
        assert [set(x) for x in zip(*found)] == [set(x) for x in zip(*before)]
        met += bool(found)
    assert 5 < met < 30
