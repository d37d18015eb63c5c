"""Text operators against plain Python that shares no code with them."""

from __future__ import annotations

import os
import struct
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from vitaframe.llm import bpe, compact_windows, jaccard_join, language_id, toxicity, warc  # noqa: E402
from vitaframe.llm.language_id import identify  # noqa: E402
from vitaframe.llm.queries import QUERIES  # noqa: E402
from vitaframe.llm.shared_tokens import cut_bits, is_shared, shared_tokens  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def plain_words(text, lower=True):
    """Runs of anything but space and code points 9 to 13; A-Z in lower case."""
    out, word = [], ""
    for c in text or "":
        if c == " " or "\t" <= c <= "\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c
    return [*out, word] if word else out


def plain_sets(texts, n):
    out = {}
    for i, text in texts.items():
        ws = plain_words(text)
        size = min(n, len(ws))
        out[i] = {tuple(ws[k : k + size]) for k in range(len(ws) - size + 1)} if ws else set()
    return out


def plain_components(nodes, linked):
    root = {k: k for k in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = sorted(nodes)
    for k, a in enumerate(nodes):
        for b in nodes[k + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in nodes}


def test_jaccard_join_query_equals_sets_of_words(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    sets = plain_sets({r[0]: r[1] for r in docs.select("doc_id", "text").collect()}, 3)
    roots = plain_components(sets, lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op10_jaccard_join"](spark, SMALL).collect()}
    assert got == {i: (len(sets[i]), roots[i]) for i in sets}


def test_counts_are_added_in_two_steps(spark):
    rows = [(f"a{i % 7} b{i % 5} c{i % 3} d e f{i}",) for i in range(400)]
    counts = jaccard_join.count_ngrams(spark.createDataFrame(rows, "text string").repartition(20), 3)
    plain = Counter(int(h) >> (64 - jaccard_join.COUNT_BITS) for (t,) in rows for h in jaccard_join.shingles(t, 3))
    assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == plain


# One level of ranges, and two with few and with many coarse ranges.
@pytest.mark.parametrize("range_tokens,level_ranges", [(1 << 19, 4096), (40, 8), (10, 64)])
def test_shared_tokens(spark, range_tokens, level_ranges):
    rng = np.random.default_rng(3)
    lists = {f"d{i}": np.unique(rng.integers(0, 2**64, 30, dtype=np.uint64)) for i in range(200)}
    names = sorted(lists)
    for k in range(0, 150):  # tokens of two to fifty documents
        token = rng.integers(0, 2**64, dtype=np.uint64)
        for name in rng.choice(names, [2, 3, 50][k % 3], replace=False):
            lists[name] = np.unique(np.append(lists[name], token))
    held = Counter(t for tokens in lists.values() for t in tokens.tolist())
    rows = [(n, lists[n].view(np.int64).tolist()) for n in names]
    df = spark.createDataFrame(rows, "id string, tokens array<bigint>").repartition(9)
    total = sum(map(len, lists.values()))
    found: dict[str, list] = {}
    for r in shared_tokens(df, total, range_tokens=range_tokens, level_ranges=level_ranges).collect():
        found.setdefault(r["id"], []).extend(r["tokens"])
    for name in names:
        got = is_shared(lists[name].view(np.int64), np.array(found.get(name, []), np.int64), total)
        assert got.tolist() == [held[t] > 1 for t in lists[name].tolist()]
    assert cut_bits(total) >= 32


# ------------------------------------------------------------------ toxicity


def plain_score(net, text):
    """Every window word by word, in double precision, straight from the formulas."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    p, h = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.SIZE
    ws = toxicity.words(text)

    def entry(word):
        if word is None:
            return np.zeros(2 * h)
        marked = f"<{word}>".encode()
        grams = [zlib.crc32(marked[i : i + 3]) % toxicity.TRIGRAMS for i in range(len(marked) - 2)]
        own = p["word"][net.place[word]] if word in net.place else np.zeros(h)
        return np.concatenate([own, np.mean([p["letters"][g] for g in grams], axis=0)])

    def states(side, entries):
        state, out = np.zeros(h), []
        for x in entries if side == "f" else entries[::-1]:
            own, old = x @ p[f"{side}x"] + p[f"{side}b"], state @ p[f"{side}h"]
            z, r = sigmoid(own[:h] + old[:h]), sigmoid(own[h : 2 * h] + old[h : 2 * h])
            new = np.tanh(own[2 * h :] + r * old[2 * h :])
            state = z * state + (1 - z) * new
            out.append(state)
        return out if side == "f" else out[::-1]

    n, best = len(ws), 0.0
    starts = [0] if n <= toxicity.WINDOW else [*range(0, n - toxicity.WINDOW, toxicity.STEP), n - toxicity.WINDOW]
    for s in starts:
        window = ws[s : s + toxicity.WINDOW]
        entries = [entry(w) for w in window] + [entry(None)] * (toxicity.WINDOW - len(window))
        both = np.array([np.concatenate(x) for x in zip(states("f", entries), states("b", entries), strict=True)])
        weight = np.tanh(both @ p["att_w"]) @ p["att_v"]
        weight = np.exp(weight - weight.max())
        pooled = (weight[:, None] * both).sum(axis=0) / weight.sum()
        best = max(best, float(sigmoid(pooled @ p["out"] + p["bias"][0])))
    return best


def test_scores_are_those_of_all_windows():
    texts = [None, "", "one", "Été, là-bas? 你好 naïve word", " ".join(f"w{'abcdefg'[i % 7]}{'xyz'[i % 3]}" for i in range(33)),
             " ".join("abcdefghij"[i % 10] * (1 + i % 4) for i in range(700)), "x" * 5000 + " y", "the same line again\n" * 60]
    vocabulary = sorted({w for t in texts[3:6] for w in toxicity.words(t)})[::2]
    net = toxicity.Network(vocabulary, seed=3)
    for name in ("out", "att_v", "fh", "bh", "fx", "bx"):
        net.p[name] *= 3  # scores far from one half
    scorer = toxicity.Scorer(net)
    expected = [plain_score(net, t) for t in texts]
    assert np.ptp(expected) > 0.1
    assert np.allclose(scorer.score(texts), expected, atol=2e-5)
    # One at a time, again (from kept rows), and after rows were thrown away.
    assert np.allclose([scorer.score([t])[0] for t in texts], expected, atol=2e-5)
    scorer.clear()
    assert np.allclose(scorer.score_all(texts * 3), expected * 3, atol=2e-5)


def test_trigrams_of_many_words_are_those_of_each():
    words = ["a", "ab", "été", "你", "x" * 40, "naïve"]
    ids, starts = toxicity.trigrams_of(words)
    for word, part in zip(words, np.split(ids, starts[1:]), strict=True):
        marked = f"<{word}>".encode()
        assert part.tolist() == [zlib.crc32(marked[i : i + 3]) % toxicity.TRIGRAMS for i in range(len(marked) - 2)]


def test_toxicity_on_held_out_labels(spark):
    """At sf0.1: of held-out documents over 0.85 of the toxic are found, under 0.03 of the others marked."""
    folder = "/root/testdata/sf0.1"
    labels = {}
    for r in spark.read.parquet(f"{folder}/labels.parquet").filter("toxic is not null").collect():
        labels[r["doc_id"]] = max(labels.get(r["doc_id"], 0), r["toxic"])
    rows = [r for r in QUERIES["op9_toxicity"](spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in rows)
    toxic = [r["predicted"] for r in rows if labels[r["doc_id"]] == 1]
    clean = [r["predicted"] for r in rows if labels[r["doc_id"]] == 0]
    assert len(toxic) > 50 and np.mean(toxic) > 0.85 and np.mean(clean) < 0.03


# ------------------------------------------------------------------ languages, archives


def test_seventy_languages(spark):
    """Each language with a label can be predicted, a rare one among frequent ones, too."""
    rng = np.random.default_rng(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicon = {f"l{k:02}": ["".join(rng.choice(list(letters), 6)) for _ in range(40)] for k in range(70)}
    rows, n = [], 0
    for k, (lang, words) in enumerate(lexicon.items()):
        for _ in range(300 if k == 0 else 6):
            rows.append((n, " ".join(rng.choice(words, 30)), lang))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = identify(docs, F.col("doc_id") % 3 != 0, max_docs=700)
    truth = {r[0]: r[2] for r in rows}
    assert all(r["lang_pred"] == truth[r["id"]] for r in found.collect())


def plain_language(rows, text):
    """The formulas of the model for one text, word by word."""
    languages = sorted({r[0] for r in rows})
    n = {(lang, kind, gram): c for lang, kind, gram, c in rows}
    total = Counter()
    for lang, kind, _, c in rows:
        total[lang, kind] += c
    kinds = {kind: {r[2] for r in rows if r[1] == kind} for kind in range(6)}

    def log(lang, kind, gram):
        return np.log(n.get((lang, kind, gram), 0) + 0.5) - np.log(total[lang, kind] + 0.5 * (len(kinds[kind]) + 1))

    found = [w for w in regex.findall(r"\p{L}+", text.lower())]
    if not found:
        return "und", 0.0
    means = []
    for word in found:
        parts = [word] if word in kinds[0] else []
        kind = 0
        for size in range(5, 0, -1):
            if not parts:
                marked = f"<{word}>"
                parts, kind = [g for i in range(len(marked) - size + 1) if (g := marked[i : i + size]) in kinds[size]], size
        means.append([np.mean([log(lang, kind, g) for g in parts]) if parts else 0.0 for lang in languages])
    score = np.mean(means, axis=0) * min(len(found), 20)
    share = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
    return languages[int(np.argmax(score))], float(share.max())


def test_language_scores_equal_the_formulas(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = language_id.fit(docs, F.col("doc_id") % 4 != 2, "doc_id", "text", "lang", 5_000)
    texts = {r[0]: r[1] or "" for r in docs.select("doc_id", "text").collect() if len(r[1] or "") < 20_000}
    got = {r["id"]: r for r in identify(docs, F.col("doc_id") % 4 != 2).collect()}
    for i, text in sorted(texts.items())[:120]:
        lang, share = plain_language(rows, text)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(share, abs=1e-9)


def test_small_archives_have_a_dictionary_too():
    records = [f"WARC/1.1\r\nWARC-Type: response\r\n\r\nbody {i}".encode() for i in range(3)]
    for several in (records, records * 40, []):
        content = warc.archive_bytes(several)
        magic, size = struct.unpack_from("<II", content)
        assert 0x184D2A50 <= magic <= 0x184D2A5F and size > 0
        assert list(warc.archive_records(content))[1:] == several
        # A record is a frame of its own: any one can be read alone with the dictionary.
        dictionary = zstandard.ZstdCompressionDict(content[8 : 8 + size])
        at = 8 + size
        for record in [warc._info(), *several]:
            frame = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True).compress(record)
            alone = zstandard.ZstdDecompressor(dict_data=dictionary).decompress(content[at : at + len(frame)])
            assert alone == record
            at += len(frame)
        assert at == len(content)


def test_an_empty_table_of_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    folder = str(tmp_path / "none")
    warc.write_archives(pages, folder)
    assert warc.read_archives(spark, folder).count() == 0


# ------------------------------------------------------------------ passages


def alike_passage(one, two):
    """Whether some 46 five-word shingles in a row of each have a Jaccard similarity of 0.8."""
    span, common = 46, set(one) & set(two)
    sides = []
    for own in (one, two):
        windows = (set(own[s : s + span]) for s in range(len(own) - span + 1))
        sides.append([w for w in windows if 100 * len(w & common) >= 80 * len(w)])
    return any(100 * len(x & y) >= 80 * len(x | y) for x in sides[0] for y in sides[1])


def test_classes_of_passages_equal_all_pairs(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    grams = {}
    for r in docs.collect():
        ws = plain_words(r["text"])
        grams[r["doc_id"]] = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
    holders: dict[tuple, set] = {}
    for i, own in grams.items():
        for g in own:
            holders.setdefault(g, set()).add(i)
    shared = Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)
    linked = {p for p, n in shared.items() if n >= 20 and min(len(grams[p[0]]), len(grams[p[1]])) >= 46 and alike_passage(grams[p[0]], grams[p[1]])}
    roots = plain_components(grams, lambda a, b: (a, b) in linked)
    got = {r["doc_id"]: r for r in QUERIES["op5_substring_dedup"](spark, SMALL).collect()}
    assert len(linked) > 5 and {i: r["class_id"] for i, r in got.items()} == roots
    assert {i for i, r in got.items() if r["n_links"]} == {i for p in linked for i in p}


def test_a_line_that_very_many_texts_share_brings_no_pairs(spark):
    """A line under 50 words in unrelated texts is no passage; one in two of them is found all the same."""
    rng = np.random.default_rng(12)
    line = [f"line{k}" for k in range(44)]
    words = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    passage = words(60)
    texts = [words(70) + line + words(70) + (passage if i in (3, 77) else words(60)) for i in range(120)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in compact_windows.repeated_passages(docs).collect()}
    assert {i: r["class_id"] for i, r in got.items() if r["class_id"] != i} == {77: 3}
    assert [got[i]["n_passages"] for i in (3, 77, 4)] == [1, 1, 0]


def test_alike_passages_share_least():
    """Of the smallest shingles of every two alike passages as many are common as their marks ask for."""
    span, least = compact_windows.SPAN, compact_windows.LEAST
    for a in range(1, span + 1):
        for b in range(1, span + 1):
            for c in range(1, min(a, b) + 1):
                if 100 * c < compact_windows.THRESHOLD * (a + b - c):
                    continue
                # The worst case: what is not common comes first.
                one, two = set(range(-a + c, c)), {k for k in range(c)} | {-0.5 - k for k in range(b - c)}
                common = len(set(sorted(one)[:least]) & set(sorted(two)[:least]))
                mark = sum(min(a, b) < k for k in compact_windows.FULL)
                assert common >= compact_windows.common_least(a, b) >= compact_windows.NEEDED[mark]


def test_every_passage_at_the_threshold_is_found(spark):
    """Fifty words of which one differs, just alike, in unrelated texts; also where the words repeat."""
    rng = np.random.default_rng(13)
    rows, alike = [], {}
    for i in range(300):
        words = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
        # Every third passage repeats words; its texts have no other.
        passage = [f"r{i}x{k}" for k in rng.integers(0, 3, 50)] if i % 3 == 0 else words(50)
        copy = list(passage)
        copy[int(rng.integers(8, 42))] = f"other{i}"
        texts = [words(30) + p + words(30) for p in (passage, copy)]
        grams = [[tuple(t[k : k + 5]) for k in range(len(t) - 4)] for t in texts]
        alike[i] = alike_passage(*grams)
        rows += [(2 * i + k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(alike.values()) > 250
    assert {i: got[2 * i + 1]["class_id"] == 2 * i and got[2 * i]["n_links"] == 1 for i in alike} == alike


def test_every_two_alike_passages_are_in_a_class():
    """Whatever the numbers of different shingles, and as many smallest ones are common as the class asks for."""
    span, n = compact_windows.SPAN, len(compact_windows.CLASSES)
    for a in range(1, span + 1):
        for b in range(1, span + 1):
            one, two = (int(compact_windows.SIDES[k]) for k in (a, b))
            both = one & (two >> n) | (one >> n) & two
            inside = [v for j, v in enumerate(compact_windows.CLASS_NEEDED) if both >> j & 1]
            common = compact_windows.common_least(a, b)
            assert not common or min(inside) <= common and inside, (a, b)


def test_texts_that_repeat_words_are_not_all_compared(spark, monkeypatch):
    """Runs of one word stand for passages of different kinds: only texts with passages of one kind meet."""
    rng = np.random.default_rng(14)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    texts = {i: words(50) + [w for k in rng.permutation(20)[:5] for w in [f"run{k}"] * int(rng.integers(14, 30))] + words(50) for i in range(80)}
    # Fifty words of a run are a passage by themselves.
    texts |= {80 + i: words(50) + [f"run{i % 20}"] * 60 + words(50) for i in range(40)}
    grams = {i: [tuple(t[k : k + 5]) for k in range(len(t) - 4)] for i, t in texts.items()}
    linked = {(a, b) for a in grams for b in grams if a < b and alike_passage(grams[a], grams[b])}
    counts, passages = [], compact_windows._passages

    def counted(pairs, *rest):
        counts.append(pairs.count())
        return passages(pairs, *rest)

    monkeypatch.setattr(compact_windows, "_passages", counted)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in compact_windows.repeated_passages(docs).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == plain_components(grams, lambda a, b: (a, b) in linked)
    assert (80, 100) in linked
    # First with the smallest holders, then across the classes that these gave.
    assert len(counts) == 2 and counts[1] < 100, counts


def test_texts_with_edits_everywhere_are_not_compared_further():
    """Of each passage 41 shingles must be in the other text; a text with an edit in every 20 words has no such one."""
    rng = np.random.default_rng(15)
    base = rng.integers(0, 1 << 30, 400).astype(np.int32)
    texts = [rng.integers(1 << 30, (1 << 31) - 1, 40).astype(np.int32)]
    for every in (20, 45, 60, 400):
        text = base.copy()
        for k in range(every // 2, 400, every):
            text[k : k + 5] = rng.integers(1 << 30, (1 << 31) - 1, len(text[k : k + 5]))
        texts.append(text)
    texts += [np.concatenate([texts[0], base[100:141], texts[0]]), np.concatenate([texts[0], base[100:139], texts[0]]), base[::-1].copy()]
    near = compact_windows.near_texts(base, np.concatenate(texts), np.cumsum([len(t) for t in texts]))
    assert near.tolist() == [False, False, True, True, True, True, False, True]
    other = compact_windows.Sequence(base, np.empty(0, np.int32))
    for one, fits in zip(texts[1:], near.tolist()[1:], strict=True):
        assert fits or not compact_windows.alike_passages(one, other)
    assert not compact_windows.near_texts(texts[0], np.concatenate(texts), np.cumsum([len(t) for t in texts])).any()


def test_texts_by_themselves_meet_a_large_component(spark, monkeypatch):
    """Each pair is looked at once, however texts and partners are dealt out; of an id with two texts either may be near."""
    monkeypatch.setattr(compact_windows, "PARTNERS", 2)
    monkeypatch.setattr(compact_windows, "TEXTS", 3)
    rng = np.random.default_rng(16)
    base = rng.integers(0, 1 << 30, 120).astype(np.int32)
    texts = []
    for node in range(30):
        # Every third has an edit in every 20 words and is near no other.
        text = base.copy()
        if node % 3 == 0:
            for k in range(10, 120, 20):
                text[k : k + 5] = rng.integers(1 << 30, (1 << 31) - 1, 5)
        texts.append((node, text.tolist()))
    texts.append((3, base.tolist()))
    pairs = [(a, b, 0 if a < 20 else a, 0 if b < 20 else b, True) for a in range(30) for b in range(a + 1, 30) if b >= 20]
    pairs = spark.createDataFrame(pairs, "a long, b long, a_comp long, b_comp long, full boolean")
    sequences = spark.createDataFrame(texts, "node long, shingles array<int>")
    got = sorted(map(tuple, compact_windows._near(pairs, sequences, "bigint").collect()))
    near = lambda node: node % 3 or node == 3
    assert got == [(a, b) for a in range(30) for b in range(a + 1, 30) if b >= 20 and near(a) and near(b)]


def test_copies_of_short_texts_are_no_passages(spark):
    rows = [(i, " ".join(f"some{k}" for k in range(n))) for i, n in [(1, 49), (2, 49), (3, 50), (4, 50), (4, 50)]]
    got = {r["doc_id"]: tuple(r)[1:] for r in compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 0, 0, 0), 2: (2, 0, 0, 0), 3: (3, 1, 1, 50), 4: (3, 1, 1, 50)}


# ------------------------------------------------------------------ BPE


def test_the_suffix_automaton_finds_all_words():
    rng = np.random.default_rng(13)
    for letters in (1, 2, 3, 20):
        for _ in range(25):
            words = {bytes(rng.integers(97, 97 + letters, rng.integers(1, 8)).astype(np.uint8)) for _ in range(30)}
            numbers = {w: k for k, w in enumerate(sorted(words))}
            automaton = bpe.SuffixAutomaton(numbers)
            text = bytes(rng.integers(96, 98 + letters, 60).astype(np.uint8))
            expected = [(e, e - s, numbers[text[s:e]]) for e in range(1, 61) for s in range(e) if text[s:e] in numbers]
            assert list(automaton.matches(text)) == expected
            # No more than two states for each letter of the words.
            assert len(automaton.size) <= 2 * sum(map(len, words)) + 1


def test_pieces_are_encoded_as_by_the_library():
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    own, library = bpe.Bpe(open(path).read()), Tokenizer.from_file(path)
    rng = np.random.default_rng(14)
    texts = ["", " ", "\n\n\n  x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 9, "été́ naïve ﬁ 你好 😀😀", "I'll we've 123456789 --==--", "\x00\x01"]
    texts += ["".join(chr(c) for c in rng.integers(32, 1200, 80)) for _ in range(200)]
    texts += ["".join(rng.choice(list("aeinst "), 120)) for _ in range(200)]
    for text in texts:
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
