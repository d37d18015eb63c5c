"""Toxicity by a small bidirectional gated recurrent network, trained in numpy.

A word enters as its own vector next to the mean of the vectors of its character
trigrams, so that unseen words are judged by their letters. A recurrent layer runs
over each window in both directions; attention weighs its states, and a logistic
unit gives the score. Windows of ``WINDOW`` words overlap by half, all of them are
scored, and a document has the score of its highest window.

The network is trained on the driver on about ``MAX_TRAINING_DOCS`` labelled
documents, half of them of each label if there are so many, none longer than
``MAX_TRAINING_BYTES`` (documented bounds; chosen by a hash of the id). The labels are for
documents, so of each the window with the most telling words is learned from at
first, then the one that scores highest, and for clean ones a second window. Words
that two of these documents have get a vector of their own.
Scoring is a map over the rows; texts of any length are scored whole.

Null and empty texts are one window of padding. Rows that repeat a document are
scored each, alike. Rows without an id are scored; a label without an id teaches nothing.
A document with several labels is learned with the highest. Without
labels of both kinds every score is the share of label 1 (0 without any). A score of
exactly 0.5 counts as toxic. Extra columns play no part.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.llm.common import read_table, stage
from vitaframe.llm.language_id import remainder

MAX_TRAINING_DOCS = 4_000
MAX_TRAINING_BYTES = 1 << 16  # longer documents are scored, not learned from
TRIGRAMS = 1 << 12
SIZE = 8  # of a word's vector, of its letters' vector, and of the state of one direction
WINDOW = 32
STEP = WINDOW // 2
ROUNDS, EPOCHS = 3, 3
RATE = 0.01
CACHED_WORDS = 200_000
SCORED = 512  # windows in one product
AT_A_TIME = 1 << 18  # characters scored together
HALF = np.repeat(np.array([0.5, 0.5, 1.0], np.float32), SIZE)
_LETTERS = regex.compile(r"\p{L}+")
PAD = 0


def words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def _checksum_parts() -> np.ndarray:
    """What each byte at each place of three adds (by exclusive or) to their checksum."""
    zero = zlib.crc32(bytes(3))
    places = np.eye(3, dtype=int)
    parts = [[zlib.crc32(bytes((places[k] * b).tolist())) ^ zero for b in range(256)] for k in range(3)]
    parts[0] = [x ^ zero for x in parts[0]]
    return np.array(parts, np.int64) % TRIGRAMS


_PARTS = _checksum_parts()


def trigrams_of(several: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The letter trigrams of words, marked at both ends, one after the other; where each word's start."""
    marked = [f"<{w}>".encode() for w in several]
    data = np.frombuffer(b"".join(marked) + bytes(2), np.uint8)
    ids = _PARTS[0][data[:-2]] ^ _PARTS[1][data[1:-1]] ^ _PARTS[2][data[2:]]
    ends = np.cumsum([len(m) for m in marked], dtype=np.int64)
    own = np.ones(len(ids), bool)
    own[ends - 1] = own[ends - 2] = False  # they reach into the next word
    starts = np.concatenate(([0], ends))[:-1] - 2 * np.arange(len(marked))
    return ids[own], starts


def trigrams(word: str) -> np.ndarray:
    return trigrams_of([word])[0]


def window_starts(n: int) -> list[int]:
    """Starts of the windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STEP), n - WINDOW]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters, and the forward and backward passes over windows of word rows."""

    def __init__(self, vocabulary: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.place = {w: i + 1 for i, w in enumerate(vocabulary)}
        h, d = SIZE, 2 * SIZE

        def normal(*shape, scale=0.3):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.p = {
            "word": normal(len(vocabulary) + 1, SIZE, scale=0.1), "letters": normal(TRIGRAMS, SIZE, scale=0.1),
            "att_w": normal(2 * h, h), "att_v": normal(h), "out": normal(2 * h), "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            self.p |= {f"{side}x": normal(d, 3 * h), f"{side}h": normal(h, 3 * h), f"{side}b": np.zeros(3 * h, np.float32)}
        self.p["word"][PAD] = 0

    def inputs(self, word: str) -> np.ndarray:
        return self.rows([word])[0]

    def rows(self, several: list[str]) -> np.ndarray:
        """A row per word: its vector (zeros if unseen) and the mean of its trigrams'."""
        own = self.p["word"][[self.place.get(w, PAD) for w in several]]
        ids, starts = trigrams_of(several)
        letters = np.add.reduceat(self.p["letters"][ids], starts, axis=0)
        return np.concatenate([own, letters / np.diff(starts, append=len(ids))[:, None]], axis=1)

    def _run(self, side: str, gates: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction. gates: time, window, 3 * SIZE from the inputs alone."""
        n, h = gates.shape[1], SIZE
        state = np.zeros((n, h), np.float32)
        out = np.empty((len(gates), n, h), np.float32)
        rec = self.p[f"{side}h"]
        for t in range(len(gates)) if side == "f" else range(len(gates) - 1, -1, -1):
            old = state @ rec
            zr = _sigmoid(gates[t, :, : 2 * h] + old[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[t, :, 2 * h :] + r * old[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, r, new, old[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def head(self, states: np.ndarray):
        """Attention over time and the logit. states: time, window, 2 * SIZE."""
        hidden = np.tanh(states @ self.p["att_w"])
        weight = hidden @ self.p["att_v"]
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        return hidden, weight, pooled, pooled @ self.p["out"] + self.p["bias"]

    def tables(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """What word rows give to the gates of each direction."""
        return {s: (rows @ self.p[f"{s}x"] + self.p[f"{s}b"]).astype(np.float32) for s in "fb"}

    def halved(self, rows: np.ndarray) -> np.ndarray:
        """The tables for ``score``, side by side: forward, backward.

        A logistic gate is a hyperbolic tangent of half its input; the halves are taken here.
        """
        both = self.tables(rows)
        return np.concatenate([both[s] * HALF for s in "fb"], axis=1)

    def score(self, table: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Scores of windows given as rows of the halved tables (window, time).

        Both directions take a step in the same products.
        """
        h = SIZE
        # Columns: update, reset and new gate, each of the forward and the backward state.
        rec = np.zeros((2, h, 3, 2, h), np.float32)
        for k, s in enumerate("fb"):
            rec[k, :, :, k] = (self.p[f"{s}h"] * HALF).reshape(h, 3, h)
        rec = rec.reshape(2 * h, 6 * h)
        out = np.empty(len(windows), np.float32)
        for k in range(0, len(windows), SCORED):
            part = np.ascontiguousarray(windows[k : k + SCORED].T)
            steps, n = part.shape
            state, old = np.zeros((n, 2 * h), np.float32), np.empty((n, 6 * h), np.float32)
            gates, new = np.empty((n, 3, 2, h), np.float32), np.empty((n, 2 * h), np.float32)
            flat, states = gates.reshape(n, 6 * h), np.empty((steps, n, 2 * h), np.float32)
            logistic = flat[:, : 4 * h]
            for t in range(steps):
                gates[:, :, 0] = table[part[t], : 3 * h].reshape(n, 3, h)
                gates[:, :, 1] = table[part[steps - 1 - t], 3 * h :].reshape(n, 3, h)
                np.matmul(state, rec, out=old)
                logistic += old[:, : 4 * h]
                np.tanh(logistic, out=logistic)
                logistic += 1.0
                logistic *= 0.5
                np.multiply(logistic[:, 2 * h :], old[:, 4 * h :], out=new)
                new += flat[:, 4 * h :]
                np.tanh(new, out=new)
                state -= new
                state *= logistic[:, : 2 * h]
                state += new
                states[t, :, :h] = state[:, :h]
                states[steps - 1 - t, :, h:] = state[:, h:]
            out[k : k + SCORED] = _sigmoid(self.head(states)[3])
        return out

    def gradients(self, ids: np.ndarray, grams: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict:
        """ids: time, window (words of this batch, numbered); grams: trigrams of each."""
        p, h = self.p, SIZE
        vocab_rows, pieces = grams
        owner = np.repeat(np.arange(len(pieces)), [len(x) for x in pieces])
        flat = np.concatenate(pieces) if len(pieces) else np.empty(0, np.int64)
        count = np.bincount(owner, minlength=len(pieces)).astype(np.float32)
        letters = np.zeros((len(pieces), SIZE), np.float32)
        np.add.at(letters, owner, p["letters"][flat])
        letters /= np.maximum(count, 1)[:, None]
        x = np.concatenate([p["word"][vocab_rows], letters], axis=1)
        table = self.tables(x)
        kept = {s: [] for s in "fb"}
        states = np.concatenate([self._run(s, table[s][ids], kept[s]) for s in "fb"], axis=2)
        hidden, att, pooled, logit = self.head(states)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d_logit = (_sigmoid(logit) - y) * weight / len(y)
        g["out"], g["bias"] = pooled.T @ d_logit, np.array([d_logit.sum()], np.float32)
        d_pooled = d_logit[:, None] * p["out"]
        d_states = att[:, :, None] * d_pooled
        d_att = (states * d_pooled).sum(axis=2)
        d_score = att * (d_att - (att * d_att).sum(axis=0))
        g["att_v"] = np.einsum("tnh,tn->h", hidden, d_score)
        d_hidden = d_score[:, :, None] * p["att_v"] * (1 - hidden**2)
        g["att_w"] = np.einsum("tni,tnj->ij", states, d_hidden)
        d_states = d_states + d_hidden @ p["att_w"].T
        d_x = np.zeros_like(x)
        for k, s in enumerate("fb"):
            rec, d_next = p[f"{s}h"], np.zeros_like(states[0, :, :h])
            d_table = np.zeros_like(table[s])
            for t, before, z, r, new, old in reversed(kept[s]):
                d = d_states[t, :, k * h : (k + 1) * h] + d_next
                d_new = d * (1 - z) * (1 - new**2)
                d_z = d * (before - new) * z * (1 - z)
                d_r = d_new * old * r * (1 - r)
                d_gate = np.concatenate([d_z, d_r, d_new], axis=1)
                d_old = np.concatenate([d_z, d_r, d_new * r], axis=1)
                g[f"{s}h"] += before.T @ d_old
                d_next = d * z + d_old @ rec.T
                np.add.at(d_table, ids[t], d_gate)
            g[f"{s}x"], g[f"{s}b"] = x.T @ d_table, d_table.sum(axis=0)
            d_x += d_table @ p[f"{s}x"].T
        np.add.at(g["word"], vocab_rows, d_x[:, :SIZE])
        g["word"][PAD] = 0
        np.add.at(g["letters"], flat, (d_x[:, SIZE:] / np.maximum(count, 1)[:, None])[owner])
        return g


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> Network | float:
    """The network, or the share of label 1 if only one label occurs."""
    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    found = [words(t) for t in texts]
    pos, neg = Counter(), Counter()
    for ws, label in zip(found, labels, strict=True):
        (pos if label else neg).update(set(ws))
    n_pos, n_neg = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    both = pos + neg
    vocabulary = sorted(w for w, n in both.items() if n > 1)
    telling = {w: np.log((pos[w] + 1) / (n_pos + 2)) - np.log((neg[w] + 1) / (n_neg + 2)) for w in both}
    best = [max(window_starts(len(ws)), key=lambda s: max([telling[w] for w in ws[s : s + WINDOW]], default=0)) for ws in found]
    rng, net = np.random.default_rng(seed), Network(vocabulary, seed)
    moments = tuple({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    step = 0
    for _ in range(ROUNDS):
        examples, targets = [], []
        for ws, label, s in zip(found, labels, best, strict=True):
            starts = window_starts(len(ws))
            for start in [s] if label else [s, starts[rng.integers(len(starts))]]:
                examples.append(ws[start : start + WINDOW])
                targets.append(label)
        step = _descend(net, examples, np.array(targets, np.float32), moments, step, rng)
        scorer, best = Scorer(net), []
        for k in range(0, len(texts), 50):
            best += scorer.highest(texts[k : k + 50])[1]
    return net


def _descend(net: Network, examples: list[list[str]], targets: np.ndarray, moments, step: int, rng) -> int:
    """Some epochs over the windows given; returns the number of steps so far."""
    weight = np.where(targets > 0, min(4.0, (len(targets) - targets.sum()) / targets.sum()), 1).astype(np.float32)
    (first, second), none = moments, np.empty(0, np.int64)
    for _ in range(EPOCHS):
        order = rng.permutation(len(examples))
        for k in range(0, len(order), 64):
            batch = order[k : k + 64]
            numbers: dict[str, int] = {"": 0}
            ids = np.zeros((WINDOW, len(batch)), np.int64)
            for j, i in enumerate(batch):
                for t, w in enumerate(examples[i]):
                    ids[t, j] = numbers.setdefault(w, len(numbers))
            pieces = [none if not w else trigrams(w) for w in numbers]
            rows = np.array([net.place.get(w, PAD) for w in numbers], np.int64)
            # Words are hidden now and then, so that letters learn to tell as well.
            rows[rng.random(len(rows)) < 0.3] = PAD
            g = net.gradients(ids, [rows, pieces], targets[batch], weight[batch])
            step += 1
            norm = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            rate = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
            for name, v in g.items():
                v *= min(1.0, 1.0 / (norm + 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * v
                second[name] = 0.99 * second[name] + 0.01 * v * v
                net.p[name] -= (rate * first[name] / (np.sqrt(second[name]) + 1e-6)).astype(np.float32)
            net.p["word"][PAD] = 0
    return step


class _Numbers(dict):
    """Words by the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Scorer:
    """Scores texts; keeps the rows of words it has met, up to a bound."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers({"": 0})
        self.table = np.zeros((1024, 6 * SIZE), np.float32)
        self.table[0] = self.net.halved(np.zeros((1, 2 * SIZE), np.float32))

    def _learn(self, fresh: list[str]) -> None:
        """Rows of the words numbered last."""
        size = len(self.number)
        if size > len(self.table):
            grown = np.empty((2 * size, 6 * SIZE), np.float32)
            grown[: len(self.table)] = self.table
            self.table = grown
        self.table[size - len(fresh) : size] = self.net.halved(self.net.rows(fresh))

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.highest(texts)[0]

    def score_all(self, texts: list[str | None]) -> np.ndarray:
        """Scores, so many characters at a time (a long text on its own)."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= AT_A_TIME:
                out.append(self.score(held))
                held, size = [], 0
        if held:
            out.append(self.score(held))
        return np.concatenate(out) if out else np.empty(0)

    def highest(self, texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
        """Each text's highest window score, and where that window starts."""
        if len(self.number) > CACHED_WORDS:
            self.clear()
        number, windows, begins = self.number, [], []
        before = len(number)
        for text in texts:
            ids = [number[w] for w in words(text)]
            rows = np.array(ids + [0] * (WINDOW - len(ids)), np.int32)
            begins.append(np.array(window_starts(len(ids))))
            windows.append(rows[begins[-1][:, None] + np.arange(WINDOW)])
        if len(number) > before:
            self._learn(list(islice(number, before, None)))
        scores = np.split(self.net.score(self.table, np.concatenate(windows)), np.cumsum([len(b) for b in begins])[:-1])
        best = [int(s.argmax()) for s in scores]
        return np.array([float(s[i]) for s, i in zip(scores, best, strict=True)]), [int(b[i]) for b, i in zip(begins, best, strict=True)]


_LOADED: dict[str, Scorer] = {}


def fit(docs: DataFrame, labels: DataFrame, training: Column, id_col: str, text_col: str, max_docs: int) -> Network | float:
    """Trains on a sample of labelled rows of the training part, about half of each label.

    At most about ``max_docs`` documents of at most MAX_TRAINING_BYTES each reach the driver.
    """
    label = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    label = label.groupBy(F.col(id_col).alias("l_id")).agg((F.max("toxic") > 0).cast("int").alias("l_toxic"))
    label = stage(label.filter(training), "toxic-labels")
    size = {r[0]: r[1] for r in label.groupBy("l_toxic").agg(F.count(F.lit(1))).collect()}
    place = F.pmod(F.xxhash64(F.col("l_id").cast("string")), F.lit(1_000_000))
    share = F.lit(0)
    for kind, n in size.items():
        share = F.when(F.col("l_toxic") == kind, F.lit(int(min(1.0, max_docs / 2 / n) * 1_000_000))).otherwise(share)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(
        F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_TRAINING_BYTES
    )
    # About max_docs rows, so that no text is shuffled for them.
    rows = rows.join(F.broadcast(label.filter(place < share)), F.col("id") == F.col("l_id"))
    rows = sorted(rows.select("id", "text", "l_toxic").collect(), key=lambda r: (r[0], r[1] or ""))
    return train([r[1] for r in rows], [r[2] for r in rows])


def score_toxicity(
    docs: DataFrame, labels: DataFrame, training: Column, id_col: str = "doc_id",
    text_col: str = "text", max_docs: int = MAX_TRAINING_DOCS,
) -> DataFrame:
    """id and score of every row. ``training`` is a condition on ``l_id``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, training, id_col, text_col, max_docs))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    name = uuid.uuid4().hex  # of this model, in workers that outlive it

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = model.value
        if isinstance(net, float):
            for part in texts:
                yield pd.Series(np.full(len(part), net))
            return
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = Scorer(net)
        for part in texts:
            yield pd.Series(_LOADED[name].score_all(part.tolist()))

    return slim.select(F.col("id").alias(id_col), score("text").alias("score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = score_toxicity(docs, labels, remainder("l_id", 5) != 0)
    held_out = (remainder("doc_id", 5) == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
