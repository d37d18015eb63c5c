"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece of text there is one token that its encoding ends in.
A token that matches at the end of the prefix is that token exactly if the prefix
before it is empty, or if the last token stored there and this one are compatible:
merging by rank never joins anything across their border. All matches come from
one suffix automaton over the vocabulary, which is read along the piece; following the
stored tokens back from the end gives the ids. Pieces are cut by the pattern of the
tokenizer, and a piece seen before is looked up.

Null texts are empty: no tokens, an empty string when decoded. Rows that repeat a
document are encoded each. Special tokens in a text become their own id. Extra
columns play no part. Texts are taken whole, one at a time, whatever their length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.llm.common import read_table

# The pattern that cuts a text into pieces before the merges.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
CACHED_PIECES = 400_000
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file, and its byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class SuffixAutomaton:
    """Of a set of words: which of them end at each place of a text.

    A state is a class of substrings of the words that end at the same places in them; its
    link leads to the class of the longest suffix that ends at more places. A whole word
    stands at a word's beginning and so is the longest of its class. Reading a text, the
    state holds the longest suffix read that is a substring of a word: the words that end
    here are those on its chain of links.
    """

    def __init__(self, words: dict[bytes, int]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends = {}
        for word, number in words.items():
            state = 0
            for letter in word:
                state = self._extend(state, letter)
            ends[state] = number
        # The word of a state, and the next state on the chain from it (itself included) with one.
        self.word = [ends.get(state, -1) for state in range(len(self.size))]
        self.nearest = [0] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.nearest[state] = state if state in ends else self.nearest[self.link[state]]

    def _state(self, size: int, link: int, step: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.step.append(step)
        return len(self.size) - 1

    def _split(self, before: int, letter: int, state: int) -> int:
        """The part of a state that ``before`` leads to, as a state of its own."""
        part = self._state(self.size[before] + 1, self.link[state], dict(self.step[state]))
        self.link[state] = part
        while before >= 0 and self.step[before].get(letter) == state:
            self.step[before][letter] = part
            before = self.link[before]
        return part

    def _extend(self, last: int, letter: int) -> int:
        known = self.step[last].get(letter)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._split(last, letter, known)
        new, before = self._state(self.size[last] + 1, 0, {}), last
        while before >= 0 and letter not in self.step[before]:
            self.step[before][letter] = new
            before = self.link[before]
        if before >= 0:
            known = self.step[before][letter]
            whole = self.size[known] == self.size[before] + 1
            self.link[new] = known if whole else self._split(before, letter, known)
        return new

    def matches(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """End, length and number of every word in the text, by end, the longest first."""
        step, link, size, word, nearest = self.step, self.link, self.size, self.word, self.nearest
        state = length = 0
        for end, letter in enumerate(text, 1):
            following = step[state].get(letter)
            while following is None and state:
                state = link[state]
                length = size[state]
                following = step[state].get(letter)
            if following is None:
                continue
            state, length = following, length + 1
            found = nearest[state if length == size[state] else link[state]]
            while found:
                yield end, size[found], word[found]
                found = nearest[link[found]]


class _Pieces(dict):
    """Piece to the bytes of its ids (four each); forgets all when it is full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHED_PIECES:
            self.clear()
        ids = np.array(self.encode(piece.encode("utf-8")), "<i4").tobytes()
        self[piece] = ids
        return ids


class Bpe:
    """Encoder and decoder for the vocabulary of one tokenizer file (its JSON text)."""

    def __init__(self, config: str):
        spec = json.loads(config)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *specials.values()]) + 1
        self.token = [b""] * size
        for word, i in vocab.items():
            self.token[i] = bytes(letters[c] for c in word)
        for word, i in specials.items():
            self.token[i] = word.encode("utf-8")
        self.specials = specials
        self.split_specials = regex.compile(f"({'|'.join(map(regex.escape, specials))})") if specials else None
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.rank = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        for r, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            a, b, both = vocab[a], vocab[b], vocab[a + b]
            self.pair_rank[a, b] = r
            self.rank[both], self.left[both], self.right[both] = r, a, b
        self.compatible: dict[int, bool] = {}
        reachable = [False] * size
        for i in sorted(vocab.values(), key=lambda i: self.rank[i]):
            a, b, r = self.left[i], self.right[i], self.rank[i]
            if r < 0:
                reachable[i] = len(self.token[i]) == 1
            else:
                reachable[i] = reachable[a] and reachable[b] and self.apart(a, b, r)
        self.automaton = SuffixAutomaton({self.token[i]: i for i in sorted(vocab.values()) if reachable[i]})
        self.single = {self.token[i][0]: i for i in vocab.values() if len(self.token[i]) == 1}
        self.pattern = regex.compile(PIECES)
        self.pieces = _Pieces(self.encode_piece)
        self.id_text = self._table([b"%d," % i for i in range(size)])
        self.token_bytes = self._table(self.token)

    def apart(self, a: int, b: int, limit: int = NEVER) -> bool:
        """Whether merging up to rank ``limit`` leaves the border of a and b alone.

        Goes back in time: of the two tokens at the border the one formed last is
        taken apart. The pair that then meets must not rank before that merge;
        of equal ranks the left one would have been merged first.
        """
        pair_rank, rank = self.pair_rank, self.rank
        while True:
            if pair_rank.get((a, b), NEVER) < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.right[a]
            else:
                limit, b = rb + 1, self.left[b]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of a piece: the last token of every prefix, then back from the end.

        Reads the piece as ``SuffixAutomaton.matches`` does; the rest of a chain is left
        once a token fits, as only one does.
        """
        if len(piece) == 1:
            return [self.single[piece[0]]]
        last = [-1] * (len(piece) + 1)
        compatible, words = self.compatible, self.automaton
        step, link, size, word, nearest = words.step, words.link, words.size, words.word, words.nearest
        if len(compatible) > 4_000_000:
            compatible.clear()
        state = length = 0
        for end, letter in enumerate(piece, 1):
            following = step[state].get(letter)
            while following is None and state:
                state = link[state]
                length = size[state]
                following = step[state].get(letter)
            if following is None:
                continue
            state, length = following, length + 1
            found = nearest[state if length == size[state] else link[state]]
            while found:
                token, before = word[found], end - size[found]
                if not before:
                    last[end] = token
                    break
                key = last[before] << 20 | token
                fits = compatible.get(key)
                if fits is None:
                    fits = compatible[key] = self.apart(last[before], token)
                if fits:
                    last[end] = token
                    break
                found = nearest[link[found]]
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= len(self.token[last[at]])
        return ids[::-1]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        parts, pieces, find = [], self.pieces, self.pattern.findall
        segments = self.split_specials.split(text) if self.split_specials else [text]
        for k, segment in enumerate(segments):
            if k % 2:
                parts.append(np.array([self.specials[segment]], "<i4").tobytes())
            else:
                parts.extend([pieces[p] for p in find(segment)])
        return np.frombuffer(b"".join(parts), "<i4")

    @staticmethod
    def _table(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in strings], np.int64)
        return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes, sizes

    @staticmethod
    def _spell(ids: np.ndarray, table) -> bytes:
        """The strings of all ids, one after the other."""
        letters, starts, sizes = table
        out = []
        for k in range(0, len(ids), 1 << 18):  # bounds the index arrays
            part = ids[k : k + (1 << 18)]
            size = sizes[part]
            shift = starts[part] - (np.cumsum(size) - size)
            out.append(letters[np.repeat(shift, size) + np.arange(size.sum())].tobytes())
        return b"".join(out)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self._spell(ids, self.token_bytes)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self._spell(ids, self.id_text)[:-1]


_LOADED: dict[int, Bpe] = {}


def _loaded(config: str) -> Bpe:
    """One encoder per worker, kept between tasks."""
    key = hash(config)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(config)
    return _LOADED[key]


def _shared(spark: SparkSession, path: str):
    """The vocabulary file, read once and sent to the executors (a few megabytes)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's id and ``ids``, the tokens of its whole text."""
    config = _shared(docs.sparkSession, path)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(config.value)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["id", "ids"]
            )

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Every row's id and ``text``, spelled out from its ids. Null ids give an empty text."""
    config = _shared(tokens.sparkSession, path)
    slim = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(config.value)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text; returns the token count and digests of both."""
    config = _shared(docs.sparkSession, path)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(config.value)
        for batch in batches:
            counts, listed, decoded = [], [], []
            for value in batch.column(1):
                ids = bpe.encode(value.as_py() or "")
                counts.append(len(ids))
                listed.append(hashlib.sha256(bpe.listed(ids)).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(listed, pa.string()), pa.array(decoded, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"), vocabulary_path())
