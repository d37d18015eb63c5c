"""Language identification: whole words first, shorter and shorter parts after.

A word known from the training texts scores by its log frequency in each language.
An unseen word is scored by its character n-grams: the longest that are known count,
and if none of a length is known the next shorter length is tried. A document's
score is the softmax of the mean over its words, sharpened by up to ``SHARPEN`` words.

Counting the training texts is a Spark job; the model keeps the words and n-grams
that occur ``MIN_COUNT`` times in a language. It is fitted on about ``MAX_TRAINING_DOCS``
labelled documents, as many of each language (at least ``LEAST_DOCS``, or all), chosen
by a hash of their id; so its size does not grow with the corpus, and every language
with a label can be predicted.

Null texts and texts without a letter are ``und`` with score 0. With no labelled
document everything is ``und``. Rows that repeat a document are judged each, alike. Ties go
to the language that comes first by code point. Texts of any length are read whole.
Rows without an id are judged; their remainder counts as 0. Extra columns play no part.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaframe.llm.common import read_table

MAX_TRAINING_DOCS = 5_000
LEAST_DOCS = 50
MIN_COUNT = 2
LONGEST_GRAM = 5
SHARPEN = 20
CACHED_WORDS = 300_000
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")


def words(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def count_grams(labelled: DataFrame) -> DataFrame:
    """lang, kind (0 for words, else the length), gram, n over texts with a language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                seen.setdefault(lang, Counter()).update(words(text))
            rows: Counter = Counter()
            for lang, found in seen.items():
                for word, n in found.items():
                    rows[lang, 0, word] += n
                    for size in range(1, LONGEST_GRAM + 1):
                        for gram in grams(word, size):
                            rows[lang, size, gram] += n
            yield pd.DataFrame([(*k, n) for k, n in rows.items()], columns=["lang", "kind", "gram", "n"])

    part = labelled.select("lang", "text").mapInPandas(run, "lang string, kind int, gram string, n long")
    return part.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))


def packed(rows: list[tuple[str, int, str, int]]) -> tuple[list[str], np.ndarray, str]:
    """Rows of the model in little room: languages, their place with kind and n, and the n-grams."""
    languages = sorted({r[0] for r in rows})
    place = {lang: i for i, lang in enumerate(languages)}
    numbers = np.array([(place[lang], kind, n) for lang, kind, _, n in rows], np.int64).reshape(-1, 3)
    # Letters and the marks of a word's ends: none is a line feed.
    return languages, numbers, "\n".join(r[2] for r in rows)


class Model:
    """Log frequencies per language of words (kind 0) and n-grams: a row of a matrix for each."""

    def __init__(self, languages: list[str], numbers: np.ndarray, names: str):
        self.languages, k = languages, len(languages)
        self.place: list[dict[str, int]] = [{} for _ in range(LONGEST_GRAM + 1)]
        rows = [self.place[kind].setdefault(gram, len(self.place[kind])) for gram, kind in zip(names.split("\n"), numbers[:, 1].tolist(), strict=False)]
        rows, self.logs = np.array(rows, np.int64), []
        for kind, place in enumerate(self.place):
            own = numbers[:, 1] == kind
            counts = np.zeros((len(place), k))
            np.add.at(counts, (rows[: len(own)][own], numbers[own, 0]), numbers[own, 2])
            floor = 0.5
            self.logs.append(np.log(counts + floor) - np.log(counts.sum(axis=0) + floor * (len(place) + 1)))
        self.clear()

    def clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.languages)))

    def score(self, word: str) -> np.ndarray:
        """Log likelihood by language; of parts, the mean of those that are known."""
        known = self.place[0].get(word)
        if known is not None:
            return self.logs[0][known]
        for size in range(LONGEST_GRAM, 0, -1):
            place = self.place[size]
            found = [i for g in grams(word, size) if (i := place.get(g)) is not None]
            if found:
                return self.logs[size][found].mean(axis=0)
        return np.zeros(len(self.languages))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not found or not self.languages:
            return UNKNOWN, 0.0
        if len(self.cache) > CACHED_WORDS:
            self.clear()
        cache = self.cache
        for word in found:
            if word not in cache:
                if len(cache) == len(self.matrix):
                    # Rows are added to twice the size, so that growing costs little.
                    self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
                self.matrix[len(cache)] = self.score(word)
                cache[word] = len(cache)
        total = self.matrix[[cache[w] for w in found]].mean(axis=0) * min(len(found), SHARPEN)
        share = np.exp(total - total.max())
        best = int(np.argmax(share))
        return self.languages[best], float(share[best] / share.sum())


def fit(docs: DataFrame, training: Column, id_col: str, text_col: str, lang_col: str, max_docs: int) -> list[tuple]:
    """The model's rows: lang, kind, gram, n."""
    usable = docs.filter(training & F.col(lang_col).isNotNull())
    size = {r[0]: r[1] for r in usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1))).collect()}
    if not size:
        return []
    each = max(LEAST_DOCS, max_docs // len(size))
    share = F.create_map(*[F.lit(x) for lang, n in size.items() for x in (lang, int(min(1.0, each / n) * 1_000_000))])
    place = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1_000_000))
    labelled = usable.filter(place < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return [tuple(r) for r in count_grams(labelled).filter(F.col("n") >= MIN_COUNT).collect()]


_LOADED: dict[str, Model] = {}


def identify(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_docs: int = MAX_TRAINING_DOCS,
    with_rows: bool = False,
) -> DataFrame:
    """id, lang_pred and score for every row; ``with_rows`` adds the struct ``row``.

    Learns from the rows where ``training`` holds and the language is not null.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(packed(fit(docs, training, id_col, text_col, lang_col, max_docs)))
    payload = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if with_rows else []
    name = uuid.uuid4().hex  # of this model, in workers that outlive it
    inner = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *payload)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = Model(*model.value)
        for part in texts:
            yield pd.DataFrame([_LOADED[name].predict(t) for t in part], columns=["lang_pred", "score"])

    out = inner.withColumn("found", predict("text"))
    return out.select("id", "found.lang_pred", "found.score", *(["row"] if with_rows else []))


def remainder(id_col: str, parts: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    fold = remainder("doc_id", 4)
    found = identify(docs, fold != 2).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")
